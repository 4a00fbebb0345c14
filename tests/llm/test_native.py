import collections
import hashlib
import math
import random
import re
import time
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from foldspark.llm import license_scan, line_dedup, oracles, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENCE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = "doc_id long, text string, f string, _w int, starts int"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], COLUMNS)


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    win = collections.defaultdict(list)
    for i in range(len(w) - 7):
        win[tuple(w[i : i + 8])].append(i)
    covered = {j for at in win.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)
    return (*n, n[0] < 20 or 100 * n[4] > 30 * n[0])


def test_quality_counts(spark, sf_dir):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "x\x0b\x0cy|\n\n x \nx\n x "), (303, "w " * 20_000), (304, "é😀 <&>" * 30), (None, "a b"), (None, "a b")]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = frame(spark, rows)
    got = quality_rules.report(df, quality_rules.ratios(df, df.filter("doc_id % 3 = 0")), -10.0).collect()
    assert len(got) == len(rows)
    texts = dict(rows[:-1]) | dict(rows)
    for r in got:
        assert tuple(r)[1:7] == counts(texts[r.doc_id]), r.doc_id
        assert r.kept == (not r.base_failed)
    none = df.filter("false")
    assert quality_rules.report(none, quality_rules.ratios(none, df), 0.0).count() == 0
    none = quality_rules.report(df, quality_rules.ratios(df, none), 0.5).collect()
    assert {r.score for r in none} == {0.0} and not any(r.kept for r in none)


def test_quality_scores(spark):
    """The ratio against counting in Python with the same hash."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d", "zz" if i % 2 else "e"]) for _ in range(40))) for i in range(60)]
    df = frame(spark, rows)
    buckets, even = quality_rules.BUCKETS, quality_rules.MIX / quality_rules.BUCKETS
    hashed = {r.w: r.h for r in spark.createDataFrame([(x,) for x in ["a", "b", "c", "d", "e", "zz"]], "w string").withColumn("h", F.xxhash64("w")).collect()}
    pairs = {(r.a, r.b): r.h for r in spark.createDataFrame([(a, b) for a in hashed.values() for b in hashed.values()], "a long, b long").withColumn("h", F.xxhash64("a", "b")).collect()}

    def grams(t):
        h = [hashed[w] for w in t.split()]
        return [x % buckets for x in h + [pairs[p] for p in zip(h, h[1:], strict=False)]]

    raw, good = collections.Counter(), collections.Counter()
    for k, t in rows:
        raw.update(grams(t))
        if k % 2 == 0:
            good.update(grams(t))
    ratio = lambda b: math.log(good[b] / sum(good.values()) + even) - math.log(raw[b] / sum(raw.values()) + even)
    want = {k: sum(map(ratio, g := grams(t))) / len(g) for k, t in rows}
    got = {r.doc_id: r.score for r in quality_rules.report(df, quality_rules.ratios(df, df.filter("doc_id % 2 = 0")), 0.0).collect()}
    assert got == pytest.approx(want)
    assert min(v for k, v in want.items() if k % 2 == 0) > max(v for k, v in want.items() if k % 2)


def test_quality_size(spark, sf_dir):
    """The same documents keep their verdicts when copies of all are added, and most of them when other documents are."""
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    verdicts = lambda d: {r.doc_id: r.kept for r in quality_rules.report(d, *quality_rules.fitted(d, labels)).collect()}
    one = verdicts(docs)
    copies = docs
    for i in range(1, 4):
        copies = copies.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000 * i))
    four = verdicts(copies)
    assert all(four[k + 1_000_000 * i] == v for k, v in one.items() for i in range(4))
    half = verdicts(docs.filter("doc_id % 2 = 0"))
    # four labelled bad rows fit the threshold of the half
    assert sum(one[k] == v for k, v in half.items()) >= 0.95 * len(half)
    # labels that neither the target nor the threshold has seen don't exist; those of the threshold's rows are not the target's
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % quality_rules.FOLDS == 0]
    good, bad = ([one[k] for k in held if truth[k] == q and k in one] for q in (1, 0))
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_quality_threshold(spark):
    assert quality_rules.split_point([]) == quality_rules.split_point([(1.0, 1)]) == quality_rules.DEFAULT
    assert quality_rules.split_point([(0.0, 0), (1.0, 1)]) == pytest.approx(0.1)
    assert quality_rules.split_point([(-2.0, 0), (1.0, 1)]) == quality_rules.DEFAULT
    assert quality_rules.split_point([(-2.0, 0), (-1.0, 0), (-1.0, 1), (0.0, 1), (0.0, 1), (3.0, 0)]) == pytest.approx(-0.1)  # as good as -1.1
    rng = random.Random(4)
    for _ in range(50):
        rows = [(rng.randrange(6) / 2, rng.randrange(2)) for _ in range(rng.randrange(2, 12))]
        n = [sum(y == k for _, y in rows) for k in (0, 1)]
        if all(n):
            gain = lambda t: sum((s >= t) / n[1] for s, y in rows if y) + sum((s < t) / n[0] for s, y in rows if not y)
            cuts = [-1, *(x + 0.25 for x in {s for s, _ in rows} - {max(rows)[0]})]  # above all rows is no threshold
            assert gain(quality_rules.split_point(rows)) == pytest.approx(max(map(gain, cuts)))
    docs = spark.createDataFrame([(1, "a"), (None, None), (None, "")], "doc_id long, text string")
    odd = spark.createDataFrame([(1, None), (None, 1), (1, 0), (1, 1)], "doc_id long, quality int")
    assert {(r.score, r.kept) for r in quality_rules.report(docs, *quality_rules.fitted(docs, odd)).collect()} == {(0.0, False)}


def test_quality_threshold_table(spark):
    """The threshold over a table is that of the list, with ties, one label, nulls and gaps of one unit."""
    rng = random.Random(7)
    few = [[], [(1.0, 1)], [(1.0, 1), (None, 0)], [(1.0, 1), (1.0, 0)], [(1.0, 0), (math.nextafter(1.0, 2), 1)], [(-2.0, 1), (3.0, 0)]]
    some = [[(rng.randrange(8) / 4 - 1, rng.randrange(2)) for _ in range(rng.randrange(2, 16))] for _ in range(4)]
    many = [(rng.gauss(0.3 * (y := rng.randrange(2)), 0.2), y) for _ in range(3000)]
    for rows in [*few, *some, many]:
        got = quality_rules.split_point_of(spark.createDataFrame(rows, "score double, y int").repartition(5))
        assert got == quality_rules.split_point([r for r in rows if r[0] is not None]), rows[:20]


def test_quality_fits_all(spark):
    """All labelled rows outside the target fit the threshold, however many there are."""
    rng = random.Random(5)
    ids = [k for k in range(60_000) if zlib.crc32(str(k).encode()) % quality_rules.FOLDS == 0][:10_000]
    text = lambda n: " ".join(f"{'a' if i < n else 'b'}{rng.randrange(90)}" for i in range(20))
    rows = [(k, text(n := rng.randrange(21)), int(rng.random() * 20 < n)) for k in ids]
    target = [(k, text(20), 1) for k in range(60_000, 60_400) if zlib.crc32(str(k).encode()) % quality_rules.FOLDS]
    docs = spark.createDataFrame(rows + target, "doc_id long, text string, quality int").cache()
    found, threshold = quality_rules.fitted(docs, docs)
    held = {k: y for k, _, y in rows}
    scores = [(r.score, held[r.doc_id]) for r in quality_rules.report(docs, found, 0.0).collect() if r.doc_id in held and not r.base_failed]
    assert len(scores) == len(rows) and threshold == quality_rules.split_point(scores)


def test_quality_fits_bad(spark):
    """Rows labelled as bad fit the threshold in every fold, as the target holds none of them."""
    fold = lambda k: zlib.crc32(str(k).encode()) % quality_rules.FOLDS
    rng = random.Random(9)
    text = lambda n: " ".join(f"{'a' if i < n else 'b'}{rng.randrange(90)}" for i in range(20))
    rows = [(k, text(n := rng.randrange(21)), int(fold(k) == 0 and rng.random() * 20 < n)) for k in range(800)]
    docs = spark.createDataFrame(rows + [(k, text(20), 1) for k in range(800, 1200)], "doc_id long, text string, quality int").cache()
    found, threshold = quality_rules.fitted(docs, docs)
    label = {r.doc_id: r.quality for r in docs.collect()}
    scores = [(r.score, label[r.doc_id], fold(r.doc_id)) for r in quality_rules.report(docs, found, 0.0).collect() if not r.base_failed]
    fit = [(s, y) for s, y, f in scores if f == 0 or not y]
    assert threshold == quality_rules.split_point(fit) != quality_rules.split_point([(s, y) for s, y, f in scores if f == 0])


def test_quality_dense(spark):
    """The table of ratios by bucket, and a plan that spells out none of its numbers on the driver."""
    entries = spark.createDataFrame([([],), ([(0, 1.0), (3, 2.0)],), ([(5, 3.0)],)], "e array<struct<b:int,r:double>>").checkpoint()
    got = [r.d for r in entries.select(quality_rules._dense(F.col("e"), 6).alias("d")).collect()]
    assert got == [[0.0] * 6, [1.0, 0.0, 0.0, 2.0, 0.0, 0.0], [0.0] * 5 + [3.0]]
    plan = entries.select(quality_rules._dense(F.col("e"), quality_rules.BUCKETS))._jdf.queryExecution().toString()
    assert len(plan) < 100_000


def test_quality_columns(spark):
    """Columns with the names of inner ones pass through; of two of a name in other letters, too."""
    docs = spark.createDataFrame([(1, "a b " * 30, 1, 2, 3, 4)], "doc_id long, text string, _words int, _table int, row int, m int")
    out = quality_rules.judged(docs, quality_rules.ratios(docs, docs), -9.0)
    assert out.columns == [*docs.columns, "_w", "_base_failed", "_score", "_kept"] and tuple(out.first())[2:6] == (1, 2, 3, 4)
    assert quality_rules.kept(docs, docs.selectExpr("doc_id", "1 as quality")).columns == docs.columns


def line_brute(rows, run=3):
    seen, out = {}, {}
    cut = lambda s: s.strip(" \t\n\x0b\x0c\r")
    docs = {k: [(i, cut(x)) for i, x in enumerate((t or "").split("\n")) if WORD.search(x)] for k, t in rows}
    for k in sorted(docs):
        for i in range(len(docs[k]) - run + 1):
            seen.setdefault(tuple(x for _, x in docs[k][i : i + run]), (k, i))
    for k, t in rows:
        gone = set()
        for i in range(len(docs[k]) - run + 1):
            w = docs[k][i : i + run]
            if seen[tuple(x for _, x in w)] < (k, i):
                gone |= {n for n, _ in w}
        left = "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone) if t is not None else None
        out[k] = (len(docs[k]), len(gone), left and hashlib.sha256(left.encode()).hexdigest() if left else left if left is None else hashlib.sha256(b"").hexdigest())
    return out


def test_lines(spark, sf_dir):
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice(["a", " a ", "b", "", "  ", "c d", "\te"]) for _ in range(rng.randrange(30)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "a\n" * 3000), (503, rows[3][1]), (-4, rows[5][1])]
    for run, gram in ((3, 2), (2, 1), (4, 2), (1, 1)):
        got = {r.doc_id: tuple(r)[1:] for r in line_dedup.report(frame(spark, rows).repartition(3), run, gram).collect()}
        assert got == line_brute(rows, run), run
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in line_dedup.report(docs).collect()}
    assert got == line_brute([(r.doc_id, r.text) for r in docs.collect()])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert got == {r[0]: r[1:] for r in con.sql(line_dedup.SQL).fetchall()}
    assert line_dedup.report(docs.filter("false")).count() == 0
    same = frame(spark, [(None, "a\nb\nc"), (None, "a\nb\nc"), (7, "x\na\nb\nc")])
    assert sorted((r.n_removed for r in line_dedup.report(same).collect())) == [0, 0, 3]
    assert line_dedup.dedup(same).drop("_n_lines", "_n_removed").columns == same.columns


def test_long_documents(spark):
    """Many lines in one document, all of them repeated: time about in proportion."""
    def seconds(n):
        text = "\n".join(f"line {i}" for i in range(n))
        rows = [(1, text), (2, "own\n" + text)]
        t = time.time()
        got = {r.doc_id: tuple(r)[1:3] for r in line_dedup.report(frame(spark, rows)).collect()}
        assert got == {1: (n, 0), 2: (n + 1, n)}
        return time.time() - t

    seconds(1000)
    one, four = seconds(15_000), seconds(60_000)
    assert four < 8 * one + 5, (one, four)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", 5, 6, 7, 8), (2, "a\nb\nc", 5, 6, 7, 8)], "doc_id long, text string, _id int, gone int, _left int, row int")
    out = line_dedup.dedup(docs).orderBy("doc_id")
    assert out.columns == [*docs.columns, "_n_lines", "_n_removed"] and [tuple(r) for r in out.collect()] == [(1, "a\nb\nc", 5, 6, 7, 8, 3, 0), (2, "", 5, 6, 7, 8, 3, 3)]


def test_short_runs(spark):
    """Runs of one or two lines with many words go, too; short lines stay; the earliest place stays."""
    one, two = " ".join(f"w{i}" for i in range(60)), "\n".join(" ".join(f"{c}{i}" for i in range(30)) for c in "pq")
    rows = [(1, f"head\n{one}\ntail"), (2, f"  {one}"), (3, f"{two}"), (4, f"x\n\n{two}\ny"), (5, "head"), (6, f"{two.splitlines()[0]}\nhead"), (7, None), (8, "a\nb\nc"), (9, "a\nb\nc"), (10, one[:-4])]
    got = {r.doc_id: (r.text, r._n_lines, r._n_removed, r._n_short) for r in line_dedup.dedup(frame(spark, rows), words=50).collect()}
    want = {k: (t, sum(bool(WORD.search(x)) for x in (t or "").split("\n")), 0, 0) for k, t in rows}
    assert got == want | {2: ("", 1, 1, 1), 4: ("x\n\ny", 4, 2, 2), 9: ("", 3, 3, 0)}
    assert {r.doc_id: r.text for r in line_dedup.dedup(frame(spark, rows)).collect()}[2] == f"  {one}"


def licence_brute(text, threshold=0.8):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = LICENCE_WORD.findall(low)
    places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    found = []
    for label, t in license_scan.TEMPLATES:
        size, t = len(t.split()) + len(t.split()) // 4, set(t.split())
        share = max((len(set(w[i : i + size]) & t) / len(t) for i in range(len(w))), default=0.0)
        if share >= threshold:
            found.append((label, share))
    at, base = [i for i, _ in places], {x for _, x in places}
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x for x, _ in found})), 1.0 if at else max((x for _, x in found), default=0.0)


def test_licences(spark, sf_dir):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        t = rng.choice(license_scan.TEMPLATES)[1].split()
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = rng.choice(["the", "zzz", "License", "\n", "MIT", "public"])
        rows.append((i, " ".join(x.upper() if rng.random() < 0.3 else x for x in t) + rng.choice(["", ".", "\n\nMIT-License, mit\nLICENSE apache \x00 license general_public license ümit license"])))
    rows += [(900, None), (901, ""), (902, "mit license " * 3000), (903, "MIT License"), (904, "all\nrights reserved"), (905, "aLL rIGHTS (reserved)")]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in license_scan.report(license_scan.scan(frame(spark, rows))).collect()}
    for k, t in rows:
        want = licence_brute(t)
        assert got[k][:6] == want[:6] and got[k][6] == pytest.approx(want[6]), (k, t, got[k], want)
    assert license_scan.report(license_scan.scan(frame(spark, rows).filter("false"))).count() == 0
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert {r[0]: r[1:7] for r in con.sql(oracles.license_scan_sql()).fetchall()} == {k - 1000: v[:6] for k, v in got.items() if k >= 1000}


def test_wrapped_licences(spark):
    """Statements over several lines, indented, and behind comment marks."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    wrap = lambda t, mark, n: "\n".join(mark + " ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    texts = [mit, wrap(mit, "", 7), wrap(mit, " * ", 6), wrap(bsd, "# ", 8), wrap(bsd, "// ", 5), f"other words\n\n{wrap(bsd, '    ', 9)}\n\nmore words", " ".join(x + " zzz" * 6 for x in mit.split()), "all\n# rights\n# reserved"]
    got = [r.labels for r in license_scan.report(license_scan.scan(frame(spark, list(enumerate(texts))))).orderBy("doc_id").collect()]
    assert got == ["mit", "mit", "mit", "bsd", "bsd", "bsd", "", "all-rights-reserved"]


def test_licence_words(spark):
    """The words of texts cost a few times as much as a plain split, not tens of times."""
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("Word one-two, "), 300), "id").alias("text"))
    plain = lambda: docs.select(F.sum(F.size(F.split(F.lower("text"), "[^a-z0-9]+")))).first()[0]
    scan = lambda: license_scan.report(license_scan.scan(docs)).agg(F.sum("n_words"), F.max("labels")).first()
    assert (plain(), tuple(scan())) == (12_000 * 901, (12_000 * 901, ""))
    times = []
    for f in (plain, scan):
        t = time.time()
        f()
        times.append(time.time() - t)
    assert times[1] < 10 * times[0] + 2, times


def test_many_templates(spark):
    """A thousand templates, in texts of any length."""
    rng = random.Random(1)
    templates = tuple((f"l{i}", " ".join(f"{rng.choice('abcdef')}{rng.randrange(3000)}" for _ in range(12))) for i in range(1000)) + (("none", ""),)
    texts = [" ".join(f"x{rng.randrange(99)}" for _ in range(rng.randrange(50))) + " " + templates[i][1] for i in range(0, 1000, 40)] + ["", None, "the of and " * 60_000]
    got = license_scan.scan(frame(spark, list(enumerate(texts))), templates=templates).orderBy("doc_id").collect()
    assert [[x.label for x in r.found] for r in got] == [[f"l{i}"] for i in range(0, 1000, 40)] + [[], [], []]
