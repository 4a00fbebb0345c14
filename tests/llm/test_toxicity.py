import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.llm import toxicity


def corpus(n, seed=1):
    rng = random.Random(seed)
    common = [f"w{i}x" for i in range(300)]
    bad = ["slurone", "slurtwo", "Slurthree", "slur-four"]
    for k in range(n):
        words = [rng.choice(common) for _ in range(rng.randrange(5, 80))]
        toxic = int(rng.random() < 0.2)
        for _ in range(toxic * rng.randrange(1, 4)):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        yield k, " ".join(words), toxic


def test_nearest_is_exact():
    rows = list(corpus(500))
    f, c, b = toxicity.features([t.encode() for _, t, _ in rows])
    ex = [(k, y, f[x:z], c[x:z]) for (k, _, y), x, z in zip(rows, b.tolist(), b[1:].tolist(), strict=False)]
    words = np.unique(f)
    index = toxicity.Index(words, ex[:400], 0.2, np.log(1001 / (1 + np.arange(len(words)) % 50)))
    full = np.zeros((len(index.ids), len(words)))
    for i, k in enumerate(index.ids.tolist()):
        at, w = index.vector(*ex[k][2:])
        full[i, at] = w
    assert (full > 0).any(axis=0).sum() == len(np.unique(np.concatenate([f for _, _, f, _ in ex[:400]])))
    for k in range(400, 500):
        at, w = index.vector(*ex[k][2:])
        best, cosine = index.nearest(at, w)
        q = np.zeros(len(words))
        q[at] = w
        want = np.sort(full @ q)[::-1][:15]
        assert cosine == pytest.approx(want) and full[best] @ q == pytest.approx(cosine)


def parts(text):
    """The features of a text in plain Python, with counts."""
    out = collections.Counter()
    for w in (text or "").split():
        w = "".join(c.lower() if c.isascii() else c for c in w if c.isalnum() or not c.isascii())
        for n in ([None, *(n for n in toxicity.STEMS if len(w.encode()) > n)] if w else []):
            out[w if n is None else (n, w.encode()[:n])] += 1
    return out


def brute(docs, examples, share):
    """Vote and nearest ids of every text among the examples (id, label, text)."""
    df = collections.Counter(f for t in docs for f in parts(t))
    known = {f for _, _, t in examples for f in parts(t)}
    n = [sum(y == k for _, y, _ in examples) for k in (0, 1)]
    seen = [collections.Counter(f for _, y, t in examples if y == k for f in parts(t)) for k in (0, 1)]
    part = n[1] / sum(n)
    rel = {f: abs(math.log((seen[1][f] + 16 * part) / (seen[0][f] + 16 * (1 - part)) * n[0] / n[1])) + 1e-3 for f in known}

    def vector(t):
        v = {f: (1 + math.log(c)) * (math.log((1 + len(docs)) / (1 + df[f])) + 1e-9) * rel[f] for f, c in parts(t).items() if f in known}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {f: x / size for f, x in v.items()}

    vectors = [(k, y, vector(t)) for k, y, t in examples]

    def vote(t):
        q = vector(t)
        near = sorted((-round(sum(x * v.get(f, 0) for f, x in q.items()), 9), k, y) for k, y, v in vectors)[:15]
        near = [(-c, k, y) for c, k, y in near if c < 0]
        return (sum(c * y for c, _, y in near) + 0.5 * share) / (sum(c for c, *_ in near) + 0.5), [k for _, k, _ in near[:3]]

    return vote


def test_scored_like_brute_force(spark):
    """Votes, neighbours and scores of whole tables, with ties, copies and odd texts, against plain Python."""
    rows = [(k, t, y) for k, t, y in corpus(300, 3)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(0, 60, 3)] + [(2000, None, 0), (2001, "", 1), (2002, "!? ...", 0), (2003, "Ünïcödé Wörter slurone " * 3, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int").select("doc_id", "text").repartition(5)
    known = {k: y for k, _, y in rows if k % 2 and zlib.crc32(str(k).encode()) % 5}
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k % 2], "doc_id long, toxic int")
    share = sum(known.values()) / len(known)
    texts = {k: t for k, t, _ in rows}
    examples = [(k, known[k], texts[k]) for k in sorted(known, key=lambda k: (-known[k], k))]
    vote = brute(list(texts.values()), examples, share)
    held = []
    for p in range(4):
        one = brute(list(texts.values()), [e for i, e in enumerate(examples) if i % 4 != p], share)
        held += [(one(t)[0], y) for _, y, t in [e for i, e in enumerate(examples) if i % 4 == p]]
    # isotonic means by the largest lower average: min over ends of max over beginnings
    n = [sum(y == k for _, y in held) for k in (0, 1)]
    held = sorted((round(v, 9), y, share / n[1] if y else (1 - share) / n[0]) for v, y in held)
    values = sorted({v for v, *_ in held})
    mean = lambda a, z: (lambda x: sum(w * y for _, y, w in x) / sum(w for *_, w in x))([h for h in held if a <= h[0] <= z])
    fit = [max(min(mean(a, z) for z in values if z >= v) for a in values if a <= v) for v in values]
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        v, near = vote(texts[r.doc_id])
        assert r.vote == pytest.approx(v) and r.neighbours == near, r
        assert r.score == pytest.approx(np.interp(v, values, fit), abs=1e-6), r


def test_held_out_recall(spark):
    """On the synthetic table: labels that neither the fit nor any choice has seen."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.scored(docs, labels).filter("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    toxic = [r.predicted for r in got if r.toxic]
    clean = [r.predicted for r in got if not r.toxic]
    assert len(toxic) > 50 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.03 * len(clean), (sum(toxic), len(toxic), sum(clean), len(clean))


def test_held_out_accuracy(spark):
    rows = list(corpus(3000))
    docs = spark.createDataFrame([(k, t, "x", 0.5, y) for k, t, y in rows], "doc_id long, text string, y string, score double, toxic int")
    labels = docs.select("doc_id", "toxic").filter("doc_id % 2 = 0")
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == 3000
    truth = {k: y for k, _, y in rows}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(not zlib.crc32(str(n).encode()) % 5 == 0 for r in got for n in r.neighbours)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "! ?"), (3, "x " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.0}
    some = spark.createDataFrame([(1, None), (2, 1), (None, 1), (3, 0), (3, 1), (77, 0)], "doc_id long, toxic int")
    assert toxicity.scored(docs, some).count() == 5
    assert toxicity.scored(docs.filter(F.lit(False)), some).count() == 0
