import random
import re

from foldspark.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=20):
    """Every window by its first place; rows are (id, text) with distinct ids."""
    first = {}
    words = {k: WORD.findall(t or "") for k, t in rows}
    for k in sorted(words):
        w = words[k]
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), (k, i))
    out = {}
    for k, w in words.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (k, i):
                gone |= set(range(i, i + size))
        out[k] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def run(spark, rows, size=20):
    df = spark.createDataFrame([(k, t, 1, "c") for k, t in rows], "doc_id long, text string, id int, bucket string")
    return {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(df.repartition(5), size).collect()}


def test_small_words(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        n = rng.choice([0, 1, 5, 19, 20, 21, 60, 200])
        rows.append((k, " ".join(rng.choice("abc") for _ in range(n)) if n % 2 else "\n\t".join(str(rng.randrange(10**6)) for _ in range(n))))
    passage = " ".join(str(rng.randrange(10**6)) for _ in range(53))
    rows += [(1000 + k, f"{rng.random()} {passage} {rng.random()}") for k in range(100)]
    rows += [(2000 + k, rows[7][1]) for k in range(40)] + [(-5, passage), (3000, None), (3001, ""), (3002, passage + " " + passage), (3003, "x " * 30_000)]
    for size in (20, 3, 7):
        assert run(spark, rows, size) == brute(rows, size)


def test_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == {}
    text = " ".join(map(str, range(30)))
    got = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "a b")], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.n_removed) for r in substring_dedup.dedup(got).collect()), key=str)
    assert rows == [(1, 30), (1, 30), (2, 0), (None, 0)]
