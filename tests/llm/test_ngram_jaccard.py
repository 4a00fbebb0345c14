import random
import re

import pytest

from foldspark.llm import ngram_jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, n=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows, n=5, num=80, den=100):
    sets, boss, at = {k: grams(t, n) for k, t in rows}, {k: k for k, _ in rows}, {}

    def root(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for k, s in sets.items():
        for g in s:
            at.setdefault(g, set()).add(k)
    for k, s in sets.items():
        near = {}
        for g in s:
            for o in at[g]:
                near[o] = near.get(o, 0) + 1
        for o, both in near.items():
            if o < k and den * both >= num * (len(s) + len(sets[o]) - both):
                a, b = root(k), root(o)
                boss[max(a, b)] = min(a, b)
    return {k: (len(s), root(k)) for k, s in sets.items()}


def run(spark, rows, **kw):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, id int, bucket string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.components(df.repartition(4), **kw).collect()}


def near_copies(rng, count, words, edits):
    base = [str(rng.randrange(10**6)) for _ in range(words)]
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            i = rng.randrange(len(w))
            if (k := rng.randrange(3)) == 0:
                w[i] = str(rng.randrange(10**6))
            elif k == 1:
                w.insert(i, str(rng.randrange(10**6)))
            elif len(w) > 1:
                del w[i]
        yield " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(spark, seed):
    rng = random.Random(seed)
    texts = []
    for words, edits in ((3, 1), (6, 1), (12, 2), (25, 2), (40, 3), (90, 6), (200, 10), (400, 25), (1500, 60)):
        for _ in range(6):
            texts += near_copies(rng, rng.randrange(2, 14), words, edits)
    texts += near_copies(rng, 120, 60, 3)
    texts += ["a b c d e f"] * 30 + ["A B C d e F", "", " \n", "a b", "a  b", "b a", "a b c d e"] + [None]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)
    if seed == 1:
        assert run(spark, rows, n=2, num=60) == brute(rows, 2, 60)


def test_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, None), (2, None), (3, "")]) == {1: (0, 1), 2: (0, 2), 3: (0, 3)}
    df = spark.createDataFrame([(None, "q w e r t y"), (4, "q w e r t y"), (4, "q w e r t y"), (4, "z x c v b n"), (9, "z x c v b n"), (None, "1 2 3 4 5 6 7")], "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_jaccard.components(df).collect()), key=str)
    assert got == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (4, 2, 4), (9, 2, 4), (None, 3, 4)], key=str)


def test_split_subsets(spark, monkeypatch):
    """Subsets of more members than one task compares: pairs of blocks find the same."""
    monkeypatch.setattr(ngram_jaccard, "MEMBERS", 6)
    rng = random.Random(9)
    texts = [t for words, edits in ((60, 5), (25, 3), (200, 30)) for t in near_copies(rng, 90, words, edits)]
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)


def test_few_jobs(spark):
    """The components are found once; what is settled later joins those so far. Each job costs memory of the driver."""
    rng = random.Random(3)
    rows = list(enumerate(t for _ in range(8) for t in near_copies(rng, 6, 40, 2)))
    jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId
    before = jobs()
    assert run(spark, rows) == brute(rows)
    assert jobs() - before < 100
