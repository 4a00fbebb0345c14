import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldspark.llm import _frames as D
from foldspark.llm import _graph
from foldspark.llm import _kernel as K

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB.é \n\t\x0b\x1c😀", max_size=30), max_size=6))
def test_words(texts):
    raw = K.texts_of(pa.array([*texts, None]))
    w = K.Words(raw)
    want = [WORD.findall(t.encode()) for t in texts] + [[]]
    got = [bytes(w.buf[a:b]) for a, b in zip(w.starts, w.ends, strict=True)]
    assert got == [x for ws in want for x in ws] and w.counts.tolist() == list(map(len, want))
    for lower in (False, True):
        fold = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), x) if lower else x for x in got]
        h = w.hashes(lower).tolist()
        assert len({*zip(fold, h, strict=True)}) == len(set(fold)) == len(set(h))
    for size in (1, 2, 3, 5):
        at = w.windows(size)
        runs = [(tuple(ws[i : i + size])) for ws in want for i in range(len(ws) - size + 1)]
        h = K.rolled(w.hashes(), size)[at].tolist()
        assert len(h) == len(runs) and len({*zip(runs, h, strict=True)}) == len(set(runs)) == len(set(h))
    begin, _ = w.solid()
    assert [int(b) - int(a) if b >= 0 else -1 for a, b in zip(w.starts, begin, strict=True)] == [m.start() if (m := re.search(rb"[0-9A-Za-z\x80-\xff]", x)) else -1 for x in got]


def test_slices_hold_all():
    texts = [b"x" * n for n in (0, 5, 0, 100, 3, 3, 3)]
    assert [i for a, b in K.slices(texts, 8) for i in range(a, b)] == list(range(7))
    assert list(K.slices([])) == []


def test_packing():
    rng = np.random.default_rng(1)
    bucket, a, b = rng.integers(0, 9, 500), rng.integers(-(1 << 60), 1 << 60, 500), rng.integers(0, 99, 500).astype(np.int32)
    batch = K.packed(bucket, [a, b])
    seen = {k: (x, y) for k, (x, y) in K.by_bucket(iter([batch]), [np.int64, np.int32])}
    for k in range(9):
        assert (seen[k][0] == a[bucket == k]).all() and (seen[k][1] == b[bucket == k]).all()


def test_hash_like_spark(spark):
    ids = [0, 1, -1, 12345678901, -(1 << 63), (1 << 63) - 1]
    rows = spark.createDataFrame([(i,) for i in ids], "id long").select("id", F.xxhash64("id").alias("h"), D.group_of("id", 7).alias("g")).collect()
    assert [r.h for r in rows] == K.spark_xxhash64(np.array([r.id for r in rows])).tolist()
    assert [r.g for r in rows] == K.group_of(np.array([r.id for r in rows]), 7).tolist()


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 7), (None, 3), (4, None)]
    links += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    boss = {}

    def root(x):
        boss.setdefault(x, x)
        while boss[x] != x:
            x = boss[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            boss[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in _graph.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    assert got == {x: root(x) for x in boss}
    assert _graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
