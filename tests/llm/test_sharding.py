import random
import zlib

import pytest
from pyspark.sql import functions as F

from foldspark.llm import sharding


def test_flow_is_the_cheapest():
    rng = random.Random(1)
    for _ in range(60):
        n, m = rng.randrange(1, 6), rng.randrange(1, 6)
        supply = [rng.randrange(50) for _ in range(n)]
        total = sum(supply)
        cap = [rng.randrange(60) for _ in range(m)]
        cap[-1] += max(0, total - sum(cap))
        got = sharding.flow(supply, cap)
        for i in range(n):
            assert sum(v for (x, _), v in got.items() if x == i) == supply[i]
        for j in range(m):
            assert sum(v for (_, y), v in got.items() if y == j) <= cap[j]
        # what can stay stays: no plan moves less
        stays = sum(v for (i, j), v in got.items() if i == j)
        assert stays == sum(min(a, b) for a, b in zip(supply, cap, strict=False))
    with pytest.raises(ValueError):
        sharding.flow([5], [4])


def test_plan(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("size", F.lit("clash")).withColumn("old", F.lit(1.5))
    old = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(6))
    planned = sharding.plan(docs, old, 6, [1] * 8)
    rows = {r.doc_id: r for r in planned.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows.keys() == texts.keys()
    sizes = [0] * 8
    slots = [[] for _ in range(8)]
    for k, r in rows.items():
        b = (texts[k] or "").encode()
        assert (r.size, r.text_crc32, r.old) == (len(b) + 16, zlib.crc32(b), zlib.crc32(str(k).encode()) % 6)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(sizes) - min(sizes) <= 4 * max(r.size for r in rows.values())
    stay = sum(r.size for r in rows.values() if r.old == r.shard)
    before = [sum(r.size for r in rows.values() if r.old == i) for i in range(6)]
    assert abs(stay - sum(min(b, sum(sizes) / 8) for b in before)) <= 6 * max(r.size for r in rows.values())
    done = sharding.rewrite(docs.drop("size", "old"), planned, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.doc_id: r.text for r in back.collect()} == {k: t for k, t in texts.items() if rows[k].shard in done}


def test_edges(spark):
    rows = [(None, None), (None, None), (1, ""), (1, "a"), (2, "é")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.report(sharding.plan(df, F.lit(0), 1, [1, 1, 2])).collect()
    assert len(out) == 100 and sorted({r.size for r in out}) == [16, 17, 18]
    n = [sum(r["size"] for r in out if r.shard == j) for j in range(3)]
    assert abs(n[0] - n[1]) <= 36 and abs(n[2] - 2 * n[0]) <= 72
    assert sharding.report(sharding.plan(df.filter("false"), F.lit(0), 1, [1])).count() == 0


def stored(spark, rows, n, folder):
    df = spark.createDataFrame(rows, "doc_id long, text string, old int, row string")
    df.withColumn("_shard", F.col("old")).write.partitionBy("_shard").parquet(folder)
    return spark.read.parquet(folder)


def test_reshard_in_place(spark, tmp_path):
    """Untouched shards keep their files, vanished ones go, and rows with repeated and null ids stay."""
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, i]), rng.choice([None, "", "a" * rng.randrange(60), f"é{i}"]), i % 4, "x") for i in range(900)]
    rows += [(7, "same", 3, "x")] * 3000
    folder = str(tmp_path / "data")
    docs = stored(spark, rows, 4, folder)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "data").glob("_shard=*/*.parquet")}
    size = lambda t: len((t or "").encode()) + 16
    sizes = [sum(size(t) for _, t, o, _ in rows if o == i) for i in range(4)]
    # shard 0 keeps its size, the others fall to one of three
    done = sharding.reshard(docs, folder, F.col("old"), 4, [sizes[0], sizes[1] + sizes[2] // 2, sizes[3] + sizes[2] - sizes[2] // 2])
    assert 3 in done and 0 not in done
    back = spark.read.parquet(folder)
    got = sorted(((r.doc_id, r.text, r.old, r.row) for r in back.collect()), key=str)
    assert got == sorted(rows, key=str)
    assert not (tmp_path / "data" / "_shard=3").exists() and not list((tmp_path / "data").glob("_new-*"))
    assert all(f.exists() and f.stat().st_mtime_ns == t for f, t in before.items() if "_shard=0" in str(f))
    assert back.columns == ["doc_id", "text", "old", "row", "_shard"]


def test_failed_rewrite(spark, tmp_path):
    """A job that fails, and ids that repeat, leave all files as they were."""
    rows = [(i, "t" * (i % 9), i % 2, "x") for i in range(200)]
    folder = str(tmp_path / "data")
    docs = stored(spark, rows, 2, folder)
    planned = sharding.plan(docs, F.col("old"), 2, [1, 1, 1]).checkpoint()
    broken = docs.withColumn("text", F.when(F.col("doc_id") == 150, F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        sharding.rewrite(broken, planned, folder)
    with pytest.raises(ValueError, match="repeat"):
        sharding.rewrite(docs, planned.union(planned), folder)
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(folder).collect()) == sorted(r[:2] for r in rows)
    done = sharding.rewrite(docs, planned, folder)
    assert done == [0, 1, 2] and sorted(tuple(r)[:2] for r in spark.read.parquet(folder).select("doc_id", "text").collect()) == sorted(r[:2] for r in rows)
    with pytest.raises(ValueError, match="shard"):
        sharding.plan(spark.read.parquet(folder), F.lit(5), 2, [1])
