"""Resharding that moves the fewest bytes, by minimum-cost flow.

Method. The documents of each old shard fall into blocks by a hash. A
minimum-cost flow from the old shards' bytes to the new shards' capacities says
how many bytes go from where to where; bytes that stay in a shard of the same
number cost nothing, others one unit each, and the flow is found exactly, by
successive shortest paths over at most (old + new) nodes. The driver gets one
number for each old shard; the flow's parts (fewer than old + new) go to all. An
old shard's bytes lie in the order of its blocks, and in a block in that of the
hash; a document goes where the part of the flow that holds its middle goes.
``reshard`` carries the rows along and rewrites the shards whose files change.

Defined results: the size of a text is its UTF-8 bytes (null: none) plus
``overhead``; null and repeated ids and repeated rows are documents like others;
equal rows are interchangeable, and many of them (over ``MANY``) are dealt over
the blocks; an empty table gives an empty plan; other columns are not read, or
carried with ``carry``, whatever their names. Sizes differ from the capacities by
about one document at each bound.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm import _frames as D

#: Bytes of a block, about; and the least number of blocks of an old shard.
BLOCK_BYTES, LEAST_BLOCKS = 64 << 20, 8

#: Equal rows beyond which they are dealt over the blocks.
MANY = 1000


def flow(supply: Sequence[int], capacity: Sequence[int]) -> dict[tuple[int, int], int]:
    """The bytes that go from each old shard to each new one: all supply goes, no capacity is passed, and the fewest bytes change their shard's number."""
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities don't hold the bytes")
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    room: list[dict[int, int]] = [{} for _ in range(n + m + 2)]
    cost: dict[tuple[int, int], int] = {}
    for i, s in enumerate(supply):
        room[source][i], room[i][source] = s, 0
        cost[source, i] = cost[i, source] = 0
        for j in range(m):
            room[i][n + j], room[n + j][i] = s, 0
            cost[i, n + j], cost[n + j, i] = int(i != j), -int(i != j)
    for j, c in enumerate(capacity):
        room[n + j][sink], room[sink][n + j] = c, 0
        cost[n + j, sink] = cost[sink, n + j] = 0
    price = [0] * (n + m + 2)
    left = sum(supply)
    while left:
        far, via = [float("inf")] * (n + m + 2), [-1] * (n + m + 2)
        far[source], heap = 0, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for v, free in room[u].items():
                if free and (e := d + cost[u, v] + price[u] - price[v]) < far[v]:
                    far[v], via[v] = e, u
                    heapq.heappush(heap, (e, v))
        price = [p + min(f, far[sink]) for p, f in zip(price, far, strict=True)]
        path, v = [], sink
        while v != source:
            path.append((via[v], v))
            v = via[v]
        step = min(left, *(room[u][v] for u, v in path))
        for u, v in path:
            room[u][v] -= step
            room[v][u] += step
        left -= step
    return {(i, j): room[n + j][i] for i in range(n) for j in range(m) if room[n + j][i]}


def _sized(docs: DataFrame, old: Column, key: str, text: str, overhead: int, carry: bool) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    out = docs.select(F.col(f"`{key}`").alias("key"), (F.octet_length(t) + overhead).cast("long").alias("size"), F.crc32(t).alias("crc"), old.cast("int").alias("old"), *row)
    return out.withColumn("h", F.xxhash64("key", "crc", "size"))


def parts(moves: dict[tuple[int, int], int]) -> list[tuple[int, list[int], list[int]]]:
    """(old, bounds, shards): the bytes of an old shard from bounds[k] on go to shards[k]; what stays comes first."""
    out = []
    for i in sorted({i for i, _ in moves}):
        bounds, shards, total = [], [], 0
        for j, n in sorted(((j, n) for (x, j), n in moves.items() if x == i), key=lambda p: (p[0] != i, p[0])):
            bounds.append(total)
            shards.append(j)
            total += n
        out.append((i, bounds, shards))
    return out


def plan(docs: DataFrame, old: Column, n_old: int, weights: Sequence[int], key: str = "doc_id", text: str = "text", overhead: int = 16, carry: bool = False) -> DataFrame:
    """The rows (key, size, text_crc32, old, shard, slot) of every document, with ``carry`` also ``row``, its columns.

    weights: the new shards' shares of the bytes; old: the shard (below ``n_old``) that a row lies in.
    """
    spark = docs.sparkSession
    D.has_checkpoint_dir(spark)
    sized = _sized(docs, old, key, text, overhead, carry)
    supply = {r.old: r.n for r in sized.groupBy("old").agg(F.sum("size").alias("n")).collect()}
    if any(i is None or not 0 <= i < n_old for i in supply):
        raise ValueError(f"a row lies in no old shard below {n_old}")
    total = sum(supply.values())
    blocks = max(LEAST_BLOCKS, -(-total // (n_old * BLOCK_BYTES)))
    many = D.small(sized.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > MANY).select("h", F.lit(True).alias("many")))
    salt = F.when(F.col("many"), F.monotonically_increasing_id()).otherwise(F.lit(0))
    d = sized.join(many, "h", "left").withColumn("block", F.pmod(F.xxhash64("h", salt), F.lit(blocks)).cast("int")).drop("many").checkpoint()
    share = sum(weights)
    capacity = [total * w // share for w in weights]
    for j in range(total - sum(capacity)):
        capacity[j % len(capacity)] += 1
    # fewer rows than shards
    to = spark.createDataFrame(parts(flow([supply.get(i, 0) for i in range(n_old)], capacity)), "old int, bounds array<long>, shards array<int>")
    # a row for each block; with so many blocks that they are not small, Spark joins them by the key that the window has, too
    begins = F.coalesce(F.sum("n").over(Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = d.groupBy("old", "block").agg(F.sum("size").alias("n")).select("old", "block", begins.alias("begin"))
    order = [F.col(c) for c in ("h", "key", "crc", "size")]
    w = Window.partitionBy("old", "block").orderBy(*order)
    middle = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    placed = d.withColumn("middle", middle).join(begin, ["old", "block"]).join(F.broadcast(to), "old")
    placed = placed.withColumn("shard", F.get("shards", F.size(F.filter("bounds", lambda x: x <= F.col("begin") + F.col("middle"))) - 1))
    placed = placed.withColumn("rank", F.row_number().over(Window.partitionBy("old", "block", "shard").orderBy(*order)))
    counts = placed.groupBy("old", "block", "shard").agg(F.count("*").alias("n"))
    # within an old shard by block, and over the old shards' totals: no window holds more than the blocks of one old shard
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("shard", "old").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outer = F.coalesce(F.sum("t").over(Window.partitionBy("shard").orderBy("old").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = counts.groupBy("shard", "old").agg(F.sum("n").alias("t")).select("shard", "old", outer.alias("outer"))
    base = counts.withColumn("inner", inner).join(F.broadcast(totals), ["shard", "old"]).select("old", "block", "shard", (F.col("outer") + F.col("inner")).alias("base"))
    out = placed.join(D.small(base), ["old", "block", "shard"])
    slot = (F.col("base") + F.col("rank") - 1).cast("long")
    return out.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "old", "shard", slot.alias("slot"), *(["row"] if carry else []))


def report(planned: DataFrame, key: str = "doc_id") -> DataFrame:
    return planned.select(key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def affected(planned: DataFrame) -> list[int]:
    """The shards that get or lose documents, or are new, or vanish; one number for each goes to the driver."""
    changed = planned.filter("old <> shard")
    got = changed.select("shard").union(changed.select(F.col("old").alias("shard"))).distinct()
    return sorted(r.shard for r in got.collect())


def _swapped(rows: DataFrame, slot: str, shards: list[int], folder: str, rows_a_file: int) -> list[int]:
    """Writes ``rows`` (_shard, the column ``slot``, ...) beside the shards' files, and only then puts them in their places.

    All files are written in a hidden folder within ``folder`` first: a job that fails leaves the old files, and rows
    may come from the very files that are replaced. Other shards' files are not touched.
    """
    spark = rows.sparkSession
    aside = f"{folder}/_new-{uuid.uuid4().hex}"
    dealt = rows.repartition(F.col("_shard"), F.floor(F.col(slot) / rows_a_file)).sortWithinPartitions("_shard", slot).drop(slot)
    dealt.write.partitionBy("_shard").parquet(aside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for j in shards:
        at, new, was = path(f"{folder}/_shard={j}"), path(f"{aside}/_shard={j}"), path(f"{aside}/_was={j}")
        if fs.exists(at) and not fs.rename(at, was):
            raise OSError(f"shard {j} couldn't be put aside; its files are unchanged")
        # a shard without new rows vanishes
        if fs.exists(new) and not fs.rename(new, at):
            fs.rename(was, at)
            raise OSError(f"shard {j} couldn't be put in its place; its old files are back")
    fs.delete(path(aside), True)
    return shards


def rewrite(docs: DataFrame, planned: DataFrame, folder: str, key: str = "doc_id", rows_a_file: int = 100_000) -> list[int]:
    """Rewrites the affected shards of ``folder`` (_shard=N), by shard and slot, and removes those that vanish. Returns them.

    The plan's ids must be unique, or this raises an error; ``reshard`` takes any rows.
    """
    if planned.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        raise ValueError("ids repeat: reshard() carries the rows along")
    shards = affected(planned)
    rows = docs.drop("_shard").join(planned.select(F.col(key).alias("_key"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot")), F.col(f"`{key}`").eqNullSafe(F.col("_key"))).drop("_key")
    return _swapped(rows.filter(F.col("_shard").isin(shards)), "_slot", shards, folder, rows_a_file)


def reshard(docs: DataFrame, folder: str, old: Column, n_old: int, weights: Sequence[int], key: str = "doc_id", text: str = "text", rows_a_file: int = 100_000) -> list[int]:
    """Plans, and rewrites the affected shards of ``folder`` with the rows that the plan carries. Returns them.

    Repeated and null ids and equal rows each keep their row. A shard's rows lie by slot; the column _shard is the folder's.
    """
    planned = plan(docs, old, n_old, weights, key, text, carry=True)
    shards = affected(planned)
    columns = [c for c in docs.columns if c != "_shard"]
    rows = planned.filter(F.col("shard").isin(shards)).select(*(F.col("row")[c].alias(c) for c in columns), F.col("shard").alias("_shard"), F.col("slot").alias(slot := D.fresh(columns, "_slot")))
    return _swapped(rows, slot, shards, folder, rows_a_file)
