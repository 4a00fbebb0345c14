"""Ordered sequences: a DataFrame and the columns that order it.

Rows of a DataFrame have no order, so each operator takes the order's columns
(unique together). Dense positions cost one sort over ranges of the order and a
count for each partition; nothing runs through a single task.
"""

from __future__ import annotations

import pickle
import re
import tempfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POS = "_pos"

#: Partitions up to which their offsets are literals of the plan; beyond, a broadcast table of one row for each.
FEW_PARTITIONS = 64

#: Rows of a block in running sums.
BLOCK = 1 << 20


def _checkpointed(df: DataFrame) -> DataFrame:
    """Checkpointed in the folder that the cluster names; a temporary one serves a session in one process only."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint()


def with_pos(df: DataFrame, order: Sequence[str | Column], name: str = POS) -> DataFrame:
    """``df`` with dense positions from 0.

    The sorted rows are checkpointed, as the positions of a range-partitioned
    sort hold for one evaluation only; a row's number within its partition then
    needs the count of rows before the partition (one number for each goes to
    the driver).
    """
    s = _checkpointed(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, at = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    counts = sorted((r.p, r.n) for r in s.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    if len(before) <= FEW_PARTITIONS:
        offset = F.lit(0).cast("long") if len(before) < 2 else F.element_at(F.create_map(*(F.lit(x) for p in before for x in p)), part)
        return s.withColumn(name, (offset + at).cast("long")).drop("_m")
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    return s.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + at).cast("long")).drop("_m", "_part", "_before")


def take(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(max(n, 0))


def drop(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    return with_pos(df, order).filter(F.col(POS) >= n).drop(POS)


def rest(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    return drop(df, order, 1)


def take_last(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*(F.col(c).desc() for c in order)).limit(max(n, 0))


def drop_last(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    total = df.count()
    return with_pos(df, order).filter(F.col(POS) < total - max(n, 0)).drop(POS)


def subvec(df: DataFrame, order: Sequence[str | Column], start: int, end: int | None = None) -> DataFrame:
    """The rows start .. end - 1, with their new positions."""
    s = with_pos(df, order).filter(F.col(POS) >= start)
    return (s if end is None else s.filter(F.col(POS) < end)).withColumn(POS, F.col(POS) - start)


def first(value: Column, order: Column) -> Column:
    """Aggregate: the value of the first row, null without rows."""
    return F.min_by(value, order)


def last(value: Column, order: Column) -> Column:
    return F.max_by(value, order)


def reverse(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with the positions of the reversed sequence."""
    return with_pos(df, [F.col(c).desc() for c in order])


def map_indexed(df: DataFrame, order: Sequence[str | Column], f: Callable[[Column], Column], name: str = "value") -> DataFrame:
    """f(index) as a new column."""
    return with_pos(df, order).withColumn(name, f(F.col(POS)))


def zip_map(frames: Sequence[tuple[DataFrame, Sequence[str]]], f: Callable[..., Column], name: str = "value") -> DataFrame:
    """(_pos, f of one column of each frame): the frames side by side, as long as the shortest; each frame has one value column ``v``."""
    parts = [with_pos(df, order).select(POS, F.col("v").alias(f"v{i}")) for i, (df, order) in enumerate(frames)]
    joined = reduce(lambda a, b: a.join(b, POS), parts)
    return joined.select(POS, f(*(F.col(f"v{i}") for i in range(len(parts)))).alias(name))


def shift(df: DataFrame, order: Sequence[str | Column], n: int, value: str, name: str = "shifted") -> DataFrame:
    """The value n places before (after, if negative); the ends repeat. A join of positions, no global window."""
    s = with_pos(df, order)
    total = s.count()
    source = F.least(F.greatest(F.col(POS) - n, F.lit(0)), F.lit(max(total - 1, 0))).cast("long")
    values = s.select(F.col(POS).alias("_from"), F.col(value).alias(name))
    return s.withColumn("_from", source).join(values, "_from").drop("_from")


def reindex(df: DataFrame, order: Sequence[str | Column], indexes: DataFrame, index_order: Sequence[str], index: str) -> DataFrame:
    """out[i] = df[indexes[i]], with the positions of ``indexes``."""
    rows = with_pos(df, order).withColumnRenamed(POS, "_from")
    return with_pos(indexes, index_order).select(POS, F.col(index).cast("long").alias("_from")).join(rows, "_from").drop("_from")


def splice(a: DataFrame, order: Sequence[str | Column], at: int, b: DataFrame, b_order: Sequence[str | Column]) -> DataFrame:
    """``b`` inserted into ``a`` at index ``at``, with positions."""
    n = b.count()
    left = with_pos(a, order)
    moved = left.withColumn(POS, F.when(F.col(POS) >= at, F.col(POS) + n).otherwise(F.col(POS)))
    return moved.unionByName(with_pos(b, b_order).withColumn(POS, F.col(POS) + at))


def concat(frames: Sequence[tuple[DataFrame | None, Sequence[str | Column]]]) -> DataFrame:
    """The frames one after the other, with positions; None is no frame."""
    out, total = [], 0
    for df, order in frames:
        if df is not None:
            out.append(with_pos(df, order).withColumn(POS, F.col(POS) + total))
            total += df.count()
    return reduce(DataFrame.unionByName, out)


def merge_sorted(frames: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """A stable merge of sorted frames: ties by frame, then by each frame's order. Adds ``_src`` and positions."""
    union = reduce(DataFrame.unionByName, (df.withColumn("_src", F.lit(i)) for i, df in enumerate(frames)))
    return with_pos(union, [F.col(key).asc_nulls_last(), F.col("_src"), F.col(order)])


def running_sum(df: DataFrame, value: Column, name: str, pos: str = POS) -> DataFrame:
    """The sum of ``value`` up to each row: within blocks of positions, and over the blocks' totals."""
    block = F.floor(F.col(pos) / BLOCK).cast("long")
    d = df.withColumn("_block", block).withColumn("_x", value)
    inner = F.sum("_x").over(Window.partitionBy("_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    totals = d.groupBy("_block").agg(F.sum("_x").alias("_t"))
    # a row for each 2**20 positions
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.withColumn("_in", inner).join(before.drop("_t"), "_block").withColumn(name, (F.col("_in") + F.col("_before")).cast("long")).drop("_block", "_x", "_in", "_before")


def with_previous(df: DataFrame, columns: Sequence[str], pos: str = POS) -> DataFrame:
    """Each row with the columns of the row before as _prev_<name>, and _is_first."""
    before = df.select((F.col(pos) + 1).alias(pos), *(F.col(c).alias(f"_prev_{c}") for c in columns), F.lit(True).alias("_has"))
    return df.join(before, pos, "left").withColumn("_is_first", F.col("_has").isNull()).drop("_has")


def partition_by(df: DataFrame, order: Sequence[str | Column], key: Column, name: str = "_run") -> DataFrame:
    """Rows with positions and the number of their run of equal keys (null equals null)."""
    d = with_previous(with_pos(df, order).withColumn("_key", key), ["_key"])
    change = F.when(F.col("_is_first") | ~F.col("_key").eqNullSafe(F.col("_prev__key")), 1).otherwise(0)
    return running_sum(d, change, name).withColumn(name, F.col(name) - 1).drop("_key", "_prev__key", "_is_first")


def dedup_first_by(df: DataFrame, order: Sequence[str | Column], key: Column) -> DataFrame:
    """The first row of each run of equal keys."""
    d = with_previous(with_pos(df, order).withColumn("_key", key), ["_key"])
    return d.filter(F.col("_is_first") | ~F.col("_key").eqNullSafe(F.col("_prev__key"))).drop("_key", "_prev__key", "_is_first")


def partition_all(df: DataFrame, order: Sequence[str | Column], n: int, step: int | None = None, name: str = "_batch") -> DataFrame:
    """Rows with the number of each batch of n that they are in; batches start every ``step`` rows."""
    d = with_pos(df, order)
    if step is None or step == n:
        return d.withColumn(name, F.floor(F.col(POS) / n).cast("long"))
    low = F.greatest(F.ceil((F.col(POS) - n + 1) / F.lit(step)), F.lit(0)).cast("long")
    high = F.floor(F.col(POS) / step).cast("long")
    return d.withColumn(name, F.explode(F.when(low <= high, F.sequence(low, high))))


def take_while(df: DataFrame, order: Column, p: Column) -> DataFrame:
    """The rows before the first that doesn't hold ``p``; order: a column, or a struct of several."""
    stop = df.filter(~F.coalesce(p, F.lit(False))).agg(F.min(order).alias("_stop"))
    end = stop.first()["_stop"]
    if end is None:
        return df
    limit = F.struct(*(F.lit(x) for x in end)) if isinstance(end, tuple) else F.lit(end)
    return df.filter(order < limit)


Step = Callable[[Any, int, Any], tuple[Any, list[int]]]


def marked(df: DataFrame, order: Sequence[str | Column], value: str, step: Step, start: Any, rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(rows with positions, marks): a fold over all rows in their order, in parallel.

    ``step(state, position, value)`` gives the next state and positions to mark. Each partition of the sorted rows folds
    from a guess of the state it begins with (at first ``start``); where the state that the partition before ends with
    is another, it folds again. A fold mostly forgets how it began within some rows, so two or three rounds settle it;
    after n rounds the first n partitions are right in any case. A state for each partition goes to the driver; the
    rows come in Arrow batches, two columns of them.
    """
    s = with_pos(df, order)
    narrow = s.select(F.spark_partition_id().alias("part"), POS, F.col(value).alias("x"))

    def folded(begins: dict[int, Any], default: Any, todo: set[int] | None, marks: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            if todo is not None and part not in todo:
                return
            state, some = begins.get(part, default), False
            for batch in batches:
                found: list[int] = []
                for at, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    state, here = step(state, at, x)
                    found += here
                some = some or batch.num_rows > 0
                if marks and found:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=[POS])
            if some and not marks:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], names=["part", "state"])

        return run

    begins: dict[int, Any] = {}
    ends: dict[int, Any] = {}
    todo: set[int] | None = None
    for _ in range(rounds):
        for r in narrow.mapInArrow(folded(begins, start, todo, False), "part long, state binary").collect():
            ends[r.part] = pickle.loads(r.state)
        known = sorted(ends)
        want = dict(zip(known, [start, *(ends[p] for p in known)], strict=False))
        todo = {p for p in known if want[p] != begins.get(p, start)}
        begins = want
        if not todo:
            return s, narrow.mapInArrow(folded(begins, start, None, True), f"{POS} long")
    raise RuntimeError(f"the fold didn't settle in {rounds} rounds")


def _numbered(s: DataFrame, marks: DataFrame, name: str) -> DataFrame:
    """The rows with the number of marks up to each."""
    d = s.join(marks.select(F.col(POS).alias("_at"), F.lit(1).alias("_mark")), F.col(POS) == F.col("_at"), "left")
    return running_sum(d, F.coalesce("_mark", F.lit(0)), name).drop("_at", "_mark")


def cost_step(most: float) -> Step:
    """Marks where batches begin; the state is (cost, cost at the half mark, position after it).

    A batch ends with the item at which its cost first reached half of ``most``,
    or with all items so far if there is no such mark; what follows the mark
    starts the next batch, whose mark is taken at its next new item.
    """
    half = int(most) // 2

    def step(state: tuple, at: int, cost: float) -> tuple[tuple, list[int]]:
        total, mark, end = state
        total += cost
        if mark is None and total >= half:
            mark, end = total, at + 1
        if total < most:
            return (total, mark, end), []
        return (total - (total if mark is None else mark), None, None), [at + 1 if mark is None else end]

    return step


def _folded(values: Sequence[Any], step: Step, state: Any) -> list[int]:
    """The number of marks up to each value."""
    marks: list[int] = []
    for at, x in enumerate(values):
        state, here = step(state, at, x)
        marks += here
    return [sum(m <= at for m in marks) for at in range(len(values))]


def cost_batches(costs: Sequence[float], most: float) -> list[int]:
    """The batch of each item of a list."""
    return _folded(costs, cost_step(most), (0, None, None))


def partition_by_cost(df: DataFrame, order: Sequence[str | Column], cost: str, most: float, name: str = "_batch") -> DataFrame:
    """Rows with positions and the number of their cost batch."""
    return _numbered(*marked(df, order, cost, cost_step(most), (0, None, None)), name)


def split_while(df: DataFrame, order: Column, p: Column) -> tuple[DataFrame, DataFrame]:
    """The rows before the first that doesn't hold ``p``, and the rest."""
    head = take_while(df, order, p)
    return head, df.join(head.select(order.alias("_o")), order.eqNullSafe(F.col("_o")), "left_anti")


def predicate_step(same: Callable[[object, object], bool]) -> Step:
    """Marks where runs after the first begin: a run goes on while ``same(first of the run, value)``. The state is (that value,)."""

    def step(state: tuple | None, at: int, x: object) -> tuple[tuple, list[int]]:
        if state is not None and same(state[0], x):
            return state, []
        return (x,), [] if state is None else [at]

    return step


def predicate_runs(values: Sequence[Any], same: Callable[[object, object], bool]) -> list[int]:
    """The run of each value of a list."""
    return _folded(values, predicate_step(same), None)


def partition_by_predicate(df: DataFrame, order: Sequence[str | Column], value: str, same: Callable[[object, object], bool], name: str = "_run") -> DataFrame:
    """Runs of values that a Python predicate (not transitive, maybe) calls the same as the run's first."""
    return _numbered(*marked(df, order, value, predicate_step(same), None), name)


def add_constant(df: DataFrame, order: Sequence[str | Column], at: int, count: int, values: dict[str, Column]) -> DataFrame:
    """``count`` equal rows inserted at index ``at``, with positions."""
    d = with_pos(df, order)
    moved = d.withColumn(POS, F.when(F.col(POS) >= at, F.col(POS) + count).otherwise(F.col(POS)))
    ids = df.sparkSession.range(count).select((F.col("id") + at).alias(POS), *(x.cast(df.schema[c].dataType).alias(c) for c, x in values.items()))
    return moved.unionByName(ids)
