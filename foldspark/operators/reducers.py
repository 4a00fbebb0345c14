"""Reducers: what a parallel reduction needs, as Spark aggregates or as Python functions.

A column reducer is an aggregate with a finalizer; any number of them are
computed in one pass. A function reducer (init, update, merge, finalize) runs
Python on each row and is the slow path, for what no aggregate expresses. Its
partial results are merged with their neighbours only, in the order of the rows, so
``merge`` need not commute. Each partition with rows begins with ``init()``, and begins
with it again after a state that has grown by about ``block`` bytes; ``init()`` therefore
must be neutral for ``merge``. Without rows the result is that of ``init()``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foldspark.functions.casts import without_nan

NAN, INF = float("nan"), float("inf")


@dataclass(frozen=True)
class Reducer:
    """Named aggregates of a column, and a finalizer from their columns to the result."""

    parts: Mapping[str, Callable[[Column], Column]]
    final: Callable[[Mapping[str, Column]], Column] = field(default=lambda p: next(iter(p.values())))

    def column(self, x: Column) -> Column:
        return self.final({k: f(x) for k, f in self.parts.items()})

    def where(self, p: Column) -> Reducer:
        """The same over the rows that hold ``p`` only."""
        return self.mapped(lambda x: F.when(p, x))

    def mapped(self, f: Callable[[Column], Column]) -> Reducer:
        return Reducer({k: (lambda x, g=g: g(f(x))) for k, g in self.parts.items()}, self.final)

    def finalized(self, final: Callable[[Column], Column]) -> Reducer:
        return Reducer(self.parts, lambda p: final(self.final(p)))


def total(strategy: str = "remove") -> Reducer:
    """Sum of doubles; 0.0 without rows."""
    return Reducer({"sum": lambda x: F.coalesce(F.sum(without_nan(x, strategy)), F.lit(0.0))})


def total_fast() -> Reducer:
    return Reducer({"sum": lambda x: F.coalesce(F.sum(x.cast("double")), F.lit(0.0))})


def count_of(strategy: str = "remove") -> Reducer:
    return Reducer({"n": lambda x: F.count(without_nan(x, strategy))})


def mean(strategy: str = "remove") -> Reducer:
    """NaN without rows."""
    return Reducer({"mean": lambda x: F.coalesce(F.avg(without_nan(x, strategy)), F.lit(NAN))})


def lsum() -> Reducer:
    """Sum of longs; an overflow is an error."""
    return Reducer({"sum": lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0).cast("long"))})


def lsummary() -> dict[str, Reducer]:
    """max, min, n_elems, mean and sum of longs; without rows the extremes are the type's own, turned round."""
    top, low = (1 << 63) - 1, -(1 << 63)
    return {
        "max": Reducer({"x": lambda x: F.coalesce(F.max(x), F.lit(low))}),
        "min": Reducer({"x": lambda x: F.coalesce(F.min(x), F.lit(top))}),
        "n_elems": Reducer({"x": F.count}),
        "mean": Reducer({"x": lambda x: F.coalesce(F.avg(x), F.lit(0.0))}),
        "sum": lsum(),
    }


def dsummary() -> dict[str, Reducer]:
    """The same of doubles; a NaN makes both extremes NaN."""
    bad = lambda x: F.coalesce(F.bool_or(F.isnan(x)), F.lit(False))
    return {
        "max": Reducer({"x": lambda x: F.when(bad(x), NAN).otherwise(F.coalesce(F.max(x), F.lit(-INF)))}),
        "min": Reducer({"x": lambda x: F.when(bad(x), NAN).otherwise(F.coalesce(F.min(x), F.lit(INF)))}),
        "n_elems": Reducer({"x": F.count}),
        "mean": Reducer({"x": lambda x: F.coalesce(F.avg(x), F.lit(0.0))}),
        "sum": total_fast(),
    }


def rows() -> Reducer:
    return Reducer({"n": lambda x: F.count(F.lit(1))})


def mode() -> Reducer:
    """The most frequent value, the smallest of those; null without rows."""
    return Reducer({"mode": lambda x: F.mode(x, True)})


def unique() -> Reducer:
    return Reducer({"set": lambda x: F.array_sort(F.collect_set(x))})


def cardinality() -> Reducer:
    return Reducer({"n": F.count_distinct})


def max_key(key: Column, pos: Column) -> Reducer:
    """The value at the largest key; the last of equal ones."""
    return Reducer({"x": lambda x: F.max_by(x, F.struct(key, pos))})


def min_key(key: Column, pos: Column) -> Reducer:
    return Reducer({"x": lambda x: F.min_by(x, F.struct(key, -pos))})


def max_index(pos: Column) -> Reducer:
    """The position of the largest value, the last of equal ones; -1 without rows."""
    return Reducer({"i": lambda x: F.coalesce(F.max_by(pos, F.struct(x, pos)), F.lit(-1).cast("long"))})


def min_index(pos: Column) -> Reducer:
    return Reducer({"i": lambda x: F.coalesce(F.min_by(pos, F.struct(x, -pos)), F.lit(-1).cast("long"))})


def every(p: Column) -> Column:
    """Aggregate: whether all rows hold ``p`` (null doesn't); true without rows."""
    return F.coalesce(F.bool_and(F.coalesce(p, F.lit(False))), F.lit(True))


def reduce_all(df: DataFrame, reducers: Mapping[str, tuple[Reducer, Column]]) -> DataFrame:
    """One row: every reducer of its column, in one pass."""
    return df.agg(*(r.column(x).alias(k) for k, (r, x) in reducers.items()))


def group_reduce(df: DataFrame, keys: Mapping[str, Column], reducers: Mapping[str, tuple[Reducer, Column]]) -> DataFrame:
    """A row for each key; partial in each task, then by key."""
    return df.groupBy(*(k.alias(n) for n, k in keys.items())).agg(*(r.column(x).alias(k) for k, (r, x) in reducers.items()))


def group_in_order(df: DataFrame, keys: Mapping[str, Column], reducers: Mapping[str, tuple[Reducer, Column]], pos: Column) -> DataFrame:
    """The same with ``_first``, the position at which each key is first seen."""
    return df.groupBy(*(k.alias(n) for n, k in keys.items())).agg(F.min(pos).alias("_first"), *(r.column(x).alias(k) for k, (r, x) in reducers.items()))


def group_by(df: DataFrame, key: Column, value: Column, pos: Column) -> DataFrame:
    """(k, vs): the values of each key in input order."""
    held = F.array_sort(F.collect_list(F.struct(pos.alias("p"), value.alias("v"))))
    return df.groupBy(key.alias("k")).agg(F.transform(held, lambda s: s["v"]).alias("vs"))


def frequencies(df: DataFrame, x: Column, name: str = "n") -> DataFrame:
    """(k, n) for each distinct value; null is one."""
    return df.groupBy(x.alias("k")).agg(F.count("*").alias(name))


#: Partitions whose partial results one task, or at last the driver, merges.
FAN_IN = 64

#: Bytes by which a pickled state may grow before it goes on unmerged.
BLOCK = 8 << 20

_PARTIAL = "part long, seq long, state binary"


class _NONE:
    """No state yet. A class, as pickled functions name it and don't copy it."""


def _partials(steps: Iterable[tuple[int, int, Callable[[Any], Any]]], block: int) -> Iterator[pa.RecordBatch]:
    """_PARTIAL of steps (part, bytes they read, state before -> state): the states at the end of each run of a part.

    A state is measured after its first step, and again before it can be expected to have grown by ``block`` bytes; by more
    than half of them, it goes on, and the next step begins anew. So a task holds no more for more steps: what two
    steps make, or one and a block; and a state that keeps its size, small or large, stays one.
    """
    at, seq, state, read, due, first = -1, 0, _NONE, 0, 0.0, None

    def batch(held: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([seq], pa.int64()), pa.array([held], pa.binary())], names=["part", "seq", "state"])

    for part, size, step in steps:
        if part != at:
            if state is not _NONE:
                yield batch(pickle.dumps(state))
            at, seq, state, read, due, first = part, 0, _NONE, 0, 0.0, None
        state = step(state)
        read += size
        if read >= due:
            held = pickle.dumps(state)
            first = len(held) if first is None else first
            if len(held) - first > block // 2:
                yield batch(held)
                seq, state, read, due, first = seq + 1, _NONE, 0, 0.0, None
            else:
                due = min(read + max(block, len(held)), read * max(2.0, block / len(held)))
    if state is not _NONE:
        yield batch(pickle.dumps(state))


@dataclass(frozen=True)
class FunctionReducer:
    """Python functions; the slow path."""

    init: Callable[[], Any]
    update: Callable[[Any, Any], Any]
    merge: Callable[[Any, Any], Any]
    finalize: Callable[[Any], Any] = field(default=lambda x: x)
    block: int = BLOCK

    def folded(self, df: DataFrame, order: Sequence[str | Column] | None = None) -> DataFrame:
        """(part, seq, state): the pickled states of each partition that has rows; part and seq count in the order of the rows.

        A partition has one state, or more where it grows. With ``order`` the rows are first sorted by ranges of it;
        without, they come as the frame has them.
        """
        init, update, block, names = self.init, self.update, self.block, df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            row, part = Row(*names), TaskContext.get().partitionId()

            def step(batch: pa.RecordBatch) -> Callable[[Any], Any]:
                def over(state: Any) -> Any:
                    state = init() if state is _NONE else state
                    for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        state = update(state, row(*values))
                    return state

                return over

            yield from _partials(((part, b.nbytes, step(b)) for b in batches if b.num_rows), block)

        return (df if order is None else df.orderBy(*order)).mapInArrow(run, _PARTIAL)

    def _then(self, held: Any) -> Callable[[Any], Any]:
        """The step that merges a pickled state into the one before."""
        return lambda state: pickle.loads(held) if state is _NONE else self.merge(state, pickle.loads(held))

    def merged(self, df: DataFrame, order: Sequence[str | Column] | None = None) -> DataFrame:
        """(part, seq, state) of neighbours merged in tasks, FAN_IN partitions at a time, until at most that many are left.

        States come to a task in batches, in their order. Those that grow by it are merged by twos at most, so that there
        may be more of them, not larger ones for more partitions.
        """
        block, then = self.block, self._then

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            states = ((p // FAN_IN, s) for b in batches for p, s in zip(b.column(0).to_pylist(), b.column(2), strict=True))
            yield from _partials(((p, len(s.as_buffer()), then(s.as_buffer())) for p, s in states), block)

        found = self.folded(df, order)
        # a sort by ranges makes at most as many partitions as a shuffle has
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if order is not None else df.rdd.getNumPartitions()
        while parts > FAN_IN:
            parts = -(-parts // FAN_IN)
            found = found.repartition(parts, F.floor(F.col("part") / FAN_IN)).sortWithinPartitions("part", "seq").mapInArrow(run, _PARTIAL)
        return found

    def reduce(self, df: DataFrame, order: Sequence[str | Column] | None = None) -> Any:
        """Over the rows, on the driver: it gets the merged states and makes one of them. A large one is for ``reduced``."""
        out = _NONE
        for _, _, state in sorted((r.part, r.seq, r.state) for r in self.merged(df, order).collect()):
            out = self._then(state)(out)
        return self.finalize(self.init() if out is _NONE else out)

    def reduced(self, df: DataFrame, schema: str, order: Sequence[str | Column] | None = None) -> DataFrame:
        """One row, whose one column is the result; none of it goes through the driver.

        A task gets the merged states in batches and holds the one that it makes of them, and its result: a value in a
        row, of at most 2 GB in Spark.
        """
        init, finalize, then, kinds = self.init, self.finalize, self._then, to_arrow_schema(StructType.fromDDL(schema))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = _NONE
            for batch in batches:
                for state in batch.column(2):
                    if state.is_valid:
                        out = then(state.as_buffer())(out)
            value = finalize(init() if out is _NONE else out)
            del out
            yield pa.RecordBatch.from_arrays([pa.array([value], kinds.field(0).type)], schema=kinds)

        # a row without a state, for the task to run where there are no others
        none = df.sparkSession.range(0, 1, 1, 1).select(F.lit(-1).cast("long").alias("part"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("binary").alias("state"))
        return self.merged(df, order).unionByName(none).repartition(1).sortWithinPartitions("part", "seq").mapInArrow(run, schema)

    def partials(self, df: DataFrame, order: Sequence[str | Column] | None = None) -> Iterator[Any]:
        """The unmerged states in the order of the rows, one at a time on the driver."""
        for r in self.folded(df, order).orderBy("part", "seq").toLocalIterator():
            yield pickle.loads(r.state)
