"""Sizes and partitions that the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text of one partition where an operator deals documents out, in bytes.
PART_BYTES = 32 << 20

#: The integer that stands for a null id.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Only (id, txt): a null id becomes NO_ID, a null text "". Clashing or further columns go."""
    return docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("txt"))


#: Bytes of an Arrow batch between Spark and Python, at most.
BATCH_BYTES = 8 << 20


def small_batches(spark) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch to BATCH_BYTES; that bounds memory and changes no result."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def parts_for(df: DataFrame, text: str = "txt", least: int | None = None) -> int:
    """Partitions so that each has about PART_BYTES of text; one number goes to the driver."""
    small_batches(df.sparkSession)
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if least is None else least, -(-total // PART_BYTES))


def group_of(key: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(groups)).cast("int")


def has_checkpoint_dir(spark) -> None:
    """Keeps the folder that the cluster names in spark.checkpoint.dir. Where it names none, a temporary one serves
    a session in one process (tests); on a cluster, whose machines don't share such a folder, that is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with as many underscores before it as no column of ``taken`` (in any case of letters) has it."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def saved(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, and what its making has shuffled given free: Spark's cleaner deletes files of plans that a garbage collection finds unused."""
    has_checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


#: Rows up to which a table of a few short columns is broadcast.
SMALL_ROWS = 500_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count proves that it has at most ``most`` rows; else as it is, to be shuffled."""
    n = df.limit(most + 1).count()
    return F.broadcast(df) if n <= most else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))  # the place is no second argument of body


def scanned(values: Column, zero: Column, op: Callable[[Column, Column], Column], levels: int = 3, width: int = 64) -> Column:
    """``op`` over the values before each one, beginning with ``zero`` (exclusive prefix sums, say), in linear time.

    An array that grows by one costs its length each time; so only ``width`` results grow at once, and the totals
    of such chunks are scanned in the same way, ``levels`` deep.
    """

    def short(a: Column) -> Column:
        none = F.filter(F.array(zero), lambda _: F.lit(False))
        step = lambda acc, x: F.struct(op(acc["sum"], x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
        return F.aggregate(a, F.struct(zero.alias("sum"), none.alias("out")), step, lambda acc: acc["out"])

    def long(a: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int")), lambda k: F.slice(a, k * width + 1, F.lit(width)))

        def over(parts: Column) -> Column:
            totals = F.transform(parts, lambda p: F.aggregate(p, zero, op))
            return F.flatten(F.zip_with(parts, scanned(totals, zero, op, levels - 1, width), lambda p, before: F.transform(short(p), lambda x: op(before, x))))

        return let(parts, over)

    return let(values, lambda a: short(a) if levels == 1 else F.when(F.size(a) <= width, short(a)).otherwise(long(a)))


def flags(places: Column, n: Column) -> Column:
    """``n`` numbers, 1 at each of the sorted distinct ``places`` (from 0, those beyond the end are none) and 0 elsewhere."""

    def of(p: Column) -> Column:
        before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(p, i - 1))
        gap = lambda k: F.array_repeat(F.lit(0), k)
        filled = F.flatten(F.transform(p, lambda x, i: F.concat(gap((x - before(i) - 1).cast("int")), F.array(F.lit(1)))))
        return F.concat(filled, gap((n - 1 - F.coalesce(F.element_at(p, -1), F.lit(-1))).cast("int")))

    return let(F.filter(places, lambda x: x < n), lambda p: F.when(F.size(p) > 0, of(p)).otherwise(F.array_repeat(F.lit(0), n.cast("int"))))
