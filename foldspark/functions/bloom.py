"""A split-block bloom filter: eight bits a key in one block of 256 bits, no false negatives."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The salts of the split-block filter of the Parquet format.
SALT = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint32)

LEAST_BYTES, MOST_BYTES = 32, 128 << 20


def bytes_for(n: int, fpp: float) -> int:
    """A power of two that holds n keys at the false-positive probability or better."""
    bits = -8.0 * n / math.log(1 - fpp ** (1 / 8))
    size = LEAST_BYTES
    while size < MOST_BYTES and size * 8 < bits:
        size *= 2
    return size


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit words (8 for each key) and the bit of each."""
    u = h.view(np.uint64)
    block = ((u >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    bit = (u.astype(np.uint32)[:, None] * SALT) >> np.uint32(27)
    return block[:, None] * 8 + np.arange(8), np.uint32(1) << bit


def build(df: DataFrame, key: Column, n: int, fpp: float) -> bytes:
    """The filter of the keys. Tasks make partial filters, words meet as bit_or; at most MOST_BYTES go to the driver."""
    size = bytes_for(n, fpp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(size // 4, dtype=np.uint32)
        for batch in batches:
            w, b = _places(batch.column(0).to_numpy(), size // 32)
            np.bitwise_or.at(words, w.ravel(), b.ravel())
        at = np.flatnonzero(words)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(words[part].astype(np.int64))], names=["at", "word"])

    hashed = df.select(F.xxhash64(key).alias("h"))
    table = hashed.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(size // 4, dtype=np.uint32)
    words[table.column("at").to_numpy()] = table.column("word").to_numpy().astype(np.uint32)
    return words.tobytes()


def probe(df: DataFrame, key: Column, held: bytes, name: str = "maybe") -> DataFrame:
    """``df`` with a column that is false only for keys that were never inserted."""
    sent = df.sparkSession.sparkContext.broadcast(held)

    @F.arrow_udf("boolean")
    def hit(h: pa.Array) -> pa.Array:
        words = np.frombuffer(sent.value, dtype=np.uint32)
        w, b = _places(h.to_numpy(zero_copy_only=False), len(words) // 8)
        return pa.array(((words[w] & b) != 0).all(axis=1))

    return df.withColumn(name, hit(F.xxhash64(key)))
