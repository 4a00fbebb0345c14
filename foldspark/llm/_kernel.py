"""Vectorised text kernels over Arrow string columns (numpy, no per-word Python).

Everything here works on one slice of documents at a time (``slices``), so the
memory of a task is bounded by the slice size or by one document, whichever is
larger, not by the Arrow batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
SLICE_BYTES = 1 << 20

#: ASCII white space that ends a word: [\x20\x09-\x0D].
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

U64 = np.uint64


def _table(seed: int, lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte, 0 for white space; with ``lower`` A-Z hash as a-z."""
    t = np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
    t[list(SPACES)] = 0
    if lower:
        t[65:91] = t[97:123]
    return t


_BASE = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
_STEP = (U64(0xC2B2AE3D27D4EB4F), U64(0xA0761D6478BD642F))
_TABLES = {(s, lower): _table(7 + s, lower) for s in (0, 1) for lower in (False, True)}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(stream: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(stream)
    if have is None or len(have[0]) < n:
        base = int(_BASE[stream])
        size = max(n, SLICE_BYTES + (1 << 16))
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U64(b), dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = (both[0], both[1])
        if size <= 4 * SLICE_BYTES:
            _POWERS[stream] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Words:
    """The words of consecutive documents: byte starts and ends in ``buf``, first word of each document."""

    __slots__ = ("buf", "starts", "ends", "first", "doc")

    def __init__(self, texts: list) -> None:
        joined = b" ".join(texts) + b" "
        self.buf = np.frombuffer(joined, dtype=np.uint8)
        space = _SPACE[self.buf]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.starts, self.ends = edge[0::2], edge[1::2]
        lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        begin = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(lens + 1, out=begin[1:])
        self.first = np.searchsorted(self.starts, begin)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = False, stream: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        up, down = _powers(stream, len(self.buf))
        terms = _TABLES[stream, lower][self.buf]
        terms *= up[: len(terms)]
        return mix(np.add.reduceat(terms, self.starts) * down[self.starts])

    def solid(self) -> tuple[np.ndarray, np.ndarray]:
        """The place of each word's first letter or digit (-1: it has none), and a hash of its letters and digits, A-Z lowered."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        places = np.flatnonzero(_SOLID[self.buf])
        at = np.minimum(np.searchsorted(places, self.starts), max(0, len(places) - 1))
        begin = places[at] if len(places) else np.zeros(len(self), dtype=np.int64)
        begin = np.where((begin >= self.starts) & (begin < self.ends), begin, -1) if len(places) else begin - 1
        up, down = _powers(0, len(self.buf))
        terms = _TABLES["solid", True][self.buf] * up[: len(self.buf)]
        return begin, mix(np.add.reduceat(terms, self.starts) * down[np.maximum(begin, 0)])

    def windows(self, size: int) -> np.ndarray:
        """Indices of the words at which a window of ``size`` words of one document starts."""
        if len(self) < size:
            return np.zeros(0, dtype=np.int64)
        at = np.arange(len(self) - size + 1)
        return at[self.doc[: len(at)] == self.doc[size - 1 :]]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True

#: Bytes of letters and digits: ASCII ones, and all of other characters.
_SOLID = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _SOLID[_a:_b] = True
_TABLES["solid", True] = np.where(_SOLID, _table(11, True), U64(0))


def rolled(h: np.ndarray, size: int, stream: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` values (over document bounds too; see Words.windows)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    step, total, done, block, width = int(_STEP[stream]), np.zeros(n, dtype=np.uint64), 0, h, 1
    while width <= size:
        if size & width:
            total += block[done : done + n] * U64(pow(step, done, 1 << 64))
            done += width
        if width * 2 <= size:
            block = block[: len(block) - width] + block[width:] * U64(pow(step, width, 1 << 64))
        width *= 2
    return mix(total)


def texts_of(column: pa.Array) -> list:
    """The UTF-8 bytes of each text; a null is empty. Copies nothing."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    return [view[a:b] for a, b in zip(at, at[1:], strict=False)]


def slices(texts: list, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes (or of one document)."""
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield begin, i
            begin, total = i, 0
        total += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each group [first[i], first[i + 1]), flat, and the groups' new bounds."""
    group = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(values)
    if len(first) > 2:
        # by group, the order within it kept; 16-bit keys sort in linear time
        order = order[np.argsort(group[order].astype(np.uint16 if len(first) <= 1 << 16 else np.int64), kind="stable")]
    v, g = values[order], group[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
    bounds = np.zeros(len(first), dtype=np.int64)
    np.cumsum(np.bincount(g[keep], minlength=len(first) - 1), out=bounds[1:])
    return v[keep], bounds


def sums(values: np.ndarray, slot: np.ndarray, slots: int) -> np.ndarray:
    """The sum modulo 2**64 of the values of each slot (exact in doubles by halves, for fewer than 2**21 values a slot)."""
    low = np.bincount(slot, weights=(values & U64(0xFFFFFFFF)).astype(np.float64), minlength=slots)
    high = np.bincount(slot, weights=(values >> U64(32)).astype(np.float64), minlength=slots)
    return low.astype(np.uint64) + (high.astype(np.uint64) << U64(32))


def ragged(first: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices first[i] .. first[i] + lens[i] - 1 of every i, one after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(first - (ends - lens), lens)


def lists(values: np.ndarray, lens: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column with the given flat values and lengths."""
    offsets = np.zeros(len(lens) + 1, dtype=np.int32)
    np.cumsum(lens, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def planes(values: np.ndarray) -> bytes:
    """The bytes of fixed-width values, all first bytes first: like bytes lie together, so a shuffle compresses them."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes()


def unplanes(blobs: list, kind: type) -> np.ndarray:
    """The values of several blobs made by planes, one after the other."""
    width = np.dtype(kind).itemsize
    parts = [np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel() for b in blobs]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


def packed(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket: its number and, for each column, a blob of its values."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    bucket = bucket[order]
    head = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.zeros(0, dtype=np.int64)
    bounds = [*head.tolist(), len(bucket)]
    arrays = [pa.array(bucket[head].astype(np.int32), type=pa.int32())]
    for c in columns:
        c = c[order]
        arrays.append(pa.array([planes(c[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], type=pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", *(f"c{i}" for i in range(len(columns)))])


def packed_schema(n: int) -> str:
    return ", ".join(["bucket int", *(f"c{i} binary" for i in range(n))])


def by_bucket(batches: Iterator[pa.RecordBatch], kinds: list[type]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The buckets of a partition sorted by bucket, each with its whole columns."""
    at, held = None, [[] for _ in kinds]
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at is not None and row[0] != at:
                yield at, [unplanes(h, k) for h, k in zip(held, kinds, strict=True)]
                held = [[] for _ in kinds]
            at = row[0]
            for h, b in zip(held, row[1:], strict=True):
                if b is not None:
                    h.append(b)
    if at is not None:
        yield at, [unplanes(h, k) for h, k in zip(held, kinds, strict=True)]


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def spark_xxhash64(values: np.ndarray) -> np.ndarray:
    """xxhash64 of 64-bit integers as Spark's function of that name gives it (seed 42)."""
    # The primes of the published XXH64 algorithm.
    p1, p2, p3, p4, p5 = (U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        h = np.full(len(values), U64(42) + p5 + U64(8), dtype=np.uint64)
        h ^= _rotl(values.astype(np.int64).view(np.uint64) * p2, 31) * p1
        h = _rotl(h, 27) * p1 + p4
        h ^= h >> U64(33)
        h *= p2
        h ^= h >> U64(29)
        h *= p3
        h ^= h >> U64(32)
    return h.view(np.int64)


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """pmod(xxhash64(id), groups), as the SQL expression of frames.group_of."""
    return np.mod(spark_xxhash64(ids), groups)
