"""Removal of word passages that also start earlier, found by difference-cover anchors.

Method. A window is ``size`` consecutive words of one document. Positions whose
remainder modulo a period lies in a difference cover are anchors; an anchor's
words (``size - period + 1`` of them) are hashed, at about a third of all
positions. Whatever the offset between two equal windows, some anchor lies at
the same place in both, so a window without a repeated anchor is not repeated.
Windows around repeated anchors are then extended to their full length (a
96-bit hash of all their words) and compared with the earliest equal window;
the union of the removed windows is what a match extended both ways covers.

1. Anchors go, packed, to hash buckets; a task sends one row for an anchor that
   it has seen several times, so a passage in a third of all documents reaches
   a bucket once for each task.
2. Repeated anchors go back to the document's group; the group's documents are
   read there, and their candidate windows go to hash buckets, again at most
   one row (the earliest) for each task and window.
3. Starts that are not the earliest go back to the same groups (Spark reuses
   the exchange of the documents), which write the kept words.

Defined results: a null or empty text has no words; documents under ``size``
words lose nothing; rows that share an id (or have none, which sorts first)
count as one document: a start that is removed in one is removed in each;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm import _frames as D
from foldspark.llm import _kernel as K

#: Perfect difference covers by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18)}

#: Entries that a task holds before it packs and sends them.
FLUSH = 1_500_000

_PACKED = K.packed_schema(4)


def period_of(size: int) -> int:
    """The largest period that leaves anchors of four words or more (two fifths of the window at least)."""
    return max(p for p in COVERS if p == 1 or size - p + 1 >= max(4, 2 * size // 5))


def _anchors(size: int, buckets: int, groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    period = period_of(size)
    length = size - period + 1
    cover = np.zeros(period, dtype=bool)
    cover[list(COVERS[period])] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            texts, ids = K.texts_of(batch.column(1)), batch.column(0).to_numpy()
            for a, b in K.slices(texts):
                w = K.Words(texts[a:b])
                at = w.windows(length)
                begin = at - w.first[w.doc[at]]
                at = at[cover[begin % period] & (w.counts[w.doc[at]] >= size)]
                if len(at):
                    held.append((K.rolled(w.hashes(), length)[at], ids[a:b][w.doc[at]], (at - w.first[w.doc[at]]).astype(np.int32)))
                    n += len(at)
                if n >= FLUSH:
                    yield from _sent(held, buckets, groups)
                    held, n = [], 0
        if n:
            yield from _sent(held, buckets, groups)

    return run


def _sent(held: list[tuple], buckets: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Anchors to their hash bucket. Of several equal ones, one goes there, marked; all of them are known to repeat and go straight on."""
    h, ids, pos = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(h, kind="stable")
    head = np.append(True, h[order][1:] != h[order][:-1])
    first = np.flatnonzero(head)
    many = np.diff(np.append(first, len(h))) > 1
    one = order[first]
    yield K.packed((h[one] >> K.U64(33)).astype(np.int64) % buckets, [h[one], ids[one], pos[one], many.astype(np.int8)])
    known = np.sort(order[np.repeat(many, np.diff(np.append(first, len(h))))])
    if len(known):
        yield K.packed(buckets + K.group_of(ids[known], groups) % buckets, [np.zeros(len(known), dtype=np.uint64), ids[known], pos[known], np.full(len(known), 2, dtype=np.int8)])


def _repeated(groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From hash buckets, the places of repeated anchors by document group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (h, ids, pos, mark) in K.by_bucket(batches, [np.uint64, np.int64, np.int32, np.int8]):
            again = mark == 2
            order = np.argsort(h, kind="stable")
            order = order[~again[order]]
            s = h[order]
            head = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, dtype=np.int64)
            size = np.diff(np.append(head, len(s)))
            again[order[np.repeat(size > 1, size) & (mark[order] == 0)]] = True
            at = np.flatnonzero(again)
            if len(at):
                yield K.packed(K.group_of(ids[at], groups), [ids[at], pos[at]])

    return run


def _places(table: pa.Table) -> dict[int, np.ndarray]:
    """Sorted distinct places by document."""
    ids = K.unplanes(table.column("c0").to_pylist(), np.int64)
    pos = K.unplanes(table.column("c1").to_pylist(), np.int32)
    order = np.lexsort((pos, ids))
    ids, pos = ids[order], pos[order]
    head = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else []
    return {int(ids[a]): np.unique(pos[a:b]) for a, b in zip(head, np.append(head[1:], len(ids)), strict=True)} if len(ids) else {}


def _windows(size: int, buckets: int, groups: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    period = period_of(size)

    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        places = _places(anchors)
        for batch in docs.combine_chunks().to_batches() if places else []:
            ids = batch.column("id").to_numpy()
            rows = [i for i, k in enumerate(ids.tolist()) if k in places]
            texts = K.texts_of(batch.column("txt"))
            picked = [texts[i] for i in rows]
            for a, b in K.slices(picked):
                w = K.Words(picked[a:b])
                marks = np.zeros(len(w) + period + 1, dtype=np.int32)
                for j in range(a, b):
                    p = places[int(ids[rows[j]])]
                    marks[w.first[j - a] + p[p < w.counts[j - a]]] = 1
                seen = np.concatenate(([0], np.cumsum(marks)))
                at = w.windows(size)
                at = at[seen[at + period] > seen[at]]
                if len(at):
                    out.append((K.rolled(w.hashes(), size)[at], (K.rolled(w.hashes(stream=1), size, 1)[at] >> K.U64(32)).astype(np.uint32), ids[rows][a:b][w.doc[at]], (at - w.first[w.doc[at]]).astype(np.int32)))
        if not out:
            return pa.Table.from_batches([], schema=_EMPTY)
        h, g, ids, pos = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((pos, ids, g, h))
        h, g, ids, pos = h[order], g[order], ids[order], pos[order]
        first = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))
        # an equal window of the same place comes from another row with this id and is no earlier one
        leader = np.flatnonzero(first)[np.cumsum(first) - 1]
        late = (ids != ids[leader]) | (pos != pos[leader])
        sent = [K.packed((h[first] >> K.U64(33)).astype(np.int64) % buckets, [h[first], g[first], ids[first], pos[first]])]
        if late.any():
            known = np.flatnonzero(late)
            sent.append(K.packed(buckets + K.group_of(ids[known], groups) % buckets, [np.zeros(len(known), dtype=np.uint64), np.zeros(len(known), dtype=np.uint32), ids[known], pos[known]]))
        return pa.Table.from_batches(sent)

    return run


_EMPTY = pa.schema([("bucket", pa.int32()), *((f"c{i}", pa.binary()) for i in range(4))])


def _later(buckets: int, groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From hash buckets, the starts of windows that are not the earliest; buckets from ``buckets`` on hold such starts already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (h, g, ids, pos) in K.by_bucket(batches, [np.uint64, np.uint32, np.int64, np.int32]):
            if bucket < buckets:
                order = np.lexsort((pos, ids, g, h))
                h, g, ids, pos = h[order], g[order], ids[order], pos[order]
                first = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))
                leader = np.flatnonzero(first)[np.cumsum(first) - 1]
                late = (ids != ids[leader]) | (pos != pos[leader])
                ids, pos = ids[late], pos[late]
            if len(ids):
                yield K.packed(K.group_of(ids, groups), [ids, pos])

    return run


def _kept(size: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, starts: pa.Table) -> pa.Table:
        places, out = _places(starts), []
        for batch in docs.combine_chunks().to_batches():
            ids = batch.column("id").to_numpy()
            texts = K.texts_of(batch.column("txt"))
            for a, b in K.slices(texts):
                w = K.Words(texts[a:b])
                edge = np.zeros(len(w) + 1, dtype=np.int64)
                for j, k in enumerate(ids[a:b].tolist()):
                    p = places.get(k)
                    if p is not None:
                        p = p[p + size <= w.counts[j]] + w.first[j]
                        edge[p] += 1
                        edge[p + size] -= 1
                keep = np.cumsum(edge[:-1]) == 0
                kept = np.concatenate(([0], np.cumsum(keep)))[w.first]
                n = np.diff(kept)
                joined = w.buf.copy()
                lens = (w.ends - w.starts + 1)[keep]
                joined[w.ends[keep]] = 0x20
                flat = joined[K.ragged(w.starts[keep], lens)].tobytes()
                cut = np.concatenate(([0], np.cumsum(lens)))[kept].tolist()
                text = [flat[x : max(x, y - 1)].decode() for x, y in zip(cut, cut[1:], strict=False)]
                out.append(pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(w.counts), pa.array(w.counts - n), pa.array(text, type=pa.string())], names=["id", "n_words", "n_removed", "kept"]))
        return pa.Table.from_batches(out, schema=pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    return run


def dedup(docs: DataFrame, size: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows (key, n_words, n_removed, kept): ``kept`` are the words that no earlier-starting window covers."""
    d = D.keyed(docs, key, text)
    parts = D.parts_for(d)
    buckets = groups = parts
    dealt = d.withColumn("bucket", D.group_of("id", groups)).repartition(parts, "bucket")
    collected = lambda x: x.repartition(parts, "bucket").sortWithinPartitions("bucket")
    anchors = collected(d.mapInArrow(_anchors(size, buckets, groups), _PACKED)).mapInArrow(_repeated(groups), K.packed_schema(2)).repartition(parts, "bucket")
    windows = dealt.groupBy("bucket").cogroup(anchors.groupBy("bucket")).applyInArrow(_windows(size, buckets, groups), _PACKED)
    starts = collected(windows).mapInArrow(_later(buckets, groups), K.packed_schema(2)).repartition(parts, "bucket")
    out = dealt.groupBy("bucket").cogroup(starts.groupBy("bucket")).applyInArrow(_kept(size), "id long, n_words long, n_removed long, kept string")
    return out.select(F.nullif(F.col("id"), F.lit(D.NO_ID)).alias(key), "n_words", "n_removed", "kept")
