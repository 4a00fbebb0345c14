"""Benchmark decontamination by template windows and slot consistency.

Method. A word becomes its letters and digits, A-Z lowered; numbers, units after
a number, and names (capitalised inside a sentence) become typed placeholders.
The hashes of ``WINDOW`` such tokens in a row, at least half of them no
placeholders, are looked up in the benchmark's; windows with about half
placeholders or more by their literal words, too. Hits of one item on one
diagonal join to segments, and segments of any diagonals chain in the order of
both texts while the slots are consistent: a value of the item must stand for one
value of the document wherever it occurs. An item of whose tokens a chain covers
the part ``COVER`` or more is a leak, whether its numbers and names were changed
or not, and so is one of which ``RUN`` tokens or more stand word for word. Of hits only
those that begin a segment are kept, and followed along their diagonal; a chain that
another one beats in every respect is dropped. So repeated words, whose hits are as many
as the document's times the item's, need little memory and no loop over all hits.

The documents are read once and not shuffled. The benchmark's windows are
broadcast in blocks of items of at most ``BLOCK_BYTES`` of text, one pass over
the documents for each block; each item is whole in its block, so blocks change
no result.

Defined results: null, empty or wordless texts and items leak nothing; items of
3 to 7 tokens must stand whole, shorter ones are no evidence and never match;
equal items each match; repeated rows each give rows; documents of any length
are read whole; ``clean`` keeps every column, whatever its name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm import _kernel as K

WINDOW, LEAST, COVER, RUN = 8, 3, 0.5, 32

#: Benchmark text that is broadcast at once.
BLOCK_BYTES = 32 << 20

#: Units of measure that count after a number.
UNITS = """mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons tonne tonnes ounce ounces pound pounds ml l liter liters litre litres
gallon gallons ms second seconds minute minutes hour hours day days week weeks month months year years percent degree degrees celsius fahrenheit kelvin
mph kmh watt watts kw volt volts amp amps hz khz mhz ghz byte bytes kb mb gb tb dollar dollars cent cents euro euros usd eur gbp""".split()

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[48:58] = 1
_KIND[65:91] = 2
_KIND[97:123] = 3
_KIND[128:] = 4
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?:"]] = True

_MARK = {"number": np.uint64(0x1111_2222_3333_4444), "unit": np.uint64(0x5555_6666_7777_8888), "name": np.uint64(0x9999_AAAA_BBBB_CCCC)}


class Tokens:
    """Canonical tokens of consecutive documents: hash, whether it is a slot, its word, first token of each document."""

    def __init__(self, texts: list) -> None:
        w = self.words = K.Words(texts)
        kind = _KIND[w.buf]
        begin, h = w.solid()
        real = begin >= 0
        self.word = np.flatnonzero(real)
        begin, h, doc = begin[real], h[real], w.doc[real]
        self.first = np.searchsorted(doc, np.arange(len(texts) + 1))
        self.begin, self.end = begin, w.ends[real]
        number = kind[begin] == 1
        after = np.append(False, doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, dtype=bool)
        before = np.append(False, number[:-1]) if len(doc) else after
        unit = np.isin(h, _UNITS) & before & after if _UNITS is not None else np.zeros(len(h), dtype=bool)
        ended = np.append(True, _ENDS[w.buf[self.end[:-1] - 1]]) if len(doc) else after
        name = (kind[begin] == 2) & (kind[np.minimum(begin + 1, len(kind) - 1)] >= 3) & after & ~ended
        self.literal = h.copy()
        h[number], h[unit], h[name] = _MARK["number"], _MARK["unit"], _MARK["name"]
        self.hash, self.slot, self.doc = h, number | unit | name, doc
        # capitalised first words: inside another text they look like names
        self.maybe = np.flatnonzero(~after & (kind[begin] == 2) & (kind[np.minimum(begin + 1, len(kind) - 1)] >= 3)) if len(doc) else np.zeros(0, dtype=np.int64)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start tokens of the windows with at least half plain tokens, and their hashes."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        slots = np.concatenate(([0], np.cumsum(self.slot)))
        at = np.flatnonzero((self.doc[:n] == self.doc[size - 1 :]) & (2 * (slots[size:] - slots[:n]) <= size))
        return at, K.rolled(self.hash, size)[at] ^ K.mix(np.full(1, size, dtype=np.uint64))

    def literals(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start tokens of the windows with about half slots or more (a first word may be a name elsewhere), and the hashes of their words."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        slots = np.concatenate(([0], np.cumsum(self.slot)))
        at = np.flatnonzero((self.doc[:n] == self.doc[size - 1 :]) & (2 * (slots[size:] - slots[:n] + 1) > size))
        return at, K.rolled(self.literal, size)[at] ^ K.mix(np.full(1, size + (1 << 32), dtype=np.uint64))

    def value(self, token: int) -> bytes:
        return bytes(self.words.buf[self.begin[token] : self.end[token]]).strip(b".,;:!?()[]{}\"'").lower()


_UNITS: np.ndarray | None = None
_UNITS = Tokens([u.encode() for u in UNITS]).hash.copy()


class Block:
    """Windows of some benchmark items, sorted by hash."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.ids = [k for k, _ in items]
        self.tokens = t = Tokens([x for _, x in items])
        n = np.diff(t.first)
        self.sizes = sorted({int(x) for x in n if LEAST <= x < WINDOW} | ({WINDOW} if (n >= WINDOW).any() else set()))
        h, at, tables = [], [], []

        def add(start: np.ndarray, hashes: np.ndarray, mine: np.ndarray, size: int, literal: bool) -> None:
            h.append(hashes[mine])
            at.append(start[mine])
            tables.append((hashes[mine], start[mine], size, literal))

        for size in self.sizes:
            for literal, (start, hashes) in enumerate((t.windows(size), t.literals(size))):
                add(start, hashes, np.minimum(n[t.doc[start]], WINDOW) == size, size, bool(literal))
            plain, t.hash = t.hash, t.hash.copy()
            t.hash[t.maybe] = _MARK["name"]
            start, hashes = t.windows(size)
            add(start, hashes, (np.minimum(n[t.doc[start]], WINDOW) == size) & np.isin(start, t.maybe), size, False)
            t.hash = plain
        h, at = (np.concatenate(h), np.concatenate(at)) if h else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        order = np.argsort(h, kind="stable")
        self.hash, self.at = h[order], at[order]
        # the hash at each token and table (by size and kind), 0 where that table has no window
        self.dense: list[tuple[int, bool, np.ndarray]] = []
        for x, y, size, literal in tables:
            d = np.zeros(len(t.hash), dtype=np.uint64)
            d[y] = x
            self.dense.append((size, literal, d))

    def leaks(self, texts: list) -> Iterator[tuple[int, int, float, int, int]]:
        """(document, item, part of the item's tokens, slots, slots with other values)."""
        if not len(self.hash):
            return
        t = Tokens(texts)
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        for a, i, k in self._segments(t):
            found[int(t.doc[a]), int(self.tokens.doc[i])].append((a, i, k))
        for (doc, item), segments in sorted(found.items()):
            best = self._best(t, item, segments)
            if best is not None:
                yield doc, item, *best

    def _segments(self, t: Tokens, most: int = 1 << 20) -> Iterator[tuple[int, int, int]]:
        """(start in the documents, start in the items, tokens) of the longest runs of hits of one table on one diagonal."""
        for size in self.sizes:
            for literal, (start, h) in enumerate((t.windows(size), t.literals(size))):
                low, high = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
                hit = np.flatnonzero(high > low)
                mine = np.zeros(len(t.hash) + 1, dtype=np.uint64)
                mine[start[hit]] = h[hit]
                for of_size, of_literal, theirs in self.dense:
                    if of_size != size or of_literal != bool(literal):
                        continue
                    theirs = np.append(theirs, np.uint64(0))
                    # at the tokens' ends, and between documents or items, no window of the one before goes on
                    total = np.cumsum(high[hit] - low[hit])
                    for part in np.split(np.arange(len(hit)), np.searchsorted(total, np.arange(most, int(total[-1]) if len(total) else 0, most))):
                        n = (high - low)[hit[part]]
                        a, i = np.repeat(start[hit[part]], n), self.at[K.ragged(low[hit[part]], n)]
                        same = (mine[a] == theirs[i])
                        goes_on = (a > 0) & (i > 0) & (mine[a - 1] == theirs[i - 1]) & (mine[a - 1] != 0)
                        goes_on &= (t.doc[a - 1] == t.doc[a]) & (self.tokens.doc[i - 1] == self.tokens.doc[i])
                        a, i = a[same & ~goes_on], i[same & ~goes_on]
                        k, open_, step = np.full(len(a), size), np.arange(len(a)), 1
                        while len(open_):
                            x, y = np.minimum(a[open_] + step, len(t.hash)), np.minimum(i[open_] + step, len(theirs) - 1)
                            more = (mine[x] == theirs[y]) & (mine[x] != 0)
                            more[more] &= (t.doc[x[more]] == t.doc[a[open_[more]]]) & (self.tokens.doc[y[more]] == self.tokens.doc[i[open_[more]]])
                            open_ = open_[more]
                            k[open_] += 1
                            step += 1
                        yield from zip(a.tolist(), i.tolist(), k.tolist(), strict=True)

    def _best(self, t: Tokens, item: int, found: list[tuple[int, int, int]]) -> tuple[float, int, int] | None:
        """The chain that covers the largest part of the item, if that or an exact run makes it a leak."""
        n = int(self.tokens.first[item + 1] - self.tokens.first[item])
        found.sort(key=lambda p: (p[0] - p[1], p[0]))
        # runs of a diagonal that touch or overlap, of any table, as [start in the document, start in the item, tokens]
        segments: list[list[int]] = []
        for a, i, k in found:
            last = segments[-1] if segments else None
            if last and a - i == last[0] - last[1] and a <= last[0] + last[2]:
                last[2] = max(last[2], a + k - last[0])
            else:
                segments.append([a, i, k])
        segments.sort()
        exact = max((self._exact(t, *x) for x in segments if x[2] >= RUN), default=0)
        # each chain: (tokens, end in the document, end in the item, what values stand for, slots, changed slots)
        chains: list[tuple[int, int, int, dict, frozenset, frozenset]] = []
        best = None
        for a, i, k in segments:
            own = None
            for c in [(0, a, i, {}, frozenset(), frozenset()), *chains]:
                over = max(0, c[1] - a, c[2] - i)
                if over >= k or a + over - c[1] > n or own and c[0] + k - over <= own[0]:
                    continue
                slots = self._slots(t, a + over, i + over, k - over, c[3])
                if slots is not None:
                    stands, places, changed = slots
                    own = c[0] + k - over, a + k, i + k, stands, c[4] | places, c[5] | changed
            if own is None:
                continue
            if best is None or own[0] > best[0]:
                best = own
                if own[0] == n:
                    break
            # only what ends less than an item's length ago can go on, and what no other chain beats in all respects
            chains = [c for c in chains if a - c[1] <= n]
            if not any(_beats(c, own) for c in chains):
                chains = [c for c in chains if not _beats(own, c)] + [own]
        if best is not None and best[0] >= COVER * n:
            return best[0] / n, len(best[4]), len(best[5])
        return (exact / n, 0, 0) if exact >= RUN else None

    def _exact(self, t: Tokens, a: int, i: int, k: int) -> int:
        """The longest run of equal words of a segment."""
        other = np.flatnonzero(t.literal[a : a + k] != self.tokens.literal[i : i + k])
        return int(np.diff(np.concatenate(([-1], other, [k]))).max()) - 1

    def _slots(self, t: Tokens, a: int, i: int, k: int, stands: dict) -> tuple[dict, frozenset, frozenset] | None:
        """``stands`` with the slots of a segment, and the places of those in the item; none if a value stands for two."""
        stands, places, changed = dict(stands), set(), set()
        for o in np.flatnonzero(t.slot[a : a + k]).tolist():
            x, y = self.tokens.value(i + o), t.value(a + o)
            if stands.setdefault(x, y) != y:
                return None
            places.add(i + o)
            if x != y:
                changed.add(i + o)
        return stands, frozenset(places), frozenset(changed)


def _beats(c: tuple, other: tuple) -> bool:
    """Whether a chain has as many tokens, ends as early in both texts and binds no value that the other leaves free."""
    return c[0] >= other[0] and c[1] <= other[1] and c[2] <= other[2] and c[3].items() <= other[3].items()


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[Block]:
    rows, n = [], 0
    for r in benchmark.select(F.col(f"`{item}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t")).filter("t is not null").toLocalIterator():
        rows.append((r.k, r.t.encode()))
        n += len(rows[-1][1])
        if n >= BLOCK_BYTES:
            yield Block(rows)
            rows, n = [], 0
    if rows:
        yield Block(rows)


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows (key, item_id, cover, n_slots, n_changed) of every document and item that leaks in it."""
    spark = docs.sparkSession
    schema = f"{key} long, {item} long, cover double, n_slots long, n_changed long"
    d = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("txt"))
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, item, item_text):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            b = held.value
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), K.texts_of(batch.column(1))
                for x, y in K.slices(texts):
                    rows = [(ids[x + doc], b.ids[i], *rest) for doc, i, *rest in b.leaks(texts[x:y])]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()], strict=True)], names=[key, item, "cover", "n_slots", "n_changed"])

        out = out.unionByName(d.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the documents in which an item leaks."""
    at, out = docs.columns.index(text), docs
    for block in _blocks(benchmark, item, item_text):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = K.texts_of(batch.column(at))
                keep = np.ones(len(texts), dtype=bool)
                for x, y in K.slices(texts):
                    for doc, *_ in held.value.leaks(texts[x:y]):
                        keep[x + doc] = False
                yield batch if keep.all() else batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
