"""Byte-level BPE encoding and decoding: batched numpy merge rounds.

Method. A text is cut at the special tokens and then into pieces by the
vocabulary's pattern. The distinct unseen pieces of a slice of documents lie as
byte symbols in one flat array. In each round a binary search over the sorted
keys (left id, right id) gives every adjacent pair its rank, a segmented minimum
gives each piece its lowest rank, and all pieces merge their lowest pair at once
(from the left where occurrences overlap). Pieces without a known pair are done.
As a merge that uses a token always ranks after the merge that made it, this
gives the same ids as merging one pair at a time.

A piece of more than ``LONG`` bytes would take a round for each of its many ranks
over its whole length. It goes rank by rank instead: a heap has the ranks that occur,
each with the places where it was seen; all its pairs merge in one numpy step, which
looks at their neighbours only. A place enters the heap when its pair is made, so the
time is about n log n.

Defined results: a null or empty text has no ids and decodes to ""; repeated
rows each get a row; special tokens' strings in a text become their ids, as the
library does; texts of any length are encoded whole; further columns of the
input are not read, whatever their names.

Memory: a worker keeps the ids of at most ``CACHE`` pieces; when that many are
held the table starts anew (that costs time, it changes no result).
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm import _kernel as K

#: Pieces whose ids a worker keeps, and bytes from which a piece is merged rank by rank.
CACHE, LONG = 400_000, 1024

#: The published splitting pattern of this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, by rule:
    visible Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(spare)] = b
            spare += 1
    return out


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file (JSON)."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        model, letters = data["model"], byte_letters()
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, dtype=np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = ids[letter]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([(ids[a] << 32) | ids[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        self.lens = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.lens)))
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(PATTERN)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The places among the sorted keys of pairs that merge, -1 for others."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one long piece."""
        sym = self.of_byte[np.frombuffer(word, dtype=np.uint8)]
        n = len(sym)
        after, before, live = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, dtype=bool)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def push(left: np.ndarray) -> None:
            """The pairs that begin at these symbols, by rank."""
            left = left[(left >= 0) & live[np.maximum(left, 0)]]
            left = left[after[left] < n]
            at = self._ranks(sym[left], sym[after[left]])
            left, at = left[at >= 0], at[at >= 0]
            if not len(left):
                return
            rank = self.ranks[at]
            order = np.argsort(rank, kind="stable")
            left, rank = left[order], rank[order]
            head = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
            for r, part in zip(rank[head].tolist(), np.split(left, head[1:]), strict=True):
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                places[r].append(part)

        push(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            left = np.unique(np.concatenate(places.pop(r)))
            left = left[live[left]]
            left = left[after[left] < n]
            at = self._ranks(sym[left], sym[after[left]])
            # a pair that a merge has changed meanwhile is gone
            left = left[(at >= 0) & (self.ranks[at] == r)]
            if not len(left):
                continue
            # of a chain of overlapping occurrences, every second one from the left
            chain = np.append(True, after[left[:-1]] != left[1:])
            begin = np.maximum.accumulate(np.where(chain, np.arange(len(left)), 0))
            left = left[(np.arange(len(left)) - begin) % 2 == 0]
            right = after[left]
            sym[left] = self.made[r]
            live[right] = False
            after[left] = after[right]
            inner = after[left] < n
            before[after[left[inner]]] = left[inner]
            push(np.unique(np.concatenate((left, before[left]))))
        return sym[live]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and number of ids of each word."""
        long = {i: self.merge_long(w) for i, w in enumerate(words) if len(w) > LONG}
        if not long:
            return self._merge_short(words)
        flat, counts = self._merge_short([w for i, w in enumerate(words) if i not in long])
        parts, ends, k = [], np.concatenate(([0], np.cumsum(counts))), 0
        for i in range(len(words)):
            if i in long:
                parts.append(long[i])
            else:
                parts.append(flat[ends[k] : ends[k + 1]])
                k += 1
        return np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)

    def _merge_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same, in rounds over all words at once."""
        lens = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
        sym = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        done_sym, done_word = [], []
        while len(sym):
            same = word[1:] == word[:-1]
            key = (sym[:-1] << 32) | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(same & (self.keys[at] == key), self.ranks[at], _NONE)
            rank = np.append(rank, _NONE)
            head = np.flatnonzero(np.append(True, ~same))
            least = np.minimum.reduceat(rank, head)
            size = np.diff(np.append(head, len(sym)))
            open_ = np.repeat(least != _NONE, size)
            if not open_.all():
                done_sym.append(sym[~open_])
                done_word.append(word[~open_])
                rank, sym, word = rank[open_], sym[open_], word[open_]
                size, least = size[least != _NONE], least[least != _NONE]
                if not len(sym):
                    break
            hit = rank == np.repeat(least, size)
            at = np.flatnonzero(hit)
            # of a chain of overlapping occurrences (a a a), every second one from the left
            chain = np.append(True, np.diff(at) != 1)
            begin = np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return sym, np.zeros(len(words), dtype=np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that are no UTF-8 become U+FFFD, as the library does."""
        lens = self.lens[ids]
        flat = self.flat[K.ragged(self.at[ids], lens)].tobytes()
        ends = np.concatenate(([0], np.cumsum(lens)))[np.concatenate(([0], np.cumsum(counts)))]
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


def _roomy(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with room for ``n`` values at least."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), dtype=a.dtype)
    out[: len(a)] = a
    return out


class Encoder:
    """A vocabulary with the ids of the pieces seen so far."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        # arrays with room at their ends: what is added is copied once or twice in all
        self.lens, self.at = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.flat, self.used = np.zeros(4096, dtype=np.int64), 0
        for token, i in self.v.special.items():
            self._add([token], np.array([i]), np.array([1]))

    def _add(self, words: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        n, used = len(self.index), self.used
        self.index.update(zip(words, range(n, n + len(words)), strict=True))
        self.at, self.lens = (_roomy(a, n + len(words)) for a in (self.at, self.lens))
        self.flat = _roomy(self.flat, used + len(ids))
        self.at[n : n + len(words)] = used + np.cumsum(lens) - lens
        self.lens[n : n + len(words)] = lens
        self.flat[used : used + len(ids)] = ids
        self.used = used + len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and number of ids of each text."""
        if len(self.index) > CACHE:
            self.clear()
        find, split = self.v.pieces.findall, self.v.split
        per, every = [], []
        for text in texts:
            n = len(every)
            if split is not None and split.search(text):
                for k, part in enumerate(split.split(text)):
                    every += [part] if k % 2 else find(part)
            else:
                every += find(text)
            per.append(len(every) - n)
        # a special token's string can only stand here as a whole special token: the texts were cut at them
        new = list(set(every).difference(self.index))
        for a in range(0, len(new), 50_000):
            part = new[a : a + 50_000]
            self._add(part, *self.v.merge([w.encode() for w in part]))
        which = np.fromiter(map(self.index.__getitem__, every), dtype=np.int64, count=len(every))
        lens = self.lens[which]
        ids = self.flat[K.ragged(self.at[which], lens)]
        total = np.concatenate(([0], np.cumsum(lens)))
        bounds = np.concatenate(([0], np.cumsum(per, dtype=np.int64)))
        return ids, np.diff(total[bounds])


_ENCODERS: dict[int, Encoder] = {}


def _encoder(held) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if held.id not in _ENCODERS:
        _ENCODERS[held.id] = Encoder(Vocabulary(held.spec.value))
    return _ENCODERS[held.id]


class _Held:
    """A broadcast vocabulary file (a few MB, checked) and its key."""

    def __init__(self, spark, path: str, most_bytes: int = 64 << 20) -> None:
        with open(path, encoding="utf-8") as f:
            spec = f.read(most_bytes + 1)
        if len(spec) > most_bytes:
            raise ValueError(f"{path} has more than {most_bytes} bytes; that is no vocabulary to broadcast")
        self.spec, self.id = spark.sparkContext.broadcast(spec), hash(spec)


def _numbered(df: DataFrame, key: str, other: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{other}`").alias("value"))


def encode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", decode_too: bool = False) -> DataFrame:
    """The rows (key, ids) of the texts' token ids; with ``decode_too`` also ``decoded``, made from those ids."""
    held = _Held(df.sparkSession, vocabulary)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held)
        for batch in batches:
            sized = K.texts_of(batch.column(1))
            for a, b in K.slices(sized):
                texts = batch.column(1).slice(a, b - a).fill_null("").to_pylist()
                ids, counts = encoder.encode(texts)
                columns = [batch.column(0).slice(a, b - a), K.lists(ids.astype(np.int32), counts, pa.int32())]
                if decode_too:
                    columns.append(pa.array(encoder.v.decoded(ids, counts), type=pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "decoded"][: len(columns)])

    out = _numbered(df, key, text).mapInArrow(run, f"key {kind}, ids array<int>" + ", decoded string" * decode_too)
    return out.withColumnRenamed("key", key)


def decode(df: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The rows (key, decoded) of the ids' texts; a null list decodes to ""."""
    held = _Held(df.sparkSession, vocabulary)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _encoder(held).v
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                column = part.column(1)
                counts = np.fromiter((0 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()), dtype=np.int64, count=part.num_rows)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(v.decoded(flat, counts), type=pa.string())], names=["key", "decoded"])

    out = _numbered(df, key, ids).mapInArrow(run, f"key {kind}, decoded string")
    return out.withColumnRenamed("key", key)


def round_trip(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_tokens, and the SHA-256 of its ids (decimal, joined by commas) and of the decoded text."""
    coded = encode(docs, vocabulary, key, text, decode_too=True)
    return coded.select(
        F.col(key),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
