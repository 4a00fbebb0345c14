"""Toxicity by the nearest labelled examples, with exact TF-IDF cosine over a block-max inverted index.

Method. The features of a text are its words (letters and digits, A-Z lowered)
and the first ``STEMS`` bytes of longer ones. The examples are a bounded sample of
labelled rows (``EXAMPLES`` of each label, by a hash of the id), and their features,
all of them, are the vocabulary; document frequencies are counted on all documents. A
feature of a text weighs (1 + ln count) * idf * relevance, and vectors have the
length 1. The relevance is how far a feature tells the labels apart: the absolute
log ratio of its shares among the examples of either label, with ``SHRINK`` examples
of neither mixed in; without it the common words of a language decide which texts
are near. The examples lie in an inverted index: for each feature its postings by
blocks of ``BLOCK`` examples, and the largest weight of each block. A text's blocks
are taken by their upper bound, largest first, until the bound is below the
``NEIGHBOURS``-th best cosine; the rest cannot hold a nearer example, so the
neighbours are exact. The ``COMMON`` features of the most examples are a dense table: what
they add is computed for all examples of 64 texts at once, and tightens the bounds. They vote by cosine, with the labelled rows' share as a prior.
A monotone fit makes the vote a probability: each example votes in an index whose
relevance and neighbours come from the other ``FOLDS`` - 1 parts of the examples, and
each label counts at its true share. The neighbours are returned as evidence.

STEMS and SHRINK were chosen by four-fold cross-validation on the training rows of
two tables; no held-out label was read for it.

Defined results: a null, empty or featureless text gets the score of a text
without votes; equal cosines are ordered by example; rows that repeat an id have
the largest of its labels; null labels are none; without examples of both labels
the score is the labelled share (0 without labels); texts are read whole;
repeated rows and null ids each return a row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm import _frames as D
from foldspark.llm import _kernel as K

#: Examples of each label, examples of a block, neighbours that vote, and the weight of the prior.
EXAMPLES, BLOCK, NEIGHBOURS, PRIOR = 1024, 64, 15, 0.5

#: Examples of neither label that a feature's relevance is mixed with, its least value, and the parts that calibrate.
SHRINK, LEAST, FOLDS = 16, 1e-3, 4

#: Features whose weights stand in a dense table, those of the most examples.
COMMON = 1024

#: First bytes of a longer word that are features of their own.
STEMS = (4, 6)


def features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, count, bounds): the sorted distinct features of each text, flat."""
    w = K.Words(texts)
    begin, h = w.solid()
    doc = w.doc[begin >= 0]
    h, begin, end = h[begin >= 0], begin[begin >= 0], w.ends[begin >= 0]
    values, owner, stem = [h], [doc], np.zeros(len(h), dtype=np.uint64)
    for i in range(max(STEMS)):
        b = w.buf[np.minimum(begin + i, len(w.buf) - 1)]
        stem = stem * K.U64(256) + np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint64)
        if i + 1 in STEMS:
            long = np.flatnonzero(end - begin > i + 1)
            values.append(K.mix(stem[long] ^ K.U64(0x5EED)))
            owner.append(doc[long])
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.argsort(values)
    order = order[np.argsort(owner[order].astype(np.uint16) if len(texts) <= 1 << 16 else owner[order], kind="stable")]
    v, o = values[order], owner[order]
    head = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (o[1:] != o[:-1]))) if len(v) else np.zeros(0, dtype=np.int64)
    bounds = np.searchsorted(o[head], np.arange(len(texts) + 1))
    return v[head], np.diff(np.append(head, len(v))), bounds


Example = tuple[int, int, np.ndarray, np.ndarray]


def relevance(vocabulary: np.ndarray, examples: list[Example]) -> np.ndarray:
    """How far each feature tells the examples' labels apart."""
    n = [sum(1 - y for _, y, _, _ in examples), sum(y for _, y, _, _ in examples)]
    if not all(n):
        return np.ones(len(vocabulary))
    seen = [np.bincount(np.searchsorted(vocabulary, np.concatenate([f for _, y, f, _ in examples if y == k])), minlength=len(vocabulary)) for k in (0, 1)]
    part = n[1] / (n[0] + n[1])
    return np.abs(np.log((seen[1] + SHRINK * part) / (seen[0] + SHRINK * (1 - part)) * (n[0] / n[1]))) + LEAST


class Index:
    """The features, their weights, and the examples by feature and block."""

    def __init__(self, vocabulary: np.ndarray, examples: list[Example], share: float, idf: np.ndarray) -> None:
        self.vocabulary, self.share = vocabulary, share
        self.weights = idf * relevance(vocabulary, examples)
        vectors = [self.vector(f, c) for _, _, f, c in examples]
        some = [i for i, (at, _) in enumerate(vectors) if len(at)]
        # examples with the same strongest feature lie together, so the blocks' bounds are tight
        some.sort(key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), i))
        self.ids = np.array([examples[i][0] for i in some], dtype=np.int64)
        self.labels = np.array([examples[i][1] for i in some], dtype=np.float64)
        self.blocks = -(-len(some) // BLOCK)
        f = np.concatenate([vectors[i][0] for i in some]) if some else np.zeros(0, dtype=np.int64)
        x = np.repeat(np.arange(len(some)), [len(vectors[i][0]) for i in some])
        w = np.concatenate([vectors[i][1] for i in some]) if some else np.zeros(0)
        held = np.bincount(f, minlength=len(vocabulary))
        common = np.argsort(-held, kind="stable")[:COMMON]
        self.slot = np.full(len(vocabulary), -1)
        self.slot[common] = np.arange(len(common))
        dense = self.slot[f]
        self.dense = np.zeros((len(common), self.blocks * BLOCK))
        self.dense[dense[dense >= 0], x[dense >= 0]] = w[dense >= 0]
        f, x, w = f[dense < 0], x[dense < 0], w[dense < 0]
        order = np.lexsort((x, f))
        f, x, w = f[order], x[order], w[order]
        # an entry is a feature and a block: its postings, and the largest weight among them
        head = np.flatnonzero(np.append(True, (f[1:] != f[:-1]) | (x[1:] // BLOCK != x[:-1] // BLOCK))) if len(f) else np.zeros(0, dtype=np.int64)
        self.example, self.weight = x.astype(np.int32), w
        self.start = np.append(head, len(f))
        self.block = (x[head] // BLOCK).astype(np.int32)
        self.top = np.maximum.reduceat(w, head) if len(f) else w
        self.first = np.searchsorted(f[head], np.arange(len(vocabulary) + 1))

    def vector(self, f: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature numbers, weights of length 1)."""
        if not len(self.vocabulary):
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        at = np.searchsorted(self.vocabulary, f)
        at[at == len(self.vocabulary)] = 0
        hit = self.vocabulary[at] == f
        at, w = at[hit], (1 + np.log(count[hit])) * self.weights[at[hit]]
        return at, w / max(1e-12, np.sqrt((w * w).sum()))

    def shared(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Per vector and example what the common features add to their cosine."""
        q = np.zeros((len(vectors), len(self.dense)))
        for i, (at, w) in enumerate(vectors):
            slot = self.slot[at]
            q[i, slot[slot >= 0]] = w[slot >= 0]
        return q @ self.dense

    def nearest(self, at: np.ndarray, w: np.ndarray, base: np.ndarray | None = None, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine over 0, and the cosines; ``base``: the vector's row of ``shared``."""
        if not len(at) or not self.blocks:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        base = (self.shared([(at, w)])[0] if base is None else base).reshape(self.blocks, BLOCK)
        rare = self.slot[at] < 0
        at, w = at[rare], w[rare]
        lens = self.first[at + 1] - self.first[at]
        entry, w = K.ragged(self.first[at], lens), np.repeat(w, lens)
        block = self.block[entry]
        # exact for the common features, the blocks' largest weights for the others
        bound = base.max(axis=1) + np.bincount(block, weights=w * self.top[entry], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        best, cosine, low, done, end = np.zeros(0, dtype=np.int64), np.zeros(0), 0.0, 0, 8
        place = np.full(self.blocks, -1)
        while done < len(order) and bound[order[done]] > 0 and (len(best) < k or bound[order[done]] >= low - 1e-9):
            taken = np.sort(order[done:end])
            place[:] = -1
            place[taken] = np.arange(len(taken))
            mine = np.flatnonzero(place[block] >= 0)
            begin = self.start[entry[mine]]
            size = self.start[entry[mine] + 1] - begin
            x = self.example[K.ragged(begin, size)]
            scores = np.bincount(place[x // BLOCK] * BLOCK + x % BLOCK, weights=np.repeat(w[mine], size) * self.weight[K.ragged(begin, size)], minlength=len(taken) * BLOCK) + base[taken].ravel()
            keep = np.flatnonzero(scores > 0)
            best, cosine = np.concatenate((best, taken[keep // BLOCK] * BLOCK + keep % BLOCK)), np.concatenate((cosine, scores[keep]))
            top = np.lexsort((self.ids[best], -np.round(cosine, 9)))[:k]
            best, cosine = best[top], cosine[top]
            low = cosine[-1] if len(cosine) == k else 0.0
            # the bounds are known: all blocks that may hold a nearer example are next, or more while there are too few
            done, end = end, int((bound >= low - 1e-9).sum()) if low else 2 * end
        return best, cosine

    def vote(self, best: np.ndarray, cosine: np.ndarray) -> float:
        return float(((cosine * self.labels[best]).sum() + PRIOR * self.share) / (cosine.sum() + PRIOR))

    def voted(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray]]:
        """The vote on each text's features and counts, and the ids of the nearest examples."""
        out = []
        for i in range(0, len(texts), 64):
            vectors = [self.vector(*t) for t in texts[i : i + 64]]
            for v, base in zip(vectors, self.shared(vectors), strict=True):
                best, cosine = self.nearest(*v, base)
                out.append((self.vote(best, cosine), self.ids[best[:3]]))
        return out


def rising(votes: list[float], labels: list[int], share: float) -> np.ndarray:
    """The knots (vote, probability) of the monotone fit (pool adjacent violators), each label at its true share."""
    toxic = max(1, sum(labels))
    clean = max(1, len(labels) - sum(labels))
    pools: list[list[float]] = []
    for v, y in sorted(zip(votes, labels, strict=True)):
        w = share / toxic if y else (1 - share) / clean
        if pools and pools[-1][3] == v:
            pools[-1][0] += w * y
            pools[-1][1] += w
        else:
            pools.append([w * y, w, v, v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a = pools.pop()
            pools[-1][0] += a[0]
            pools[-1][1] += a[1]
            pools[-1][3] = a[3]
    return np.array([x for p in pools for x in ((p[2], p[0] / p[1]), (p[3], p[0] / p[1]))]).reshape(-1, 2)


def calibrated(vocabulary: np.ndarray, examples: list[Example], share: float, idf: np.ndarray) -> np.ndarray:
    """The knots of ``rising``, from votes of examples that the index they ask doesn't hold."""
    if len({y for _, y, _, _ in examples}) < 2:
        return np.zeros((0, 2))
    votes, labels = [], []
    for part in range(FOLDS):
        # the labels are apart in the list of examples; each part has its share of both
        mine = [e for i, e in enumerate(examples) if i % FOLDS == part]
        index = Index(vocabulary, [e for i, e in enumerate(examples) if i % FOLDS != part], share, idf)
        votes += [v for v, _ in index.voted([(f, c) for _, _, f, c in mine])]
        labels += [y for _, y, _, _ in mine]
    return rising(votes, labels, share)


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(5)) == 0


def _examples(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int) -> tuple[list, float]:
    known = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).filter("id is not null and y is not null")
    known = known.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    share = known.agg(F.avg("y")).first()[0] or 0.0
    order = [F.xxhash64("id"), F.col("id")]
    sample = known.filter("y > 0").orderBy(*order).limit(most).unionByName(known.filter("y <= 0").orderBy(*order).limit(most))
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("txt")).join(F.broadcast(sample), "id").select("id", "y", "txt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = K.texts_of(batch.column(2))
            for a, b in K.slices(texts):
                f, c, bounds = features(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), K.lists(f.view(np.int64), np.diff(bounds), pa.int64()), K.lists(c.astype(np.int32), np.diff(bounds), pa.int32())], names=["id", "y", "f", "c"])

    found = rows.mapInArrow(run, "id long, y int, f array<long>, c array<int>").toArrow()
    # rows that repeat an id have one label and maybe several texts; the first by its features is the example
    out, seen = [], set()
    for r in sorted(found.to_pylist(), key=lambda r: (-r["y"], r["id"], r["f"])):
        if r["id"] not in seen:
            seen.add(r["id"])
            out.append((r["id"], int(r["y"] > 0), np.array(r["f"], dtype=np.int64).view(np.uint64), np.array(r["c"])))
    return out, float(share)


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = EXAMPLES) -> DataFrame:
    """The rows (key, held_out, score, predicted, neighbours, vote) of every document."""
    spark = docs.sparkSession
    D.small_batches(spark)
    rows, share = _examples(docs, labels, key, text, label, examples)
    words = np.unique(np.concatenate([f for _, _, f, _ in rows])) if rows else np.zeros(0, dtype=np.uint64)
    d = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("txt"))
    vocabulary = spark.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        df, n = np.zeros(len(v), dtype=np.int64), 0
        for batch in batches:
            texts = K.texts_of(batch.column(0))
            n += len(texts)
            for a, b in K.slices(texts) if len(v) else ():
                f, _, _ = features(texts[a:b])
                at = np.searchsorted(v, f)
                at[at == len(v)] = 0
                df += np.bincount(at[v[at] == f], minlength=len(v))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["f", "n"])

    found = d.select("txt").mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(words) + 1, dtype=np.int64)
    # the number of documents stands last
    df[found.column("f").to_numpy()] = found.column("n").to_numpy()
    idf = np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 1e-9
    held = spark.sparkContext.broadcast((Index(words, rows, share, idf), calibrated(words, rows, share, idf)))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, knots = held.value
        for batch in batches:
            texts = K.texts_of(batch.column(1))
            for a, b in K.slices(texts):
                f, c, bounds = features(texts[a:b])
                got = index.voted([(f[x:y], c[x:y]) for x, y in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)])
                votes = np.array([v for v, _ in got])
                scores = np.interp(votes, knots[:, 0], knots[:, 1]) if len(knots) else np.full(len(got), index.share)
                near = [n for _, n in got]
                flat = np.concatenate(near) if near else np.zeros(0, dtype=np.int64)
                columns = [batch.column(0).slice(a, b - a), pa.array(scores), K.lists(flat, np.array([len(n) for n in near]), pa.int64()), pa.array(votes)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "score", "neighbours", "vote"])

    out = d.mapInArrow(run, f"id {kind}, score double, neighbours array<long>, vote double")
    return out.select(F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "vote")
