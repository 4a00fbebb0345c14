"""Exact Jaccard self-join of word n-gram sets, by universe partition and the pigeonhole principle.

Method. Sizes fall into bands, so that linked sets lie in one band or in two
neighbouring ones. For a band the token universe is hashed into segments: a
wide one counts as two units, a narrow one as one. Two sets that link differ in
at most H tokens, so whatever segments of together H + 1 units are looked at,
in one of them the sets are equal, or (in a wide one) differ by one token. A set
indexes the subset of its tokens in each segment of its band, and in wide ones
also every subset with one token deleted; the larger set of a pair looks up
segments of H + 1 units, in its band and in the one below. Which mix of wide and
narrow segments a band has, and how many units are spare, is chosen by a cost
model (``layout``); which segments a set leaves out is chosen by cost, too:
those with the fewest tokens, as their lists are the longest.

Groups stay small whatever the copies are. Equal sets of a task send one set's
subsets; of the sets of a task that share a subset one delegate goes to the
hash bucket; candidates are stars around one set for each subset, never all
pairs. Candidates are verified exactly on whole texts (the centre's text goes to
the groups of documents that hold its partners, once each). What a star can
miss, pairs of partners that share a subset but whose links to the centre
failed, is settled afterwards: subsets whose members all lie in one component
are done; of the others' pairs of different components those are verified, too,
whose token histograms leave a link possible (the histograms' distance is at
most the number of tokens in which two sets differ, so this loses none). A subset of
more than ``MEMBERS`` members falls into blocks, and pairs of blocks are dealt over the
tasks. So no link between different components is lost.

Defined results: A-Z count as a-z; fewer words than n are one token, their whole
sequence; a null, empty or blank text has no tokens and links with nothing; rows
that share an id are one document, linked by any of its rows, and each row
returns; a null id is one document of its own that sorts last; other columns
are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm import _frames as D
from foldspark.llm import _graph
from foldspark.llm import _kernel as K

#: Subsets that a task holds before it packs and sends them.
FLUSH = 400_000

#: The integer that stands for a null id.
LAST = (1 << 63) - 1

#: Flags of a subset: it is in the index; it looks others up; a token is deleted; it stands for several sets of its task.
INDEX, LOOK, CUT, MANY = 1, 2, 4, 8

#: Counts in a set's histogram, and members of a subset whose pairs one task compares.
BINS, MEMBERS = 256, 2000

_SALT = K.mix(np.arange(1, 4, dtype=np.uint64))


class Rule:
    """Sets link when den * intersection >= num * union."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        tops = [1]
        while tops[-1] < 1 << 31:
            tops.append(max(tops[-1] + 1, tops[-1] * den // num))
        self.tops = np.array(tops, dtype=np.int64)
        plans = [layout(t, self.apart(t + max(t + 1, t * den // num)), num / den) for t in tops]
        self.wide, self.units = (np.array(x, dtype=np.int64) for x in zip(*plans, strict=True))

    def apart(self, sizes):
        """The most tokens in which two linked sets of together ``sizes`` tokens differ."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tops, sizes)


@functools.cache
def layout(top: int, apart: int, share: float) -> tuple[int, int]:
    """(wide segments, units) for a band of sets of up to ``top`` tokens that differ in ``apart`` tokens at most.

    Cost of a set: its subsets to index and look up, and for each segment without a token
    to look up (many sets share it) that no spare unit allows it to leave out, 200 more.
    """
    best = None
    for spare in (0.0, 0.08, 0.16, 0.24):
        units = apart + 1 + math.ceil(spare * (apart + 1))
        per = max(1e-9, top * (1 + share) / 2 / units)
        for part in (0.0, 0.25, 0.5, 0.75, 1.0):
            wide = min(units // 2, round(part * units / 2))
            narrow = units - 2 * wide
            poor = narrow * math.exp(-per) + 2 * wide * math.exp(-2 * per) * (1 + 2 * per)
            forced = max(0.0, poor + 3 * math.sqrt(poor) - (units - apart - 1))
            cost = 1.8 * (narrow + wide * (1 + 2 * per)) + 200 * forced
            if best is None or cost < best[0]:
                best = cost, wide, units
    return best[1], best[2]


def token_sets(w: K.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-gram hashes of each document, flat, and the documents' bounds."""
    h, counts = w.hashes(lower=True), w.counts
    short = np.flatnonzero((counts > 0) & (counts < n))
    whole = np.zeros(len(short), dtype=np.uint64)
    for i, d in enumerate(short.tolist()):
        a, b = w.first[d], w.first[d + 1]
        whole[i] = K.rolled(h[a:b], int(b - a))[0] ^ K.U64(b - a)
    at = w.windows(n)
    values = np.concatenate((K.rolled(h, n)[at], whole))
    doc = np.concatenate((w.doc[at], short))
    order = np.argsort(doc, kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(counts)))))
    return K.distinct(values[order], first)


def _subsets(tokens: np.ndarray, first: np.ndarray, band: np.ndarray, need: np.ndarray, rule: Rule, index: bool) -> tuple[np.ndarray, ...]:
    """(signature, set, flags) of the subsets that each set indexes and looks up in its segments of ``band``."""
    units, wide = rule.units[band], rule.wide[band]
    owner = np.repeat(np.arange(len(band)), np.diff(first))
    unit = ((tokens >> K.U64(32)) * units[owner].astype(np.uint64) >> K.U64(32)).astype(np.int64)
    segment = np.where(unit < 2 * wide[owner], unit // 2, unit - wide[owner])
    n = units - wide
    base = np.concatenate(([0], np.cumsum(n)))
    slot = base[owner] + segment
    values = K.mix(tokens ^ _SALT[0])
    count = np.bincount(slot, minlength=base[-1])
    total = K.sums(values, slot, base[-1])
    of = np.repeat(np.arange(len(band)), n)
    place = np.arange(base[-1]) - base[of]
    salt = K.mix((band[of].astype(np.uint64) << K.U64(40)) + place.astype(np.uint64) + _SALT[1])
    is_wide = place < wide[of]
    # the segments with the most tokens have the shortest lists; a wide one may lose a token
    rank = np.lexsort((place, -(count - is_wide), of))
    weight = np.where(is_wide, 2, 1)[rank]
    before = np.cumsum(weight) - weight
    before -= before[base[:-1]][of]
    look = np.zeros(base[-1], dtype=bool)
    look[rank] = before < need[of]
    flags = np.where(look, LOOK, 0) | (INDEX if index else 0)
    sent = np.flatnonzero(flags)
    out = [(K.mix(total[sent] + salt[sent]), of[sent], flags[sent])]
    cut = np.flatnonzero(is_wide[slot] & (flags[slot] > 0))
    if len(cut):
        s = slot[cut]
        out.append((K.mix(total[s] - values[cut] + salt[s]), of[s], flags[s] | CUT))
    sig, who, f = (np.concatenate(x) for x in zip(*out, strict=True))
    return sig, who, f.astype(np.int8)


def _send(n: int, rule: Rule, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Subsets to hash buckets; sizes, sure links, stars and groups of the task to the buckets from ``buckets`` on."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        sig, ids, flags = (np.concatenate(x) for x in zip(*held, strict=True))
        at, head, size = _shared(sig)
        none = np.zeros(len(sig), dtype=np.int64)
        sent = np.ones(len(sig), dtype=bool)
        if len(at):
            group = np.repeat(np.arange(len(head)), size)
            merged, cut = np.bitwise_or.reduceat(flags[at], head), np.bitwise_and.reduceat(flags[at], head) & CUT
            # one set stands for those that hold the subset whole, if one of them looks it up
            many = (merged & LOOK > 0) & (cut == 0)
            pick = at[_picked(sig[at], ids[at], head, group)]
            sent[at[many[group]]] = False
            sent[pick[many]] = True
            flags = flags.copy()
            flags[pick[many]] = merged[many] & ~CUT | MANY
            member = many[group]
            yield _passed(3, buckets, sig[at[member]], ids[at[member]], ids[pick][group[member]])
        out = K.packed((sig[sent] >> K.U64(33)).astype(np.int64) % buckets, [sig[sent], ids[sent], flags[sent], none[sent]])
        yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(out.num_rows, pa.binary())], names=[*out.schema.names, "c4"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        waiting = 0
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            texts, every = K.texts_of(batch.column(1)), batch.column(0).to_numpy()
            for a, b in K.slices(texts):
                tokens, first = token_sets(K.Words(texts[a:b]), n)
                ids, sizes = every[a:b], np.diff(first)
                yield _passed(0, buckets, np.zeros(len(ids), dtype=np.uint64), ids, sizes, _histograms(tokens, first))
                some = np.flatnonzero(sizes)
                sums = np.add.reduceat(K.mix(tokens), first[some]) if len(some) else np.zeros(0, dtype=np.uint64)
                more = np.add.reduceat(K.mix(tokens ^ _SALT[2]), first[some]) if len(some) else sums
                fresh, copies = [], []
                for k, i, x, y in zip(some.tolist(), ids[some].tolist(), sums.tolist(), more.tolist(), strict=True):
                    if (was := seen.setdefault((x, y), i)) != i:
                        copies.append((i, was))
                    elif not fresh or fresh[-1] != k:
                        fresh.append(k)
                if copies:
                    c = np.array(copies, dtype=np.int64)
                    yield _passed(1, buckets, np.zeros(len(c), dtype=np.uint64), c[:, 0], c[:, 1])
                if not fresh:
                    continue
                f = np.array(fresh)
                tokens, sizes, ids = tokens[K.ragged(first[f], sizes[f])], sizes[f], ids[f]
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                band = rule.band(sizes)
                sig, who, flags = _subsets(tokens, bounds, band, rule.apart(2 * sizes) + 1, rule, True)
                held.append((sig, ids[who], flags))
                waiting += len(sig)
                low = np.flatnonzero((band > 0) & (rule.tops[np.maximum(band - 1, 0)] * rule.den >= sizes * rule.num))
                if len(low):
                    part = K.ragged(bounds[low], sizes[low])
                    sig, who, flags = _subsets(tokens[part], np.concatenate(([0], np.cumsum(sizes[low]))), band[low] - 1, rule.apart(sizes[low] + rule.tops[band[low] - 1]) + 1, rule, False)
                    held.append((sig, ids[low][who], flags))
                    waiting += len(sig)
                if waiting >= FLUSH:
                    yield from flush(held)
                    held, waiting = [], 0
        if waiting:
            yield from flush(held)

    return run


def _shared(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the signatures that stand several times, group by group, and the groups' heads and sizes."""
    order = np.argsort(sig)
    s = sig[order]
    same = s[1:] == s[:-1]
    member = np.append(False, same) | np.append(same, False)
    at, s = order[member], s[member]
    head = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, dtype=np.int64)
    return at, head, np.diff(np.append(head, len(s)))


def _picked(sig: np.ndarray, ids: np.ndarray, head: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The centre of each group, by one of two hashes of the ids: the groups of like sets have few centres between them."""
    rank = K.mix(ids.view(np.uint64) ^ K.mix(sig & K.U64(1)))
    best = np.minimum.reduceat(rank, head)
    is_best = np.flatnonzero(rank == best[group])
    first = np.append(True, np.diff(group[is_best]) != 0)
    return is_best[first]


def _histograms(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per set the number of its tokens in each of BINS bins, up to 255, as one value of BINS bytes."""
    n = len(first) - 1
    at = np.repeat(np.arange(n), np.diff(first)) * BINS + (tokens & K.U64(BINS - 1)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=n * BINS), 255).astype(np.uint8).view(f"V{BINS}")


def _passed(kind: int, buckets: int, sig: np.ndarray, a: np.ndarray, b: np.ndarray, more: np.ndarray | None = None) -> pa.RecordBatch:
    more = np.zeros(0, dtype=f"V{BINS}") if more is None else more
    to = buckets + np.mod(K.spark_xxhash64(a), buckets)
    sent = K.packed(to, [sig, a, np.full(len(a), 16 + kind, dtype=np.int8), b.astype(np.int64)])
    blobs = K.packed(to, [more]).column(1) if len(more) else pa.nulls(sent.num_rows, pa.binary())
    return pa.RecordBatch.from_arrays([*sent.columns, blobs], names=[*sent.schema.names, "c4"])


_FOUND = "kind tinyint, sig long, a long, b long, h binary"


def _found(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (kind, sig, a, b): 0 the size b of a; 1 a and b have equal sets; 3 a shares the subset sig with the star's centre b."""

    def rows(kind: np.ndarray, sig: np.ndarray, a: np.ndarray, b: np.ndarray, more: np.ndarray | None = None) -> pa.RecordBatch:
        h = pa.nulls(len(a), pa.binary())
        if more is not None and len(more):
            at = iter(more)
            h = pa.array([next(at).tobytes() if k == 0 else None for k in kind.tolist()], type=pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int8)), pa.array(sig.view(np.int64)), pa.array(a), pa.array(b), h], names=["kind", "sig", "a", "b", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (sig, ids, flags, other, more) in K.by_bucket(batches, [np.uint64, np.int64, np.int8, np.int64, f"V{BINS}"]):
            if bucket >= buckets:
                yield rows(flags & 15, sig, ids, other, more)
                continue
            at, head, size = _shared(sig)
            if not len(at):
                continue
            sig, ids, flags = sig[at], ids[at], flags[at]
            any_of, all_of = np.bitwise_or.reduceat(flags, head), np.bitwise_and.reduceat(flags, head)
            good = (any_of & LOOK > 0) & (any_of & INDEX > 0) & (all_of & CUT == 0)
            at, size = K.ragged(head[good], size[good]), size[good]
            if len(at):
                sig, ids, flags = sig[at], ids[at], flags[at]
                head = np.cumsum(size) - size
                group = np.repeat(np.arange(len(head)), size)
                pick = _picked(sig, ids, head, group)
                yield rows(np.full(len(at), 3), sig, ids, ids[pick][group])

    return run


def _asked(groups: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The centres' texts to the groups of their partners, once to each group."""
    schema = pa.schema([("bucket", pa.int32()), ("centre", pa.int64()), ("partners", pa.list_(pa.int64())), ("txt", pa.string())])

    def run(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        out = []
        if pairs.num_rows and docs.num_rows:
            a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
            group = K.group_of(a, groups)
            order = np.lexsort((a, group, b))
            a, b, group = a[order], b[order], group[order]
            head = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (group[1:] != group[:-1])))
            ends = np.append(head[1:], len(a))
            at: dict[int, list[int]] = {}
            for i, k in enumerate(docs.column("id").to_pylist()):
                at.setdefault(k, []).append(i)
            rows, picked = [], []
            for x, y in zip(head.tolist(), ends.tolist(), strict=True):
                for i in at.get(int(b[x]), ()):
                    rows.append((int(group[x]), int(b[x]), a[x:y]))
                    picked.append(i)
            if rows:
                out = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), docs.column("txt").combine_chunks().take(pa.array(picked))], schema=schema)]
        return pa.Table.from_batches(out, schema=schema)

    return run


def _verified(n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The exact intersection and sizes of each pair."""
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "both", "n_a", "n_b")])

    def sets_of(column: pa.Array) -> list[np.ndarray]:
        out, texts = [], K.texts_of(column)
        for x, y in K.slices(texts):
            tokens, first = token_sets(K.Words(texts[x:y]), n)
            out += [tokens[i:j] for i, j in zip(first.tolist(), first[1:].tolist(), strict=False)]
        return out

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, ...]] = []
        if asked.num_rows and docs.num_rows:
            wanted = np.unique(asked.column("partners").combine_chunks().flatten().to_numpy())
            ids = docs.column("id").to_numpy()
            some = np.flatnonzero(np.isin(ids, wanted))
            mine: dict[int, list[np.ndarray]] = {}
            for i, s in zip(ids[some].tolist(), sets_of(docs.column("txt").combine_chunks().take(pa.array(some))), strict=True):
                mine.setdefault(i, []).append(s)
            for batch in asked.to_batches(max_chunksize=256):
                for centre, partners, other in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), sets_of(batch.column(3)), strict=True):
                    if not len(other):
                        continue
                    for p in partners:
                        for s in mine.get(p, ()):
                            low, high = (s, other) if len(s) <= len(other) else (other, s)
                            at = np.searchsorted(high, low)
                            at[at == len(high)] = 0
                            out.append((p, centre, int((high[at] == low).sum()), len(s), len(other)))
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return run


def families(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sizes, families): rows (id, n_shingles) of every document, and rows (id, component) of those that verified links connect."""
    D.has_checkpoint_dir(docs.sparkSession)
    rule = Rule(num, den)
    d = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("txt"))
    parts = D.parts_for(d)
    buckets = groups = parts
    found = D.saved(d.mapInArrow(_send(n, rule, buckets), K.packed_schema(5)).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_found(buckets), _FOUND))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs' intersections and sizes. Only texts of documents in pairs are dealt out, once for centres and partners."""
        ids = D.small(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
        dealt = d.join(ids, "id", "left_semi").withColumn("bucket", D.group_of("id", groups)).repartition(parts, "bucket")
        by_centre = pairs.withColumn("bucket", D.group_of("b", groups)).repartition(parts, "bucket")
        asked = dealt.groupBy("bucket").cogroup(by_centre.groupBy("bucket")).applyInArrow(_asked(groups), "bucket int, centre long, partners array<long>, txt string").repartition(parts, "bucket")
        return D.saved(dealt.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_verified(n), "a long, b long, both long, n_a long, n_b long"))

    is_link = F.col("both") * den >= (F.col("n_a") + F.col("n_b") - F.col("both")) * num
    sure = found.filter("kind = 1").select("a", "b")
    checked = verified(D.saved(found.filter("kind = 3 and a <> b").select("a", "b").distinct()))
    linked = _graph.components(checked.filter(is_link).select("a", "b").unionByName(sure))
    # what the stars left open: subsets whose members lie in several components. First each member's likeliest partner, then all that is left
    member = found.filter("kind = 3").select("sig", F.col("a").alias("id")).unionByName(found.filter("kind = 3").select("sig", F.col("b").alias("id"))).distinct()
    shape = found.filter("kind = 0").groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least"), F.max("b").alias("most"), F.min("h").alias("h"), F.max("h").alias("other"))
    # rows of one id with different sets have no histogram: none of their pairs is left out
    shape = shape.select("id", "least", "most", F.when(F.col("h") == F.col("other"), F.col("h")).alias("h"))
    for nearest in (True, False):
        known = member.join(linked, "id", "left").select("sig", "id", F.coalesce("component", "id").alias("component"))
        mixed = known.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).filter("low <> high and n > 2").select("sig", F.ceil(F.col("n") / MEMBERS).cast("int").alias("blocks"))
        known = _in_blocks(known.join(mixed, "sig").join(shape, "id"))
        open_ = known.repartition(parts, "sig").sortWithinPartitions("sig", "id").mapInArrow(_open_pairs(rule, nearest), "a long, b long").distinct()
        done = checked.select("a", "b").unionByName(checked.select(F.col("b").alias("a"), F.col("a").alias("b")))
        left = D.saved(open_.join(done, ["a", "b"], "left_anti"))
        if left.isEmpty():
            continue
        more = verified(left)
        checked = checked.unionByName(more)
        new = more.filter(is_link).select("a", "b")
        if not new.isEmpty():  # the components so far stand for their links, so few rounds are left
            linked = _graph.components(linked.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(new))
    return found.filter("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("n_shingles")), linked


def _in_blocks(known: DataFrame) -> DataFrame:
    """The members by subset or, where it has several blocks, by pair of blocks; ``block`` is -1 where all pairs count, else only those of two blocks do."""
    d = known.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("sig", F.least("mine", "other"), F.greatest("mine", "other"))
    group = F.when(F.col("blocks") == 1, F.col("sig")).otherwise(pair)
    return d.select(group.alias("sig"), "id", "component", "least", "most", "h", F.when(F.col("mine") == F.col("other"), -1).otherwise(F.col("mine")).alias("block"))


def _open_pairs(rule: Rule, nearest: bool, rows: int = 50_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of members sorted by subset, the pairs of different components that sizes and histograms allow to link: all, or each member's with the nearest histogram."""

    def pairs(sig: np.ndarray, ids: np.ndarray, comp: np.ndarray, least: np.ndarray, most: np.ndarray, block: np.ndarray, known: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        a, b, i = [], [], np.arange(len(sig))
        best, least_apart = np.full(len(sig), -1), np.full(len(sig), np.iinfo(np.int64).max)
        for step in range(1, len(sig)):
            i = i[i + step < len(sig)]
            i = i[sig[i] == sig[i + step]]
            if not len(i):
                break
            j = i + step
            can = (comp[i] != comp[j]) & ((block[i] < 0) | (block[i] != block[j])) & (most[j] * rule.den >= least[i] * rule.num) & (most[i] * rule.den >= least[j] * rule.num)
            x, y = i[can], j[can]
            for k in range(0, len(x), 20_000):
                u, v = x[k : k + 20_000], y[k : k + 20_000]
                apart = np.abs(h[u] - h[v]).sum(axis=1, dtype=np.int64)
                ok = (apart <= rule.apart(most[u] + most[v])) | ~known[u] | ~known[v]
                u, v, apart = u[ok], v[ok], apart[ok]
                if nearest:
                    for p, q in ((u, v), (v, u)):
                        nearer = apart < least_apart[p]
                        least_apart[p[nearer]], best[p[nearer]] = apart[nearer], q[nearer]
                else:
                    a.append(ids[u])
                    b.append(ids[v])
        if nearest:
            u = np.flatnonzero(best >= 0)
            a, b = [np.minimum(ids[u], ids[best[u]])], [np.maximum(ids[u], ids[best[u]])]
        both = np.unique(np.stack((np.concatenate(b), np.concatenate(a)), axis=1), axis=0) if a else np.zeros((0, 2), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= rows:
                table = pa.Table.from_batches(held).combine_chunks()
                sig = table.column("sig").to_numpy()
                cut = int(np.searchsorted(sig, sig[-1]))
                held = table.slice(cut).to_batches()
                if cut:
                    yield pairs(*_members(table.slice(0, cut)))
        if held:
            yield pairs(*_members(pa.Table.from_batches(held)))

    return run


def _members(table: pa.Table) -> tuple[np.ndarray, ...]:
    known = table.column("h").is_valid().to_numpy()
    h = np.zeros((table.num_rows, BINS), dtype=np.int16)
    h[known] = np.frombuffer(b"".join(table.column("h").drop_null().to_pylist()), dtype=np.uint8).reshape(-1, BINS)
    return (*(table.column(c).to_numpy() for c in ("sig", "id", "component", "least", "most", "block")), known, h)


def components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows (key, n_shingles, component_id) of every document."""
    sizes, found = families(docs, n, num, den, key, text)
    out = sizes.join(found, "id", "left")
    null = lambda c: F.nullif(c, F.lit(LAST))
    return out.select(null(F.col("id")).alias(key), "n_shingles", null(F.coalesce("component", "id")).alias("component_id"))
