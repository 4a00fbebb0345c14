"""Quality rules: counting rules, and a hashed n-gram log-likelihood ratio.

Method. The words and word pairs of a text are hashed to ``BUCKETS`` buckets,
as many for every table. Two multinomials over the buckets are counted on whole
texts: the raw corpus (all documents) and the trusted target (documents labelled
as good). Each is mixed with ``MIX`` parts of an even distribution, so that rates
are compared and not counts: a bucket's ratio is ln((p_target + m) / (p_raw + m))
with m = MIX / BUCKETS. Copies of the documents change neither rate, so the size of
the table moves no score; only the noise of rare n-grams gets less as it grows.
A document's score is the mean ratio of its n-grams; it stays when the score is
at least the threshold. Nothing is drawn at random: the same document gets the
same verdict each time.

The threshold is fitted on all labelled rows that the target leaves out: every row
labelled as bad, and one in ``FOLDS`` of those labelled as good (by a check sum of the
id). So each labelled row is used, and none that fits has its words in the target. Of the
scores that tell most of them apart it is the one nearest to ``DEFAULT`` (a tenth of the
gap away from the rows on its sides), so few rows move it little; without rows of both
labels it is ``DEFAULT``.

All of it is DataFrame expressions on the words of a row; only the counts of
buckets (partial sums of at most ``BUCKETS`` rows a task) and the scores of the rows
that fit the threshold are shuffled. Those scores are sorted by ranges; two counts and
the first score of each range go to the driver.

Defined results: a null, empty or blank text has no words, fails the base rules
and has the score 0; texts are read whole; repeated rows and null ids each
return a row; a null label is none, of several labels of an id the largest
counts; with no trusted documents every score is 0. ``judged`` adds its result
columns (in place of columns of these names) and passes all others through,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm import _frames as D

#: White space that parts words, and symbol characters.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Buckets, and the parts of an even distribution that each multinomial is mixed with.
BUCKETS, MIX = 1 << 18, 16.0

#: One row labelled as good in FOLDS fits the threshold, as all others do; the threshold where they don't tell.
FOLDS, DEFAULT = 4, -0.05

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def _pairs(values: Column, shift: int) -> Column:
    """Hashes of each value with the one ``shift`` places on."""

    def both(a: Column) -> Column:
        n = F.greatest(F.size(a) - shift, F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(shift + 1), n), lambda x, y: F.xxhash64(x, y))

    return D.let(values, both)


def repeat_words(windows: Column, size: int = WINDOW) -> Column:
    """Words in windows whose hash stands twice or more in ``windows`` (one hash for each start)."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.named_struct(F.lit("h"), h, F.lit("i"), i)))

    def starts(ordered: Column) -> Column:
        same = lambda x, j: (j >= 0) & F.coalesce(F.get(ordered, j)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])

    step = lambda acc, i: F.named_struct(F.lit("n"), acc["n"] + F.least(F.lit(size), i + size - acc["end"]), F.lit("end"), i + size)
    covered = F.aggregate(F.array_sort(D.let(placed, starts)), F.named_struct(F.lit("n"), F.lit(0), F.lit("end"), F.lit(-size)), step)["n"]
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(0)


def _measures(text: Column) -> Column:
    """(w, failed, h): the counts, whether they fail the base rules, and the hashes of the words."""
    t = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        return D.let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: D.let(_counts(words, h), lambda w: F.struct(w.alias("w"), _fails(w).alias("failed"), h.alias("h"))))

    def _counts(words: Column, h: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            D.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            D.let(_pairs(_pairs(_pairs(h, 1), 2), 4), repeat_words).cast("long").alias("n_repeat_words"),
        )

    return D.let(words_of(t), of)


def _fails(w: Column) -> Column:
    return (w["n_words"] < LEAST_WORDS) | (100 * w["n_repeat_words"] > MOST_REPEATED * w["n_words"])


def _grams(h: Column, buckets: int) -> Column:
    """The buckets of the words and of the pairs of neighbours."""
    return F.transform(F.concat(h, _pairs(h, 1)), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def ratios(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, mix: float = MIX) -> DataFrame:
    """One row with ``ratio``: ln(p_target / p_raw) of each bucket, checkpointed. Of ``trusted`` only the ids are read."""
    D.has_checkpoint_dir(docs.sparkSession)
    good = D.small(trusted.select(F.col(f"`{key}`").alias("id")).filter("id is not null").distinct().withColumn("good", F.lit(1)))
    d = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("txt")).join(good, "id", "left")
    h = F.transform(words_of(F.col("txt")), lambda w: F.xxhash64(w))
    rows = d.select(F.coalesce("good", F.lit(0)).alias("good"), h.alias("h")).select("good", F.explode(_grams(F.col("h"), buckets)).alias("b"))
    counts = rows.groupBy("b").agg(F.count("*").alias("raw"), F.sum("good").alias("target"))
    entries = counts.agg(F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"), F.array_sort(F.collect_list(F.struct("b", "raw", "target"))).alias("all"))
    value = lambda raw, target: F.log(target / F.col("n_target") + F.lit(mix / buckets)) - F.log(raw / F.col("n_raw") + F.lit(mix / buckets))
    found = F.transform("all", lambda x: F.named_struct(F.lit("b"), x["b"], F.lit("r"), value(x["raw"], x["target"])))
    found = F.when(F.coalesce("n_target", F.lit(0)) > 0, found).otherwise(F.expr("cast(array() as array<struct<b:int,r:double>>)"))
    return entries.select(D.let(found, lambda f: _dense(f, buckets)).alias("ratio")).checkpoint()


def _scored(text: Column, table: Column, buckets: int) -> Column:
    """(w, failed, score) of a text."""

    def of(m: Column) -> Column:
        total = F.aggregate(_grams(m["h"], buckets), F.lit(0.0), lambda acc, b: acc + F.get(table, b))
        n = F.greatest(2 * F.size(m["h"]) - 1, F.lit(1))
        return F.struct(m["w"].alias("w"), m["failed"].alias("failed"), F.coalesce(total / n, F.lit(0.0)).alias("score"))

    return D.let(_measures(text), of)


def _with_scores(docs: DataFrame, found: DataFrame, text: str, buckets: int) -> DataFrame:
    """(row, m): all columns of ``docs`` as a struct, and their measures. A table of BUCKETS numbers goes to each executor."""
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("table", found.scalar())
    return d.select("row", _scored(F.col("row")[text], F.col("table"), buckets).alias("m"))


def held_out(key: Column) -> Column:
    """Whether a row labelled as good fits the threshold and not the target."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(FOLDS)) == 0


def split_point(scores: list[tuple[float, int]]) -> float:
    """The threshold that keeps most rows of label 1 and rejects most of label 0, as shares of each.

    For lists in memory, as tests use it; ``split_point_of`` finds the same in a table.
    """
    ordered = sorted(scores)
    n = [sum(1 for _, y in ordered if y == k) for k in (0, 1)]
    if not all(n):
        return DEFAULT
    best, right = [(1.0, min(DEFAULT, ordered[0][0]))], 1.0
    for (s, y), (after, _) in zip(ordered, ordered[1:], strict=False):
        right += (1 - y) / n[0] - y / n[1]
        if s < after:
            edge = (after - s) / 10
            cut = min(max(DEFAULT, s + edge), after - edge)
            best.append((right, cut if cut > s else after))
    top = max(r for r, _ in best)
    return min((abs(t - DEFAULT), t) for r, t in best if r > top - 1e-12)[1]


def split_point_of(scored: DataFrame) -> float:
    """``split_point`` of all rows (score, y) of a table; rows without a score don't count.

    Rows of a score are counted first; the counts are sorted by ranges, and each range adds up its own from
    the totals of those before it. Gains are compared as integers, so equal ones are ties.
    """
    D.has_checkpoint_dir(scored.sparkSession)
    counts = scored.filter("score is not null").groupBy("score").agg(*(F.count_if(F.col("y") == k).alias(f"n{k}") for k in (0, 1)))
    # what an evaluation of a sort by ranges puts into a partition holds for that one only
    s = counts.orderBy("score").select("*", F.spark_partition_id().alias("part")).checkpoint()
    parts = s.groupBy("part").agg(F.min("score").alias("first"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).orderBy("first").collect()
    n = [sum(p[f"n{k}"] for p in parts) for k in (0, 1)]
    if not all(n):
        return DEFAULT
    before, sums = [], [0, 0]
    for p, after in zip(parts, [*(x.first for x in parts[1:]), None], strict=True):
        before.append((p.part, *sums, after))
        sums = [sums[0] + p.n0, sums[1] + p.n1]
    offsets = scored.sparkSession.createDataFrame(before, "part int, b0 long, b1 long, next double")
    own = Window.partitionBy("part").orderBy("score")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = s.select("part", "score", F.lead("score").over(own).alias("after"), *(F.sum(f"n{k}").over(upto).alias(f"c{k}") for k in (0, 1)))
    rows = rows.join(F.broadcast(offsets), "part").withColumn("after", F.coalesce("after", "next")).filter("after is not null")
    whole = lambda c: c.cast("decimal(19,0)")
    gain = whole(F.col("b0") + F.col("c0")) * whole(F.lit(n[1])) - whole(F.col("b1") + F.col("c1")) * whole(F.lit(n[0]))
    edge = (F.col("after") - F.col("score")) / 10
    cut = F.least(F.greatest(F.lit(DEFAULT), F.col("score") + edge), F.col("after") - edge)
    rows = rows.select(gain.alias("gain"), F.when(cut > F.col("score"), cut).otherwise(F.col("after")).alias("cut"))  # a gap may be too small for a number in it
    best = rows.agg(F.min(F.struct((-F.col("gain")).alias("loss"), F.abs(F.col("cut") - DEFAULT).alias("far"), "cut")).alias("b")).first().b
    lowest = min(DEFAULT, parts[0].first)  # keeps all, without gain
    return lowest if best is None or (-best.loss, -best.far, -best.cut) < (0, -abs(lowest - DEFAULT), -lowest) else best.cut


def fitted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", buckets: int = BUCKETS) -> tuple[DataFrame, float]:
    """(ratios, threshold): the table of the target's rows, and the threshold from rows of neither."""
    known = labels.select(F.col(f"`{key}`").alias(key), F.col(f"`{label}`").cast("int").alias("y")).filter(F.col(f"`{key}`").isNotNull() & F.col("y").isNotNull())
    known = known.groupBy(key).agg(F.max("y").alias("y"))
    found = ratios(docs, known.filter((F.col("y") > 0) & ~held_out(F.col(key))), key, text, buckets)
    fit = D.small(known.filter((F.col("y") <= 0) | held_out(F.col(key))).select(F.col(key).alias("id"), "y"))
    d = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("txt")).join(fit, "id")
    # rows that share an id count once; a filter on the measures here would be pushed below the join, to all documents
    m = F.col("m")
    rows = _with_scores(d, found, "txt", buckets).groupBy("row.id").agg(F.max("row.y").alias("y"), F.min(F.when(~m["failed"], m["score"])).alias("score"))
    return found, split_point_of(rows.select("score", (F.col("y") > 0).cast("int").alias("y")))


def judged(docs: DataFrame, found: DataFrame, threshold: float, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with _w (counts), _base_failed, _score and _kept added."""
    out = _with_scores(docs, found, text, buckets)
    m = F.col("m")
    added = {"_w": m["w"], "_base_failed": m["failed"], "_score": m["score"], "_kept": ~m["failed"] & (m["score"] >= threshold)}
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in added), *(v.alias(k) for k, v in added.items()))


def kept(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The documents that stay, with their own columns only, whatever their names."""
    found, threshold = fitted(docs, labels, key, text, label)
    # one expression for the filter, so that Catalyst doesn't copy the measures into each of several conditions
    stays = D.let(_scored(F.col(f"`{text}`"), F.col(name := D.fresh(docs.columns, "table")), BUCKETS), lambda m: ~m["failed"] & (m["score"] >= threshold))
    return docs.withColumn(name, found.scalar()).filter(stays).drop(name)


def _dense(found: Column, buckets: int) -> Column:
    """The values of sorted (b, r) entries by bucket, with 0 between them.

    The last gap follows from the entries even where there are none: a gap of a fixed length would be folded
    into a literal of that many numbers, which every text of the plan then spells out.
    """
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(found, i - 1)["b"])
    gap = lambda k: F.array_repeat(F.lit(0.0), k)
    parts = F.flatten(F.transform(found, lambda x, i: F.concat(gap(x["b"] - before(i) - 1), F.array(x["r"]))))
    return F.concat(parts, gap(F.lit(buckets - 1) - F.coalesce(F.get(found, F.size(found) - 1)["b"], F.lit(-1))))


def report(docs: DataFrame, found: DataFrame, threshold: float, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Per document its counts, base_failed, kept and the score."""
    out = judged(docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text)), found, threshold, text, buckets)
    return out.select(key, "_w.*", F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_score").alias("score"))
