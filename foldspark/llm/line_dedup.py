"""Removal of repeated runs of lines, by winnowing over line hashes.

Method. Lines without a word don't count. The hashes of ``gram`` consecutive
lines are the grams of a document; of every ``run - gram + 1`` consecutive grams
the smallest is a fingerprint, so every run of ``run`` lines or more holds at
least one, and equal runs hold the same. Fingerprints that stand at one place
only end the matter for their windows. The others' windows (``run`` lines each,
compared by 128 bits of hash) are joined with their earliest place by document
id (an integer), then line; a window that also starts earlier goes. Windows overlap, so a
longer match is extended both ways, line by line, as far as it goes.

With ``words``, runs of fewer than ``run`` lines are windows, too, if they hold
more than that many words; each is its own fingerprint and goes by the same rule.

All of it is DataFrame expressions. Copies meet as partial minima, a row for
each window and task, so no task gets a group's rows; nothing that follows a join
in its stage needs a key's rows together, so Spark may split a frequent window's. A
text's lines are swept in order, which takes time in proportion to their number.

Defined results: equal means equal after white space at both ends is cut; a null
or empty text has no lines and stays as it is; rows that share an id (or have
none, which sorts first) count as one document, and a window that is removed in
one is removed in each that holds it at this place; other columns pass through
untouched, whatever their names, but for those with the names of the results
(_n_lines, _n_removed, _n_short), which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm import _frames as D

#: What makes a line count, and the white space cut at its ends.
WORD = r"[^\x20\x09-\x0D]"
SPACES = r"[\x20\x09-\x0D]+"
ENDS = " \t\n\x0b\x0c\r"


def line_hashes(text: Column) -> Column:
    """A pair of hashes of each line with a word."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    return F.transform(lines, lambda x: D.let(F.trim(x, F.lit(ENDS)), lambda t: F.named_struct(F.lit("a"), F.xxhash64(t), F.lit("b"), F.xxhash64(F.lit(1), t))))


def _windows(hashes: Column, run: int, gram: int) -> Column:
    """(fingerprint, both hashes) of the window at each line with ``run`` lines from it on."""

    def of(h: Column) -> Column:
        part = lambda field, at, n: F.xxhash64(F.transform(F.slice(h, at, F.lit(n)), lambda x: x[field]))
        starts = F.sequence(F.lit(1), F.size(h) - run + 1)

        def one(i: Column) -> Column:
            least = F.array_min(F.transform(F.sequence(i, i + run - gram), lambda j: part("a", j, gram)))
            return F.named_struct(F.lit("f"), least, F.lit("a"), part("a", i, run), F.lit("b"), part("b", i, run))

        none = F.expr("cast(array() as array<struct<f:bigint,a:bigint,b:bigint>>)")
        return F.when(F.size(h) >= run, F.transform(starts, one)).otherwise(none)

    return D.let(hashes, of)


def _short_windows(text: Column, run: int, words: int) -> Column:
    """(at, n, both hashes) of the windows of n < ``run`` lines that hold more than ``words`` words."""
    lines = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD)), lambda x: F.trim(x, F.lit(ENDS)))
    hashed = F.transform(lines, lambda t: F.named_struct(F.lit("a"), F.xxhash64(t), F.lit("b"), F.xxhash64(F.lit(1), t), F.lit("w"), F.size(F.split(t, SPACES))))

    def of(h: Column) -> Column:
        def windows(n: int) -> Column:
            part = lambda field, i: F.xxhash64(F.transform(F.slice(h, i + 1, F.lit(n)), lambda x: x[field]))

            def one(_: Column, i: Column) -> Column:
                held = sum((F.get(h, i + k)["w"] for k in range(1, n)), F.get(h, i)["w"])
                w = F.named_struct(F.lit("at"), i, F.lit("n"), F.lit(n), F.lit("a"), part("a", i), F.lit("b"), part("b", i))
                return F.when(held > words, w)  # null beyond the last line

            return F.array_compact(F.transform(h, one))

        return F.concat(*(windows(n) for n in range(1, run)))

    return D.let(hashed, of)


def _late(windows: DataFrame, by: list[str]) -> DataFrame:
    """The windows (id, at, ...) that are equal in ``by`` to one that starts earlier."""
    first = windows.groupBy(*by).agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n_same")).filter("n_same > 1").drop("n_same")
    return windows.join(first, by).filter(F.struct("id", "at") > F.col("first"))


def removed(docs: DataFrame, run: int = 3, gram: int = 2, key: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """The rows (id, starts) of documents that lose windows: the place (counted in lines with a word from 0) and the lines of each."""
    k = D.keyed(docs, key, text)
    d = k.select("id", F.posexplode(_windows(line_hashes(F.col("txt")), run, gram)).alias("at", "w")).select("id", "at", "w.*")
    # a document holds a fingerprint in several of its windows, too: only another place of the whole window makes it one to look at
    repeated = d.groupBy("f").agg(F.count("*").alias("n"), F.count_distinct("a", "b").alias("kinds")).filter("n > kinds").select("f")
    late = _late(d.join(repeated, "f", "left_semi"), ["a", "b"]).select("id", "at", F.lit(run).alias("n"))
    if words is not None and run > 1:
        short = k.select("id", F.explode(_short_windows(F.col("txt"), run, words)).alias("w")).select("id", "w.*")
        late = late.unionByName(_late(short, ["n", "a", "b"]).select("id", "at", "n"))
    return late.groupBy("id").agg(F.collect_set(F.struct("at", "n")).alias("starts"))


def dedup(docs: DataFrame, run: int = 3, gram: int = 2, key: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """``docs`` with the lines of repeated runs deleted from the text, and _n_lines and _n_removed added; with ``words``
    also _n_short, how many of the removed lines only shorter runs cover."""
    gone = removed(docs, run, gram, key, text, words).select("id", _places(F.col("starts")).alias("gone"), _places(F.filter("starts", lambda s: s["n"] == run)).alias("long"))
    id_ = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(D.NO_ID))
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), id_.alias("id"), F.col(f"`{text}`").alias("txt")).join(gone, "id", "left")
    lines = F.split(F.coalesce("txt", F.lit("")), "\n")
    zero, plus = F.lit(0), lambda a, b: a + b

    def swept(lines: Column) -> Column:
        def left(has: Column) -> Column:
            return D.let(F.aggregate(has, zero, plus), lambda total: counted(has, total))

        def counted(has: Column, total: Column) -> Column:
            # the place of each line among those with a word, and whether a removed window covers it
            kept = D.let(D.scanned(has, zero, plus), lambda seen: D.let(D.flags(F.col("gone"), total), lambda out: F.filter(lines, lambda x, i: (F.get(has, i) == 0) | (F.get(out, F.get(seen, i)) == 0))))
            # rows that share an id hold different lines: places beyond the last line are none
            count = lambda a: F.size(F.filter(a, lambda p: p < total))
            return F.struct(F.array_join(kept, "\n").alias("text"), total.alias("lines"), count(F.col("gone")).alias("removed"), count(F.col("long")).alias("long"))

        return D.let(F.transform(lines, lambda x: x.rlike(WORD).cast("int")), left)

    counted = F.size(F.filter(lines, lambda x: x.rlike(WORD)))
    same = F.struct(F.col("txt").alias("text"), counted.alias("lines"), zero.alias("removed"), zero.alias("long"))
    out = out.select("row", F.when(F.col("gone").isNull(), same).otherwise(D.let(lines, swept)).alias("s"))
    added = {"_n_lines": F.col("s.lines"), "_n_removed": F.col("s.removed")}
    if words is not None:
        added["_n_short"] = F.col("s.removed") - F.col("s.long")
    columns = [(F.col("s.text") if c == text else F.col("row")[c]).alias(c) for c in docs.columns if c not in added]
    return out.select(*columns, *(v.cast("long").alias(k) for k, v in added.items()))


def _places(windows: Column) -> Column:
    """The lines that windows (at, n) cover, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(windows, lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))))


def report(docs: DataFrame, run: int = 3, gram: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its lines with a word, how many of them went, and a hash of the text that is left (null: none)."""
    out = dedup(docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text)), run, gram, key, text)
    return out.select(key, F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(text, 256).alias("text_sha256"))


#: The same result in DuckDB's SQL: windows of three lines by their first place.
SQL = r"""
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents
), cut AS (
  SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS no FROM split
), word AS (
  SELECT doc_id, no, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS pos
  FROM cut WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')
), win AS (
  SELECT doc_id, pos, words AS a, lead(words) OVER (PARTITION BY doc_id ORDER BY pos) AS b,
         lead(words, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS c
  FROM word
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n FROM win WHERE c IS NOT NULL
), gone AS (
  SELECT DISTINCT word.doc_id, word.no FROM ranked JOIN word ON word.doc_id = ranked.doc_id AND word.pos BETWEEN ranked.pos AND ranked.pos + 2 WHERE n > 1
), kept AS (
  SELECT cut.doc_id, string_agg(raw, chr(10) ORDER BY cut.no) AS text
  FROM cut LEFT JOIN gone ON gone.doc_id = cut.doc_id AND gone.no = cut.no WHERE gone.no IS NULL GROUP BY 1
), counts AS (
  SELECT word.doc_id, count(*) AS n_lines, count(gone.no) AS n_removed
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.no = word.no GROUP BY 1
)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL WHEN coalesce(c.n_removed, 0) = 0 THEN sha256(d.text) ELSE sha256(coalesce(k.text, '')) END AS text_sha256
FROM documents d LEFT JOIN counts c ON c.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
