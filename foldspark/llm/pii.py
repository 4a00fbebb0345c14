"""Personal data: exact patterns, and terms that give the protected values away.

Method. Four patterns find the protected values (e-mail addresses, IP addresses,
card and phone numbers). Then information theory finds what reveals them: for a
term t at most ``NEAR`` words from the value e in a line, the corpus gives n(t, e),
n(t), n(e) and N in documents, and t discloses the share

    ln(n(t, e) N / (n(t) n(e))) / ln(N / n(e))

of the information that e itself carries. A term that is seen beside e in fewer
than ``support`` different lines (one text copied many times is one line) counts
less: k lines are taken as the part k / (k + support / 3) of n(t, e). So, with a
support of 3, one line is enough where N / n(e) is 1,024 or more, two where it is
58 or more. Terms with a share of ``disclosure`` or more are spans, too, in every
document that holds them, with or without e;
``clean`` generalises values to [EMAIL] etc. and terms to [TERM].

All of it is DataFrame expressions. The patterns are written with possessive
quantifiers and an anchor at the start of a run, which changes no match but
keeps the regular expression engine linear and its stack flat on long texts.
Positions come from the lengths of the pieces between the matches, added up by chunks;
overlaps are found by a sweep over sorted spans. So all takes time about in proportion
to a text's length.

Defined results: a null or empty text has no spans; positions count code points,
ends are exclusive; repeated rows and null ids each return a row; other columns
are not read. Overlapping spans of different kinds all stay; ``clean`` joins them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm import _frames as D

#: Kinds in their order, the pattern of each, and a cheap test that a text may hold one.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MAY_HOLD = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: t.contains("+") & t.rlike(r"\+[0-9][\x20().0-9-]"),
}
IP = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: Words of a line, as letters and digits.
TERM = r"[\p{L}\p{N}]+"

#: Words on either side of a value that count as beside it.
NEAR = 16

_SPAN = "array<struct<start:bigint,rank:int,stop:bigint,value:string>>"
_NONE = f"cast(array() as {_SPAN})"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits pass the check sum that doubles every second one from the right."""
    digits = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        d = F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + d

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP)
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(14, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def located(text: Column, pattern: str, rank: int, wanted=None) -> Column:
    """All matches from the left (that are ``wanted``) with their places: the lengths of the pieces between them, added up."""
    pieces, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def of(values: Column) -> Column:
        def placed(lens: Column) -> Column:
            before = D.scanned(F.transform(lens, lambda x: (x["a"] + x["b"]).cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b)

            def span(value: Column, i: Column, before: Column) -> Column:
                start = F.get(before, i) + F.get(lens, i)["a"]
                return F.named_struct(F.lit("start"), start, F.lit("rank"), F.lit(rank), F.lit("stop"), start + F.get(lens, i)["b"], F.lit("value"), value)

            return D.let(before, lambda before: F.transform(values, lambda v, i: span(v, i, before)))

        lens = F.zip_with(F.slice(pieces, F.lit(1), F.size(values)), values, lambda p, v: F.named_struct(F.lit("a"), F.length(p), F.lit("b"), F.length(v)))
        return D.let(lens, placed)

    found = D.let(values, of)
    return found if wanted is None else F.filter(found, lambda s: wanted(s["value"]))


def outside(spans: Column, base: Column) -> Column:
    """The spans (which don't overlap each other) that overlap none of ``base``: a sweep over both in order."""
    marked = lambda a, term: F.transform(a, lambda s: F.named_struct(F.lit("start"), s["start"], F.lit("term"), F.lit(term), F.lit("span"), s))

    def of(every: Column) -> Column:
        ends = F.transform(every, lambda x: F.when(x["term"] == 0, x["span"]["stop"]).otherwise(F.lit(0).cast("bigint")))
        # of bases that begin at or before a span the farthest end, and whether the next base begins within the span
        free = lambda x, i, reach: (x["term"] == 1) & (F.get(reach, i) <= x["start"]) & ~F.coalesce((F.get(every, i + 1)["term"] == 0) & (F.get(every, i + 1)["start"] < x["span"]["stop"]), F.lit(False))
        kept = D.let(D.scanned(ends, F.lit(0).cast("bigint"), lambda a, b: F.greatest(a, b)), lambda reach: F.filter(every, lambda x, i: free(x, i, reach)))
        return F.transform(kept, lambda x: x["span"])

    return D.let(F.array_sort(F.concat(marked(base, 0), marked(spans, 1))), of)


#: What may be a value of any kind, or else a term.
TOKEN = "|".join((*(PATTERNS[k] for k in ("email", "ip", "phone", "card")), TERM))


def _rank(token: Column) -> Column:
    """The kind of a token that is a value, else -1."""
    out = F.lit(-1)
    for i, kind in reversed(list(enumerate(KINDS))):
        looks = {"email": token.contains("@"), "ip": token.contains("."), "phone": token.startswith("+"), "card": token.rlike(r"^[0-9][\x20-]?[0-9]")}[kind]
        ok = _valid(kind, token) if kind != "phone" else _valid(kind, token) & ~token.contains("@")
        out = F.when(looks & ok, i).otherwise(out)
    return F.when(token.rlike(r"^\p{L}+$"), -1).otherwise(out)


def spans_of(text: Column, kind: str) -> Column:
    none = F.expr(_NONE)
    found = F.filter(located(text, PATTERNS[kind], KINDS.index(kind)), lambda s: _valid(kind, s["value"]))
    return F.when(MAY_HOLD[kind](text), found).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end by start and kind, comma-joined."""
    names = F.array(*map(F.lit, (*KINDS, "term")))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))
    return F.concat_ws(",", F.transform(F.array_sort(spans), one))


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", support: int = 3, disclosure: float = 0.9) -> DataFrame:
    """The rows (key, email, ip, card, phone, term, text): lists of spans; ``text`` only where there are any."""
    D.has_checkpoint_dir(docs.sparkSession)
    d = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("txt"))
    base = d.select("key", "txt", *(spans_of(F.col("txt"), k).alias(k) for k in KINDS))
    hit = sum((F.size(k) for k in KINDS), F.lit(0)) > 0
    base = base.select(F.monotonically_increasing_id().alias("rid"), "key", *KINDS, "txt", hit.alias("hit")).checkpoint()
    terms = _terms(base, support, disclosure)
    out = base.join(D.small(terms), "rid", "left").withColumn("txt", F.when(F.col("hit") | F.col("terms").isNotNull(), F.col("txt")))
    found = located(F.col("txt"), TERM, len(KINDS), lambda v: F.array_contains(F.col("terms"), F.lower(v)))
    term = F.when(F.col("terms").isNotNull(), outside(found, F.concat(*KINDS))).otherwise(F.expr(_NONE))
    return out.select(F.col("key").alias(key), *KINDS, term.alias("term"), F.col("txt").alias("text"))


def _terms(base: DataFrame, support: int, disclosure: float) -> DataFrame:
    """The rows (rid, terms): the disclosing terms of each document that holds some."""
    # no match of the patterns crosses a line
    lines = base.filter("hit").select("rid", F.explode(F.array_distinct(F.split("txt", "\n"))).alias("line"))
    tokens = lines.select("rid", F.xxhash64("line").alias("line"), F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0)).alias("tokens"))
    tokens = tokens.withColumn("ranks", F.transform("tokens", _rank))
    held = F.filter(F.transform("tokens", lambda t, i: F.named_struct(F.lit("i"), i, F.lit("rank"), F.get("ranks", i), F.lit("value"), t)), lambda x: x["rank"] >= 0)
    near = tokens.select("rid", "line", "tokens", "ranks", F.explode(held).alias("e"))
    first = F.greatest(F.col("e.i") - NEAR, F.lit(0)) + 1
    around = F.arrays_zip(F.slice("tokens", first, F.lit(2 * NEAR + 1)).alias("t"), F.slice("ranks", first, F.lit(2 * NEAR + 1)).alias("r"))
    # values, and what looks like one, are no terms
    words = F.array_distinct(F.transform(F.filter(around, lambda x: (x["r"] < 0) & x["t"].rlike(f"^{TERM}$")), lambda x: F.lower(x["t"])))
    pairs = near.select("rid", "line", F.concat_ws(":", F.col("e.rank").cast("string"), "e.value").alias("e"), F.explode(words).alias("t"))
    n_e = pairs.select("e", "rid").distinct().groupBy("e").agg(F.count("*").alias("n_e"))
    total = F.lit(float(max(base.count(), 1)))
    weight = F.when(F.col("lines") >= support, 1.0).otherwise(F.col("lines") / (F.col("lines") + support / 3))
    share = lambda n_t: F.log(F.col("weight") * F.col("n_et") * total / (F.col(n_t) * F.col("n_e"))) / F.log(total / F.col("n_e"))
    seen = pairs.groupBy("e", "t", "line").agg(F.lit(1).alias("one")).groupBy("e", "t").agg(F.count("*").alias("lines")).select("e", "t", weight.alias("weight"))
    # the documents with t beside any value are some of those with t: a share too small for them is too small
    n_near = pairs.select("t", "rid").distinct().groupBy("t").agg(F.count("*").alias("n_near"))
    both = pairs.select("e", "t", "rid").distinct().groupBy("e", "t").agg(F.count("*").alias("n_et")).join(seen, ["e", "t"]).join(n_e, "e").join(n_near, "t")
    both = both.filter((F.col("n_e") < total) & (share("n_near") >= disclosure)).drop("n_near").checkpoint()
    wanted = both.select("t").distinct()
    every = base.select("rid", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("txt"), F.lit(TERM), F.lit(0)))).alias("t"))
    n_t = every.join(D.small(wanted), "t").groupBy("t").agg(F.count("*").alias("n_t"))
    told = both.join(n_t, "t").filter(share("n_t") >= disclosure).select("t").distinct().checkpoint()
    return every.join(D.small(told), "t").groupBy("rid").agg(F.collect_set("t").alias("terms"))


def clean(found: DataFrame, docs_text: str = "text") -> Column:
    """From the rows of ``detect`` the text with spans generalised; null where nothing was found."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")))
    text = F.col(docs_text)

    def of(spans: Column) -> Column:
        reach = D.scanned(F.transform(spans, lambda s: s["stop"]), F.lit(0).cast("bigint"), lambda a, b: F.greatest(a, b))

        def filled(chars: Column, reach: Column) -> Column:
            cut = lambda a, b: F.array_join(F.slice(chars, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")), "")
            part = lambda s, i: F.when(s["start"] >= F.get(reach, i), F.concat(cut(F.get(reach, i), s["start"]), F.element_at(names, s["rank"] + 1))).otherwise("")
            end = F.array_max(F.transform(spans, lambda s: s["stop"]))
            return F.concat(F.array_join(F.transform(spans, part), ""), cut(F.coalesce(end, F.lit(0).cast("bigint")), F.size(chars).cast("bigint")))

        return D.let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda chars: D.let(reach, lambda reach: filled(chars, reach)))

    return F.when(text.isNotNull(), D.let(F.array_sort(F.concat(*KINDS, "term")), of))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the hash of the base spans and all spans as text."""
    base = joined(F.concat(*KINDS))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(key, *counts, F.sha2(base, 256).alias("base_sha256"), joined(F.concat(*KINDS, "term")).alias("spans"))
