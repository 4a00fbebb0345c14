"""Licence statements in texts, by exact set-similarity join with template texts.

Method. The words of a text run on over its lines. A block is any run of as many
words as a template has and a quarter more, its set the distinct words in it. It
matches the template when it holds ``threshold`` of the template's distinct words or
more; so statements may be wrapped, indented or behind comment marks. The words of all
templates are ordered by the number of documents that hold them, rarest first (counted
on the whole corpus). A text with a block that meets the threshold o of a template T has
one of its first |T| - o + 1 words (prefix filter: a table from prefix words to
templates gives the candidates), and o of its words at least (length filter). Only blocks
that begin with a word of T are looked at, as others hold no more of them, and only where
the o-th such word from there on still lies in the block (positional filter); what
passes is counted exactly.

The base rule is apart: three phrases, as consecutive words anywhere.

All of it is DataFrame expressions; the templates and the counts of their words
are parameters, held in one row that each task gets, with words found by a check sum;
so thousands of templates cost no more for each text. The corpus is read twice and not
shuffled.

Defined results: A-Z count as a-z; a null or empty text has no words; phrases and blocks
may cross lines; of the blocks that match a template the best counts once; templates
without words are none; repeated rows and null ids each return a row; other columns are
not read.
"""

from __future__ import annotations

import functools
import math
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm import _frames as D

#: Words of a text with A-Z lowered, and what parts them.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the base rule and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Statements of public licences (label, words).
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("all-rights-reserved", "all rights reserved"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def words_of(low: Column) -> Column:
    """The words of a lowered text, by what parts them: extracting each word takes many times the CPU seconds of a split."""
    return F.filter(F.split(low, GAPS), lambda w: w != "")


def order_of(docs: DataFrame, text: str, templates=TEMPLATES) -> dict[str, int]:
    """The templates' words and their place in the order by document frequency. A number for each word goes to the driver."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    # lower() is coarser than lowering A-Z only; for an order that is good enough
    words = F.array_intersect(words_of(F.lower(F.col(f"`{text}`"))), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    n = {r.w: r.n for r in rows}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (n.get(w, 0), w)))}


def _table(order: dict[str, int], threshold: float, templates) -> tuple[list, list, list]:
    """(words by check sum, templates by prefix word, templates): words are their places in the order."""
    size = 1 << max(4, (8 * len(order)).bit_length())
    words: list[list[tuple[str, int]]] = [[] for _ in range(size)]
    for w, i in order.items():
        words[zlib.crc32(w.encode()) % size].append((w, i))
    prefixes: list[list[int]] = [[] for _ in order]
    prepared = []
    for label, template in templates:
        every = template.split()
        codes = sorted({order[w] for w in every})
        least = math.ceil(round(threshold * len(codes), 9))
        for c in codes[: len(codes) - least + 1] if codes else ():
            prefixes[c].append(len(prepared))
        prepared.append((label, codes, least, block_words(every)))
    return words, prefixes, prepared


def block_words(template: list[str]) -> int:
    return len(template) + len(template) // 4


def matches(words: Column, table: Column) -> Column:
    """(label, share) of every template that a block of the lowered words meets."""

    def code(w: Column) -> Column:
        near = F.get(table["words"], F.pmod(F.crc32(w.cast("binary")), F.size(table["words"]).cast("long")).cast("int"))
        return F.coalesce(F.get(F.filter(near, lambda x: x["w"] == w), F.lit(0))["c"], F.lit(-1))

    def tested(hits: Column, t: Column) -> Column:
        """(label, share) or null. hits: the places and codes of the text's words that templates have."""

        def best(mine: Column) -> Column:
            def held(h: Column, k: Column) -> Column:
                last = F.get(mine, k + t["least"] - 1)
                inside = F.filter(F.slice(mine, k + 1, t["block"]), lambda x: x["i"] < h["i"] + t["block"])
                return F.when(last["i"] < h["i"] + t["block"], F.size(F.array_distinct(F.transform(inside, lambda x: x["c"]))))

            return F.array_max(F.transform(mine, lambda h, k: held(h, k)))

        mine = F.filter(hits, lambda h: F.array_contains(t["codes"], h["c"]))
        return D.let(D.let(mine, lambda m: F.when(F.size(m) >= t["least"], best(m))), lambda n: F.when(n >= t["least"], F.named_struct(F.lit("label"), t["label"], F.lit("share"), n / F.size(t["codes"]).cast("double"))))

    def of(hits: Column) -> Column:
        some = F.array_distinct(F.flatten(F.transform(F.array_distinct(F.transform(hits, lambda h: h["c"])), lambda c: F.get(table["prefixes"], c))))
        return F.array_compact(F.transform(some, lambda i: tested(hits, F.get(table["templates"], i))))

    coded = F.transform(words, lambda w, i: F.named_struct(F.lit("i"), i, F.lit("c"), code(w)))
    return D.let(F.filter(coded, lambda h: h["c"] >= 0), of)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, templates=TEMPLATES) -> DataFrame:
    """The rows (key, n_words, places, found): ``places`` (word, label) of the base phrases, ``found`` the matched templates (label, share)."""
    order = order_of(docs, text, templates)
    words, prefixes, prepared = _table(order, threshold, templates)
    schema = "words array<array<struct<w:string,c:int>>>, prefixes array<array<int>>, templates array<struct<label:string,codes:array<int>,least:int,block:int>>"
    # one row: some numbers for each word of a template
    table = docs.sparkSession.createDataFrame([(words, prefixes, prepared)], schema).select(F.struct("*").alias("table"))
    d = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("txt")).withColumn("table", table.scalar())
    # lower() is coarser than lowering A-Z only: it parts the same words, and finds all words of the phrases and templates
    # (others, too); so these tests lose nothing and spare most texts the rest
    d = d.withColumn("_words", words_of(F.lower("txt")))
    holds = lambda words: F.arrays_overlap("_words", F.array(*map(F.lit, sorted(words)))) if words else F.lit(False)
    by_place = sorted(order, key=order.get)
    starters = {by_place[c] for c, ts in enumerate(prefixes) if ts}

    def starts(words: Column, phrase: list[str], label: str) -> Column:
        def one(x: Column, i: Column) -> Column:
            rest = [F.coalesce(F.get(words, i + j) == w, F.lit(False)) for j, w in enumerate(phrase[1:], 1)]
            return F.when(functools.reduce(lambda a, b: a & b, rest, x == phrase[0]), F.named_struct(F.lit("word"), i.cast("long"), F.lit("label"), F.lit(label)))

        return F.array_compact(F.transform(words, one))

    def places(words: Column) -> Column:
        return F.concat(*(starts(words, p.split(), label) for p, label in PHRASES.items()))

    none = F.expr("cast(array() as array<struct<word:bigint,label:string>>)")
    words = words_of(lowered(F.col("txt")))
    return d.select(
        F.col("key").alias(key),
        F.size("_words").cast("long").alias("n_words"),
        F.when(holds({p.split()[-1] for p in PHRASES}), D.let(words, places)).otherwise(none).alias("places"),
        F.when(holds(starters), matches(words, F.col("table"))).otherwise(F.expr("cast(array() as array<struct<label:string,share:double>>)")).alias("found"),
    )


def report(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, labels and the largest share of a statement that a text holds (1 for a base phrase)."""
    starts = F.transform("places", lambda s: s["word"])
    base = F.transform("places", lambda s: s["label"])
    own = F.transform("found", lambda s: s["label"])
    share = F.coalesce(F.array_max(F.transform("found", lambda s: s["share"])), F.lit(0.0))
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return scanned.select(
        key,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        join(base).alias("base_labels"),
        join(F.concat(base, own)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(share).alias("score"),
    )
