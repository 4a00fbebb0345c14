"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of documents, the last one the encoded documents.

Defined results: a null, empty or blank text fails the first stage; the others keep
a null text (the fourth drops texts without words); repeated rows and null ids are
documents like others, of which the third keeps one for each group; further columns
pass through the first four stages, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm import bpe, decontamination, line_dedup, ngram_jaccard, quality_rules
from foldspark.llm._frames import has_checkpoint_dir, small
from foldspark.llm.queries import VOCABULARY, table

#: Runs of one or two lines that hold more words than this are passages to look for; shorter ones may be common phrases.
SHORT_WORDS = 50


def _row(docs: DataFrame) -> Column:
    """All columns as one, so that no name of theirs meets a name of a stage."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counting rules or the ratio reject go. The trusted target is what the labels call good."""
    return quality_rules.kept(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of three lines or more go from the texts, and shorter ones of more than SHORT_WORDS words.

    A document that runs of three lines or more empty goes here; one that shorter runs empty stays without words
    and goes in ``benchmark``.
    """
    rows = docs.select(_row(docs), "doc_id", "text")
    out = line_dedup.dedup(rows, run=3, gram=2, words=SHORT_WORDS)
    gone = (F.col("_n_removed") > 0) & (F.col("_n_removed") == F.col("_n_lines")) & (F.col("_n_short") == 0)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.filter(~gone).select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays.

    Where ids repeat or are null, rows are numbered and each counts as a document; of a group the first row stays.
    """
    n = docs.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    unique = n.rows == n.ids
    rows = docs.select(_row(docs), (F.col("doc_id") if unique else F.monotonically_increasing_id()).alias("id"), "text")
    if not unique:
        has_checkpoint_dir(spark)
        rows = rows.checkpoint()
    found = ngram_jaccard.components(rows, n=5, num=80, den=100, key="id")
    copies = found.filter("id <> component_id").select(F.col("id").alias("copy")).distinct()
    return rows.join(small(copies), F.col("id") == F.col("copy"), "left_anti").select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item leaks go, and those that line dedup has left no words."""
    docs = docs.filter(F.col("text").rlike(line_dedup.WORD))
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the token ids of every text."""
    return bpe.encode(docs, VOCABULARY)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("BPE encoding", encoded)]

#: SQL has neither Spark's hash functions nor BPE; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each on the checkpointed rows of the one before."""
    has_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = docs.checkpoint()
    return docs
