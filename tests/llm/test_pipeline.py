import random
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from foldspark.llm import quality_rules
from tests.llm.test_native import counts, line_brute
from tests.llm.test_ngram_jaccard import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        kept.append({r.doc_id: r for r in docs.collect()})
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == columns
    quality, lines, near, bench, coded = kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(not counts(text[k])[-1] for k in quality)
    good = [k for k, q in labels.items() if q == 1 and not counts(text[k])[-1]]
    assert sum(k in quality for k in good) >= 0.97 * len(good)
    rows = [(k, text[k]) for k in quality]
    assert {k: r.n_chars for k, r in lines.items()} == {k: len(r.text) for k, r in lines.items()}
    removed = line_brute(rows)
    assert set(lines) == {k for k, (n, gone, _) in removed.items() if not gone or gone < n}
    groups = brute([(k, r.text) for k, r in lines.items()])
    assert set(near) == {k for k, (_, c) in groups.items() if c == k}
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(i in " ".join(r.text.split()) for r in bench.values() for i in items if len(i.split()) >= 8)
    assert set(bench) <= set(near) and len(bench) >= 0.8 * len(near)
    assert set(coded) == set(bench) and all(r.ids for r in coded.values())


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "ids"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding"]


def test_short_copies(spark):
    """A passage of one long line goes from a later document, and a document that is nothing else goes whole."""
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"own\n{passage}"), (2, f"more words\n{passage}"), (3, passage)], "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    out = corpus_pipeline.lines(spark, docs, None).checkpoint()
    assert {r.doc_id: r.text for r in out.collect()} == {1: f"own\n{passage}", 2: "more words", 3: ""}
    assert {r.doc_id for r in out.filter(F.col("text").rlike(r"\S")).collect()} == {1, 2}


def test_odd_rows(spark, sf_dir):
    """Nulls, empty texts, repeated rows and ids, clashing columns and empty tables in every stage."""
    words = lambda a: " ".join(f"{a}{i}" for i in range(40))
    rows = [(None, words("a")), (None, words("a")), (None, words("b")), (1, words("c")), (1, words("c")), (1, words("d")), (2, None), (3, ""), (4, " \n "), (None, None), (5, words("e"))]
    odd = ["_id", "row", "id", "copy", "_kept", "_n_removed", "m", "table", "gone", "component_id"]
    docs = spark.createDataFrame([(*r, "en", "s", 1, *range(10)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in odd))
    texts = lambda df: sorted((str(r.doc_id), str(r.text)[:2]) for r in df.collect())
    near = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert texts(near) == sorted([("None", "a0"), ("None", "b0"), ("1", "c0"), ("1", "d0"), ("2", "No"), ("3", ""), ("4", " \n"), ("None", "No"), ("5", "e0")])
    bench = corpus_pipeline.benchmark(spark, docs, sf_dir)
    assert len(texts(bench)) == 7
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and all(tuple(r)[5:] == tuple(range(10)) for r in out.collect())
        assert stage(spark, docs.filter("false"), sf_dir).count() == 0
    assert corpus_pipeline.encoded(spark, docs, sf_dir).count() == len(rows)


def test_quality_fits_all(spark, tmp_path):
    """The first stage keeps what reaches the threshold of all labelled rows outside the target."""
    rng = random.Random(5)
    held = lambda k: zlib.crc32(str(k).encode()) % quality_rules.FOLDS == 0
    text = lambda n: " ".join(f"{'a' if i < n else 'b'}{rng.randrange(90)}" for i in range(20))
    rows = [(k, text(n := rng.randrange(21)), int(rng.random() * 20 < n)) for k in [k for k in range(60_000) if held(k)][:10_000]]
    rows += [(k, text(20), 1) for k in range(60_000, 60_400) if not held(k)]
    all_rows = spark.createDataFrame(rows, "doc_id long, text string, quality int").cache()
    all_rows.select("doc_id", "quality").write.parquet(f"{tmp_path}/labels.parquet")
    docs, label = all_rows.select("doc_id", "text"), {k: y for k, _, y in rows}
    table = quality_rules.ratios(docs, all_rows.filter("doc_id >= 60000"))
    scores = {r.doc_id: r.score for r in quality_rules.report(docs, table, 0.0).collect()}
    threshold = quality_rules.split_point([(s, label[k]) for k, s in scores.items() if held(k)])
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()} == {k for k, s in scores.items() if s >= threshold}
