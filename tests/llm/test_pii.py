import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from foldspark.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def digits(s):
    return sum(c in "0123456789" for c in s)


def brute(text):
    t = text or ""
    out = [[(m.start(), m.end()) for m in p.finditer(t) if ok(m[0])] for p, ok in (
        (EMAIL, lambda s: True), (IP, lambda s: all(int(x) <= 255 for x in s.split("."))), (CARD, lambda s: 14 <= digits(s) <= 19 and luhn(s)), (PHONE, lambda s: 10 <= digits(s) <= 15))]
    spans = sorted((a, k, b) for k, x in enumerate(out) for a, b in x)
    s = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return (*map(len, out), hashlib.sha256(s.encode()).hexdigest(), s)


def run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, email string, rid int")
    return {r.doc_id: tuple(r)[1:] for r in pii.digest(pii.detect(df, **kw)).collect()}


def test_patterns(spark):
    rng = random.Random(5)
    bits = ["a", "b.c", "@", ".", "@x.org", "ü", "😀", " ", "  ", "-", "+", "1", "23", "4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005", "10.0.0.1", "256.1.1.1", "001.002.3.4.5.6.7.8", "+1 (555) 123-4567", "\n", "%", "_", "(", ")", "+49.30.12345678", "me@a-b.co.uk", "x@y", "..", "9" * 20]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    texts += [None, "", "1 " * 60_000, "1" * 100_000, "a.b" * 50_000 + "@" + "c." * 40_000 + "d", "+" * 20_000 + "1" * 12, "1." * 50_000 + "1"]
    got = run(spark, texts, support=10**9)
    for i, t in enumerate(texts):
        assert got[i] == brute(t), (t or "")[:200]


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:6] for r in pii.digest(pii.detect(docs)).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == brute(r.text)[:5]


def test_terms(spark):
    texts = [f"line {i} common words\nZyx{i} quorble writes from bob@x.org today {i * 7}" for i in range(6)]
    texts += [f"only common words today {i} and nothing else writes from line" for i in range(60)] + ["copy ann@y.org unique"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.detect(df)
    rows = {r.doc_id: r.spans for r in pii.digest(found).collect()}
    at = texts[0].index("quorble")
    assert f"term:{at}:{at + 7}" in rows[0] and rows[0].count("term") == 1
    assert rows[30] == "" and rows[68].count("term") == 0
    text = {r.doc_id: r.c for r in found.withColumn("c", pii.clean(found)).select("doc_id", "c").collect()}
    assert text[0] == "line 0 common words\nZyx0 [TERM] writes from [EMAIL] today 0" and text[30] is None
    assert pii.digest(pii.detect(df.filter(F.lit(False)))).count() == 0


def test_rare_values(spark):
    """A term that stands only beside a value seen once is a span where the table is large enough; common words are none."""
    texts = [f"plain words of line {i % 40}" for i in range(1200)] + ["plain gruzel words ann@y.org line"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.detect(df)).filter("spans <> ''").collect()}
    assert got == {1200: "term:6:12,email:19:28"}
    few = df.filter("doc_id >= 1000")
    assert {r.doc_id: r.spans for r in pii.digest(pii.detect(few)).filter("spans <> ''").collect()} == {1200: "email:19:28"}


def test_terms_without_value(spark):
    """A disclosing term is a span in a document that lacks the value, too, and clean() has its text."""
    texts = [f"words {i}\nquorble writes from bob@x.org" for i in range(6)] + [f"writes from words {i}" for i in range(60)] + ["Quorble from far"]
    texts[:6] = [t.replace("writes", f"writes {i}") for i, t in enumerate(texts[:6])]
    found = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = {r.doc_id: (r.spans, r.c) for r in found.select("doc_id", pii.joined(F.concat(*pii.KINDS, "term")).alias("spans"), pii.clean(found).alias("c")).collect()}
    assert rows[66] == ("term:0:7", "[TERM] from far") and rows[30] == ("", None)
    assert "term:" in rows[0][0]


def test_long_texts(spark):
    """Time in proportion to the length: many values, many lines, one line; twice the text takes about twice as long."""
    def seconds(n):
        texts = [" ".join(f"u{i}@x.org" for i in range(n)), "\n".join(f"w{i} u{i}@y.org 10.0.{i % 256}.1" for i in range(n // 2))]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").checkpoint()
        t = time.time()
        found = pii.detect(df)
        got = {r.doc_id: (r.n_email, r.n_ip, r.base_sha256) for r in pii.digest(found).collect()}
        assert got == {i: (*brute(t)[:2], brute(t)[4]) for i, t in enumerate(texts)}
        assert found.select(F.length(pii.clean(found)).alias("n")).agg(F.min("n")).first()[0] >= 8 * n // 2
        return time.time() - t

    seconds(1000)
    one, four = seconds(15_000), seconds(60_000)
    assert four < 8 * one + 10, (one, four)


def test_overlaps(spark):
    """Terms inside values are none, on either side of a bound."""
    rng = random.Random(2)
    for _ in range(3):
        spans = sorted(rng.sample(range(60), 12))
        term = [(a, 4, b, "t") for a, b in zip(spans[::2], spans[1::2], strict=True)]
        base = [(a, rng.randrange(4), a + rng.randrange(1, 8), "b") for a in rng.sample(range(60), 4)]
        df = spark.createDataFrame([(term, base)], "term array<struct<start:bigint,rank:int,stop:bigint,value:string>>, base array<struct<start:bigint,rank:int,stop:bigint,value:string>>")
        got = [tuple(x) for x in df.select(pii.outside(F.col("term"), F.col("base"))).first()[0]]
        assert got == [t for t in term if not any(b[0] < t[2] and t[0] < b[2] for b in base)]
