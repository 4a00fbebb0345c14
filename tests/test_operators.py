"""Values that the operators must give, rule by rule."""

import datetime
import math
import random
import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foldspark.functions import arrays as A
from foldspark.functions import bitset, bloom, casts
from foldspark.operators import maps as M
from foldspark.operators import parallel, sorting
from foldspark.operators import reducers as R
from foldspark.operators import sequences as S
from foldspark.sources import tables as T
from foldspark.streaming import windows

c = F.col


def numbers(spark, n, parts=3):
    return spark.range(n).select(c("id").alias("v")).repartition(parts)


def values(df, name="v", order="_pos"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_partition_invariance(spark, parts):
    d = numbers(spark, 1000, parts)
    assert values(S.with_pos(d, ["v"]), "_pos") == list(range(1000))
    assert [r.k for r in R.frequencies(d, c("v") % 14).orderBy("k").collect()] == list(range(14))
    assert d.agg(R.lsum().column(c("v")).alias("s")).first().s == 499500
    assert values(S.shift(d, ["v"], 3, "v"), "shifted")[:5] == [0, 0, 0, 0, 1]
    assert values(S.running_sum(S.with_pos(d, ["v"]), c("v"), "s"), "s")[-1] == 499500


def test_groups_and_frequencies(spark):
    d = numbers(spark, 10_000)
    assert R.frequencies(d, c("v") % 113).count() == 113 and R.frequencies(d, c("v") % 337).count() == 337
    f = {r.k: r.n for r in R.frequencies(d, c("v") % 14).collect()}
    assert [f[i] for i in range(14)] == [715] * 4 + [714] * 10
    top = R.frequencies(d, c("v") % 7).agg(R.max_key(c("n"), c("k")).column(c("k")).alias("k")).first().k
    assert top == 3
    assert R.frequencies(d.filter("false"), c("v")).count() == 0


def test_sums(spark):
    d = spark.createDataFrame([(1.0,), (math.nan,), (2.0,), (None,)], "v double")
    one = lambda r: d.agg(r.column(c("v")).alias("x")).first().x
    assert one(R.total()) == 3.0 and math.isnan(one(R.total("keep"))) and one(R.mean()) == 1.5 and one(R.count_of()) == 2
    with pytest.raises(PySparkException):
        one(R.total("exception"))
    with pytest.raises(ValueError):
        R.total("what").column(c("v"))
    none = d.filter("false")
    s = R.reduce_all(none, {k: (r, c("v")) for k, r in R.dsummary().items()}).first()
    assert (s["max"], s["min"], s["n_elems"], s["mean"], s["sum"]) == (-math.inf, math.inf, 0, 0.0, 0.0)
    assert math.isnan(none.agg(R.mean().column(c("v")).alias("x")).first().x)
    assert none.agg(R.max_index(c("v").cast("long")).column(c("v")).alias("x")).first().x == -1
    assert none.agg(R.every(c("v") > 0).alias("x")).first().x is True


def test_function_reducer(spark):
    d = numbers(spark, 1000, 7)
    r = R.FunctionReducer(lambda: 0, lambda a, x: a + x.v, lambda a, b: a + b)
    assert r.reduce(d) == 499500 == sum(r.partials(d))
    assert R.FunctionReducer(lambda: 0, r.update, r.merge, lambda x: -x).reduce(d.filter("false")) == 0
    assert r.merge(r.init(), 7) == 7


def test_casts(spark):
    d = spark.createDataFrame([(0, 0.0), (1, None), (2, math.nan), (3, 2.9)], "i int, v double")
    rows = d.select("i", casts.cast_double(c("v")).alias("x"), casts.cast_bool(c("v")).alias("b")).orderBy("i").collect()
    assert [r.b for r in rows] == [False, False, False, True] and math.isnan(rows[1].x)
    assert d.filter("i = 3").select(casts.cast_long(c("v")).alias("x")).first().x == 2
    for i in (1, 2):
        with pytest.raises(PySparkException):
            d.filter(f"i = {i}").select(casts.cast_long(c("v"))).collect()
    assert d.filter(casts.complement(c("v") > 1)).count() == 2
    m = spark.createDataFrame([("abc",), ("abcd",), (None,)], "s string").select(casts.re_matches(c("s"), "a(b)c").alias("m"), casts.re_matches(c("s"), "a(b)c", 1).alias("g")).collect()
    assert [(r.m, r.g) for r in m] == [("abc", "b"), (None, None), (None, None)]


def test_slices(spark):
    d = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "v int")
    v = lambda df: sorted(r.v for r in df.collect())
    assert v(S.take(d, ["v"], 2)) == [1, 2] and v(S.drop(d, ["v"], 3)) == [4] and v(S.drop(d, ["v"], 10)) == []
    assert v(S.take_last(d, ["v"], 3)) == [2, 3, 4] and v(S.take_last(d, ["v"], 9)) == [1, 2, 3, 4] and v(S.drop_last(d, ["v"], 3)) == [1]
    assert v(S.rest(d, ["v"])) == [2, 3, 4] and v(S.subvec(d, ["v"], 1, 3)) == [2, 3]
    r = random.Random(1)
    big = numbers(spark, 5000)
    for _ in range(3):
        a, b = sorted(r.sample(range(5000), 2))
        assert values(S.subvec(big, ["v"], a, b)) == list(range(a, b))
    ten = numbers(spark, 10)
    hundred = spark.createDataFrame([(100,)] * 3, "v long")
    for at in (5, 10):
        assert values(S.splice(ten, ["v"], at, hundred, ["v"])) == [*range(at), 100, 100, 100, *range(at, 10)]
    assert values(S.concat([(ten, ["v"]), (None, []), (hundred, ["v"])])) == [*range(10), 100, 100, 100]
    assert values(S.reverse(ten, ["v"])) == list(range(9, -1, -1))


def test_array_forms(spark):
    d = spark.range(1).select(F.array(*map(F.lit, range(10))).alias("a"))
    get = lambda col: d.select(col.alias("x")).first().x
    a = c("a")
    assert get(A.take(a, 3)) == [0, 1, 2] and get(A.drop(a, 8)) == [8, 9] and get(A.drop(a, 80)) == [] and get(A.take(a, 80)) == list(range(10))
    assert get(A.take_last(a, 2)) == [8, 9] and get(A.take_last(a, 20)) == list(range(10)) and get(A.drop_last(a, 8)) == [0, 1] and get(A.drop_last(a, 20)) == []
    assert get(A.nth(a, -1)) == 9 and get(A.nth(a, 10)) is None and get(A.subvec(a, 2, 4)) == [2, 3]
    assert get(A.add_constant(a, 5, 3, F.lit(100))) == [0, 1, 2, 3, 4, 100, 100, 100, 5, 6, 7, 8, 9]
    assert get(A.shift(a, 2)) == [0, 0, 0, 1, 2, 3, 4, 5, 6, 7] and get(A.shift(a, -2)) == [2, 3, 4, 5, 6, 7, 8, 9, 9, 9]
    assert get(A.reindex(a, F.array(F.lit(3), F.lit(0)))) == [3, 0] and get(A.every(a, lambda x: x < 10)) is True
    assert get(A.map_indexed(a, lambda i, x: i * x)) == [i * i for i in range(10)]
    m = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    assert get(A.update_values(m, lambda k, v: F.when(v > 1, v * 10))) == {"b": 20} and get(A.keys(m)) == ["a", "b"] and get(A.vals(m)) == [1, 2]


def test_runs(spark):
    d = spark.createDataFrame(list(enumerate([1, 1, 1, 2, 2, 2, 3, 3, 3, 1, None, None])), "i int, v int")
    runs = S.partition_by(d, ["i"], c("v"), "run").groupBy("run").agg(F.count("*").alias("n")).orderBy("run").collect()
    assert [r.n for r in runs] == [3, 3, 3, 1, 2] and [r.run for r in runs] == list(range(5))
    assert sorted(r.i for r in S.dedup_first_by(d, ["i"], c("v")).collect()) == [0, 3, 6, 9, 10]
    assert S.partition_by(d.filter("false"), ["i"], c("v")).count() == 0
    ten = numbers(spark, 10)
    batches = {r._batch: r.vs for r in S.partition_all(ten, ["v"], 3).groupBy("_batch").agg(F.sort_array(F.collect_list("v")).alias("vs")).collect()}
    assert batches == {0: [0, 1, 2], 1: [3, 4, 5], 2: [6, 7, 8], 3: [9]}
    slid = {r._batch: r.vs for r in S.partition_all(ten, ["v"], 3, 2).groupBy("_batch").agg(F.sort_array(F.collect_list("v")).alias("vs")).collect()}
    assert slid == {i: list(range(2 * i, min(10, 2 * i + 3))) for i in range(5)}
    gaps = {r._batch: r.vs for r in S.partition_all(ten, ["v"], 2, 4).groupBy("_batch").agg(F.sort_array(F.collect_list("v")).alias("vs")).collect()}
    assert gaps == {0: [0, 1], 1: [4, 5], 2: [8, 9]}
    assert sorted(r.v for r in S.take_while(ten, c("v"), c("v") < 4).collect()) == [0, 1, 2, 3] and S.take_while(ten, c("v"), c("v") < 40).count() == 10
    assert S.cost_batches([1, 1, 1, 1, 1], 4) == [0, 0, 1, 1, 1] and S.cost_batches([9, 1, 9], 4) == [0, 1, 1]
    assert S.cost_batches([], 4) == []


def test_maps(spark):
    a = T.entries(spark, [("a", 2), ("b", 2), (None, 5)], "k string, v int")
    b = T.entries(spark, [("b", 7), ("c", None), (None, 1)], "k string, v int")
    as_dict = lambda df: {r.k: r.v for r in df.collect()}
    assert as_dict(M.union(a, b, lambda x, y: x + y)) == {"a": 2, "b": 9, "c": None, None: 6}
    assert as_dict(M.merge(a, None, b)) == {"a": 2, "b": 7, "c": None, None: 1}
    assert as_dict(M.merge_with(F.sum, a, b)) == {"a": 2, "b": 9, "c": None, None: 6}
    assert as_dict(M.difference(a, b)) == {"a": 2} and as_dict(M.difference(a, None)) == as_dict(a)
    assert as_dict(M.intersection(a, b)) == {"b": 7, None: 1} and as_dict(M.trimmed(a, b.select("k"))) == {"b": 2, None: 5}
    assert as_dict(M.intersection(a, T.entries(spark, [("a", None)], "k string, v int"))) == {"a": None}
    assert as_dict(M.update_values(a, lambda k, v: F.lit(False))) == {"a": False, "b": False, None: False}
    assert as_dict(M.upsert(a, b, lambda old, new: F.when(new > 1, new))) == {"a": 2, "b": 7}
    assert as_dict(M.keyed(T.entries(spark, [(1, 1, 0), (1, 2, 1)], "k int, v int, p int"), c("k"), c("v"), c("p"))) == {1: 2}
    r = random.Random(3)
    x, y = (T.entries(spark, [(r.randrange(10**9) * 2 + i, j) for j in range(50)], "k long, v long") for i in (0, 1))
    u = M.union(x, y, lambda p, q: p + q)
    assert u.count() == 100 and M.union(u, y, lambda p, q: p + q).agg(F.sum("v")).first()[0] == 3 * 1225
    assert M.intersection(x, y).count() == 0 and M.difference(x, x.limit(25)).count() == 25


def test_sets(spark):
    s = lambda *v: spark.createDataFrame([(x,) for x in v], "v string")
    got = lambda df: sorted((r.v for r in df.collect()), key=str)
    a, b = s("a", "b", "c", "c", None), s("c", "d", None)
    assert got(M.set_difference(a, b)) == ["a", "b"] and got(M.set_intersection(a, b)) == [None, "c"] and got(M.set_union(a, b)) == [None, "a", "b", "c", "d"]
    assert got(M.set_xor(a, b)) == ["a", "b", "d"] and got(M.intersect_sets(a, b, s("c", "x"))) == ["c"] and got(M.intersect_sets(a, s())) == []


def test_sorts(spark):
    d = spark.createDataFrame([(0, 1.0), (1, math.nan), (2, None), (3, -1.0)], "i int, v double")
    order = lambda df: [r.i for r in df.collect()]
    assert order(sorting.sort(d, c("v"))) == [3, 0, 1, 2] and order(sorting.sort_by(d, [sorting.descending(c("v"))])) == [1, 0, 3, 2]
    assert set(order(d.orderBy(*sorting.nan_first(c("v"))).limit(2))) == {1, 2}
    assert [r._index for r in sorting.argsort(d, ["i"], c("v")).orderBy("_pos").collect()] == [3, 0, 1, 2]
    h = numbers(spark, 100)
    at = lambda x: h.agg(sorting.binary_search(c("v"), F.lit(x)).alias("x")).first().x
    assert [at(50), at(50.1), at(-1), at(120)] == [50, 51, 0, 100]
    assert sorted(r.v for r in sorting.take_min(h, 3, ["v"]).collect()) == [0, 1, 2] and sorting.drop_min(h, 3, ["v"]).count() == 97
    assert [r.v for r in sorting.shuffle(h, 7).collect()] != list(range(100)) and sorting.shuffle(h, 7).count() == 100


def test_bloom(spark):
    assert bloom.bytes_for(10**6, 0.01) == 2 << 20 and bloom.bytes_for(1, 0.01) == 32
    r = random.Random(5)
    ids = [(str(uuid.UUID(int=r.getrandbits(128))), i % 2) for i in range(40_000)]
    d = spark.createDataFrame(ids, "u string, side int")
    held = bloom.build(d.filter("side = 0"), c("u"), 20_000, 0.01)
    hit = {r.side: r.n for r in bloom.probe(d, c("u"), held).filter("maybe").groupBy("side").agg(F.count("*").alias("n")).collect()}
    assert hit[0] == 20_000 and hit.get(1, 0) < 200


def test_sources(spark, tmp_path):
    assert [r.value for r in T.numbers(spark, 0, 10, 3).orderBy("_pos").collect()] == [0, 3, 6]
    assert [r.value for r in T.numbers(spark, 0, 10, 3, ceil=True).orderBy("_pos").collect()] == [0, 3, 6, 9]
    assert [r.value for r in T.numbers(spark, 1.0, 2.0, 0.5).orderBy("_pos").collect()] == [1.0, 1.5] and T.numbers(spark, 5, 0).count() == 0
    (tmp_path / "a.txt").write_text("one\ntwo\n\n")
    assert sorted(r.value for r in T.lines(spark, str(tmp_path / "a.txt")).collect()) == ["", "one", "two"]
    assert T.repeatedly(spark, 5, F.rand()).distinct().count() == 5 and T.empty(spark, "v int").count() == 0
    assert sorted(r.value for r in T.piped(T.lines(spark, str(tmp_path / "a.txt")).filter("value <> ''"), "tr a-z A-Z").collect()) == ["ONE", "TWO"]


def test_parallel(spark):
    assert [r.value for r in parallel.pgroups(spark, 25, 10, lambda a, b: b - a, "long").orderBy("group").collect()] == [10, 10, 5]
    out = parallel.pmap(numbers(spark, 10), lambda x: x + 1, "v long", parallel.Options(parallelism=2, max_batch_size=3))
    assert sorted(r.v for r in out.collect()) == list(range(1, 11)) and not parallel.in_task()

    def bad(x):
        raise ValueError("Error!!")

    with pytest.raises(PySparkException, match="Error!!"):
        parallel.pmap(numbers(spark, 3), bad, "v long").collect()


def test_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    for i in range(3):
        rows = [(t + datetime.timedelta(minutes=20 * j), "ab"[j % 2], float(j)) for j in range(4 * i, 4 * i + 4)]
        spark.createDataFrame(rows, "ts timestamp, k string, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    out = windows.run_once(windows.windowed(windows.stream(spark, str(tmp_path / "in"), schema), "ts", "k", "v"), "counts")
    assert sum(r.n for r in out.collect()) == 12 and sum(r.total for r in out.collect()) == 66


def test_more_points(spark):
    a = T.entries(spark, [("a", 2), (None, 5)], "k string, v int")
    b = T.entries(spark, [("b", 7), (None, 1), ("a", None)], "k string, v int")
    as_dict = lambda df: {r.k: r.v for r in df.collect()}
    assert as_dict(M.compute_if_present(a, b, lambda old, new: old + new)) == {None: 6}
    assert as_dict(M.compute_if_absent(a, b)) == {"a": 2, None: 5, "b": 7}
    got = M.with_membership(a, c("k"), b.filter("k is null").select("k")).collect()
    assert {r.k: r.member for r in got} == {"a": False, None: True}
    head, rest = S.split_while(numbers(spark, 10), c("v"), c("v") < 4)
    assert head.count() == 4 and sorted(r.v for r in rest.collect()) == [4, 5, 6, 7, 8, 9]
    assert S.predicate_runs([1, 2, 3, 4, 1, 1], lambda a, b: abs(a - b) <= 1) == [0, 0, 1, 1, 2, 2]
    assert values(S.add_constant(numbers(spark, 3), ["v"], 3, 2, {"v": F.lit(9)})) == [0, 1, 2, 9, 9]
    assert sorted(r.value for r in bitset.span(a, -2, 3).collect()) == [0, 1, 2]
    seen = spark.sparkContext.accumulator(0)
    parallel.consume(numbers(spark, 10), lambda: lambda r: seen.add(r.v))
    assert seen.value == 45


def test_positions_of_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(S, "FEW_PARTITIONS", 1)
    d = S.with_pos(numbers(spark, 5000, 6), ["v"])
    assert d.columns == ["v", "_pos"] and values(d, "_pos") == values(d) == list(range(5000))


def test_folds_over_partitions(spark):
    """Batches by cost and runs by a predicate, over many partitions, as a fold over a list gives them."""
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 1, 2, 5, 40])) for i in range(3000)]
    values = [x for _, x in rows]
    df = spark.createDataFrame(rows, "k long, x long").repartition(9)
    for most in (4, 50, 10**9):
        got = [r._batch for r in S.partition_by_cost(df, ["k"], "x", most).orderBy("k").collect()]
        assert got == S.cost_batches(values, most)
    for near in (0, 1, 3):
        same = lambda a, b, near=near: abs(a - b) <= near
        got = [r._run for r in S.partition_by_predicate(df, ["k"], "x", same).orderBy("k").collect()]
        assert got == S.predicate_runs(values, same)
    assert S.partition_by_cost(df.filter("false"), ["k"], "x", 4).count() == 0


def test_ordered_reduce(spark):
    """Merges that don't commute: many partitions, through several levels; the initial value without rows."""
    text = R.FunctionReducer(str, lambda a, x: a + str(x.id % 10), lambda a, b: a + b)
    df = spark.range(0, 1000, 1, 200)
    assert text.reduce(df) == "".join(str(i % 10) for i in range(1000)) == "".join(text.partials(df))
    assert text.reduce(df.repartition(30), [F.col("id").desc()]) == "".join(str(i % 10) for i in reversed(range(1000)))
    assert R.FunctionReducer(lambda: 1, lambda a, x: a + x.id, lambda a, b: a + b).reduce(df.filter("false")) == 1


def test_large_states(spark):
    """States that grow with the rows: cut at a block in one partition, merged by batches, and a result that the driver doesn't see."""
    text = R.FunctionReducer(bytearray, lambda a, x: a.extend(b"%0100d" % x.id) or a, lambda a, b: a.extend(b) or a, bytes)
    want = b"".join(b"%0100d" % i for i in range(300_000))
    df = spark.range(0, 300_000, 1, 1)
    sizes = [r.n for r in text.folded(df).select(F.length("state").alias("n")).collect()]
    assert max(sizes) <= 12 << 20 < sum(sizes)
    assert text.reduce(df) == want == b"".join(text.partials(df))
    small = R.FunctionReducer(text.init, text.update, text.merge, text.finalize, 100_000)
    for d, order in ((spark.range(0, 300_000, 1, 200), None), (df.repartition(3), ["id"])):
        states = small.merged(d, order).select("part", F.length("state").alias("n")).collect()
        # two batches of 10,000 rows are the least that a state may hold
        assert max(r.n for r in states) <= 2_100_000
        assert small.reduced(d, "v binary", order).first().v == want
        assert small.reduce(d, order) == want
    # a state that is large from the first on, and stays so, is one
    fixed = R.FunctionReducer(lambda: bytes(200_000), lambda a, x: a, lambda a, b: a, len, 100_000)
    assert fixed.folded(df).select("part", "seq").collect() == [(0, 0)]
    assert [tuple(r) for r in fixed.merged(spark.range(0, 1000, 1, 200)).select("part", "seq").orderBy("part").collect()] == [(i, 0) for i in range(4)]


def test_reduced(spark):
    """One row in any case: from many partitions, from none, and null."""
    r = R.FunctionReducer(lambda: 0, lambda a, x: a + x.id, lambda a, b: a + b, lambda a: a or None)
    for df in (spark.range(0, 1000, 1, 200), spark.range(0, 1000, 1, 1)):
        assert r.reduced(df, "n long").collect() == [(499500,)] and r.reduced(df, "n long", ["id"]).collect() == [(499500,)]
    for order in (None, ["id"]):
        assert r.reduced(spark.range(10).filter("id > 10"), "n long", order).collect() == [(None,)]
        assert r.reduced(spark.range(0), "n long", order).collect() == [(None,)]
