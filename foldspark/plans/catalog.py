"""The algebra's operators as queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.functions import arrays as A
from foldspark.functions import bitset, bloom, casts
from foldspark.operators import maps as M
from foldspark.operators import parallel, sorting
from foldspark.operators import reducers as R
from foldspark.operators import sequences as S
from foldspark.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NAN = float("nan")
c = F.col


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return T.table(spark, sf_dir, name)


def with_nan(events: DataFrame) -> DataFrame:
    """events with NaN and null put into ``v``."""
    return events.withColumn("v", F.when(c("event_id") % 7 == 0, NAN).when(c("event_id") % 11 == 0, None).otherwise(c("value")))


NAN_SQL = "SELECT *, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS v FROM events"
POS_SQL = "SELECT *, row_number() OVER (ORDER BY {1}) - 1 AS _pos FROM {0}"


def positions(table: str, order: str) -> str:
    return "(" + POS_SQL.format(table, order) + ")"


# ---- reducers


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 4) AS mean_qty, count(*) AS n
FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-01' GROUP BY 1, 2""")
def compose_reducers_by_key(spark, d):
    rows = read(spark, d, "lineitem").filter(c("l_shipdate") < F.lit("1998-09-01").cast("timestamp_ntz"))
    price = c("l_extendedprice") * (1 - c("l_discount"))
    reducers = {"sum_qty": (R.total_fast(), c("l_quantity")), "sum_price": (R.total_fast(), c("l_extendedprice")), "sum_disc_price": (R.total_fast(), price), "mean_qty": (R.mean("keep"), c("l_quantity"))}
    reducers = {k: (r.finalized(lambda x, k=k: F.round(x, 4 if k == "mean_qty" else 2)), x) for k, (r, x) in reducers.items()}
    return R.group_reduce(rows, {"l_returnflag": c("l_returnflag"), "l_linestatus": c("l_linestatus")}, reducers | {"n": (R.rows(), c("l_quantity"))})


@query("SELECT round(sum(l_tax), 2) AS a, round(avg(l_discount), 6) AS b, count(*) AS c, max(l_quantity) AS d FROM lineitem")
def preduce_reducers_global(spark, d):
    return R.reduce_all(read(spark, d, "lineitem"), {"a": (R.total_fast().finalized(lambda x: F.round(x, 2)), c("l_tax")), "b": (R.mean().finalized(lambda x: F.round(x, 6)), c("l_discount")), "c": (R.rows(), c("l_tax")), "d": (R.dsummary()["max"], c("l_quantity"))})


@query(f"SELECT round(coalesce(sum(v) FILTER (WHERE NOT isnan(v)), 0.0), 2) AS s FROM ({NAN_SQL})")
def sum_nan_remove(spark, d):
    return with_nan(read(spark, d, "events")).agg(F.round(R.total("remove").column(c("v")), 2).alias("s"))


@query(f"SELECT sum(coalesce(v, 'NaN'::DOUBLE)) AS s FROM ({NAN_SQL})")
def sum_nan_keep(spark, d):
    return with_nan(read(spark, d, "events")).agg(R.total("keep").column(c("v")).alias("s"))


@query("SELECT round(sum(value), 2) AS s FROM events")
def sum_nan_exception(spark, d):
    return read(spark, d, "events").agg(F.round(R.total("exception").column(c("value")), 2).alias("s"))


@query("SELECT round(sum(l_extendedprice), 2) AS s FROM lineitem")
def sum_fast(spark, d):
    return read(spark, d, "lineitem").agg(F.round(R.total_fast().column(c("l_extendedprice")), 2).alias("s"))


@query(f"SELECT round(sum(v) FILTER (WHERE NOT isnan(v)), 2) AS s, count(v) FILTER (WHERE NOT isnan(v)) AS n FROM ({NAN_SQL})")
def sum_stable_nelems(spark, d):
    return R.reduce_all(with_nan(read(spark, d, "events")), {"s": (R.total().finalized(lambda x: F.round(x, 2)), c("v")), "n": (R.count_of(), c("v"))})


@query(f"SELECT round(avg(v) FILTER (WHERE NOT isnan(v)), 6) AS m FROM ({NAN_SQL})")
def mean(spark, d):
    return with_nan(read(spark, d, "events")).agg(F.round(R.mean().column(c("v")), 6).alias("m"))


@query("SELECT CAST(sum(o_custkey) AS BIGINT) AS s FROM orders")
def lsum(spark, d):
    return read(spark, d, "orders").agg(R.lsum().column(c("o_custkey")).alias("s"))


@query('SELECT max(o_custkey) AS "max", min(o_custkey) AS "min", count(*) AS n_elems, round(avg(o_custkey), 6) AS mean, CAST(sum(o_custkey) AS BIGINT) AS "sum" FROM orders')
def lsummary(spark, d):
    r = R.lsummary()
    r["mean"] = r["mean"].finalized(lambda x: F.round(x, 6))
    return R.reduce_all(read(spark, d, "orders"), {k: (v, c("o_custkey")) for k, v in r.items()})


@query(f"""SELECT CASE WHEN bool_or(isnan(v)) THEN 'NaN'::DOUBLE ELSE max(v) END AS "max", CASE WHEN bool_or(isnan(v)) THEN 'NaN'::DOUBLE ELSE min(v) END AS "min", count(v) AS n_elems, avg(v) AS mean, sum(v) AS "sum" FROM ({NAN_SQL})""")
def dsummary(spark, d):
    return R.reduce_all(with_nan(read(spark, d, "events")), {k: (v, c("v")) for k, v in R.dsummary().items()})


@query("SELECT 0.0::DOUBLE AS s, 0 AS n, 'NaN'::DOUBLE AS m, -9223372036854775808 AS top")
def empty_reductions(spark, d):
    none = read(spark, d, "orders").filter("false")
    return R.reduce_all(none, {"s": (R.total(), c("o_totalprice")), "n": (R.rows(), c("o_totalprice")), "m": (R.mean(), c("o_totalprice")), "top": (R.lsummary()["max"], c("o_custkey"))}).withColumn("n", c("n").cast("int"))


@query("SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1")
def frequencies(spark, d):
    return R.frequencies(read(spark, d, "events"), c("event_type"))


@query("SELECT CASE WHEN user_id % 3 = 0 THEN NULL ELSE event_type END AS k, count(*) AS n FROM events GROUP BY 1")
def frequencies_null_key(spark, d):
    return R.frequencies(read(spark, d, "events"), F.when(c("user_id") % 3 != 0, c("event_type")))


@query("SELECT o_orderpriority AS m FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def mode(spark, d):
    return read(spark, d, "orders").agg(R.mode().column(c("o_orderpriority")).alias("m"))


def _extremes(spark, d, reducer: R.Reducer, x: Column) -> DataFrame:
    return read(spark, d, "orders").agg(reducer.column(x).alias("k"))


@query("SELECT o_orderkey AS k FROM orders ORDER BY CAST(floor(o_totalprice / 1000) AS BIGINT) DESC, o_orderkey DESC LIMIT 1")
def mmax_key(spark, d):
    return _extremes(spark, d, R.max_key(F.floor(c("o_totalprice") / 1000), c("o_orderkey")), c("o_orderkey"))


@query("SELECT o_orderkey AS k FROM orders ORDER BY CAST(floor(o_totalprice / 1000) AS BIGINT), o_orderkey DESC LIMIT 1")
def mmin_key(spark, d):
    return _extremes(spark, d, R.min_key(F.floor(c("o_totalprice") / 1000), c("o_orderkey")), c("o_orderkey"))


@query(f"SELECT _pos AS k FROM {positions('orders', 'o_orderkey')} ORDER BY floor(o_totalprice / 1000) DESC, _pos DESC LIMIT 1")
def mmax_idx(spark, d):
    return S.with_pos(read(spark, d, "orders"), ["o_orderkey"]).agg(R.max_index(c("_pos")).column(F.floor(c("o_totalprice") / 1000)).alias("k"))


@query(f"SELECT _pos AS k FROM {positions('orders', 'o_orderkey')} ORDER BY floor(o_totalprice / 1000), _pos DESC LIMIT 1")
def mmin_idx(spark, d):
    return S.with_pos(read(spark, d, "orders"), ["o_orderkey"]).agg(R.min_index(c("_pos")).column(F.floor(c("o_totalprice") / 1000)).alias("k"))


@query("SELECT n_regionkey AS k, string_agg(n_name, ',' ORDER BY n_nationkey) AS vs FROM nation GROUP BY 1")
def group_by_vectors(spark, d):
    return R.group_by(read(spark, d, "nation"), c("n_regionkey"), c("n_name"), c("n_nationkey")).select("k", F.array_join("vs", ",").alias("vs"))


@query("SELECT l_suppkey % 113 AS k, round(sum(l_quantity), 2) AS s, count(*) AS n FROM lineitem GROUP BY 1")
def group_by_reduce(spark, d):
    return R.group_reduce(read(spark, d, "lineitem"), {"k": c("l_suppkey") % 113}, {"s": (R.total_fast().finalized(lambda x: F.round(x, 2)), c("l_quantity")), "n": (R.rows(), c("l_quantity"))})


@query("SELECT event_type AS k, count(*) AS n, row_number() OVER (ORDER BY min(event_id)) - 1 AS _order FROM events GROUP BY 1")
def group_by_consumer_order(spark, d):
    out = R.group_in_order(read(spark, d, "events"), {"k": c("event_type")}, {"n": (R.rows(), c("value"))}, c("event_id"))
    return S.with_pos(out, ["_first"], "_order").drop("_first")


@query("SELECT l_returnflag AS k, round(coalesce(sum(l_quantity * 2) FILTER (WHERE l_discount > 0.05), 0), 2) AS s, count(*) FILTER (WHERE l_tax > 0.04) AS n FROM lineitem GROUP BY 1")
def reducer_xform(spark, d):
    s = R.total().mapped(lambda x: x * 2).where(c("l_discount") > 0.05).finalized(lambda x: F.round(x, 2))
    return R.group_reduce(read(spark, d, "lineitem"), {"k": c("l_returnflag")}, {"s": (s, c("l_quantity")), "n": (R.count_of().where(c("l_tax") > 0.04), c("l_quantity"))})


@query("SELECT DISTINCT o_custkey AS k FROM orders")
def unique(spark, d):
    return read(spark, d, "orders").select(c("o_custkey").alias("k")).distinct()


@query("SELECT o_orderpriority AS k, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS vs, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def unique_per_group(spark, d):
    return R.group_reduce(read(spark, d, "orders"), {"k": c("o_orderpriority")}, {"vs": (R.unique().finalized(lambda a: F.array_join(a, ",")), c("o_orderstatus")), "n": (R.cardinality(), c("o_custkey"))})


@query("SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
def cardinality(spark, d):
    return read(spark, d, "lineitem").agg(R.cardinality().column(c("l_partkey")).alias("n"))


@query("SELECT count(*) AS n FROM lineitem")
def count_rows(spark, d):
    return read(spark, d, "lineitem").agg(R.rows().column(F.lit(1)).alias("n"))


# ---- maps and filters


@query("SELECT l_orderkey AS k, round(l_extendedprice * (1 + l_tax), 4) AS v FROM lineitem WHERE l_quantity > 25 AND l_discount < 0.05")
def map_filter_chain(spark, d):
    return read(spark, d, "lineitem").filter(c("l_quantity") > 25).filter(c("l_discount") < 0.05).select(c("l_orderkey").alias("k"), F.round(c("l_extendedprice") * (1 + c("l_tax")), 4).alias("v"))


@query(f"SELECT event_id FROM ({NAN_SQL}) WHERE NOT coalesce(v > 50 AND NOT isnan(v), false)")
def remove_pred(spark, d):
    return with_nan(read(spark, d, "events")).filter(casts.complement((c("v") > 50) & ~F.isnan("v"))).select("event_id")


@query(f"SELECT event_id, CASE WHEN v IS NULL OR isnan(v) OR v = 0 THEN false ELSE true END AS b FROM ({NAN_SQL})")
def cast_bool(spark, d):
    return with_nan(read(spark, d, "events")).select("event_id", casts.cast_bool(c("v")).alias("b"))


@query(f"SELECT event_id, coalesce(v, 'NaN'::DOUBLE) AS x FROM ({NAN_SQL})")
def cast_double(spark, d):
    return with_nan(read(spark, d, "events")).select("event_id", casts.cast_double(c("v")).alias("x"))


@query("SELECT event_id, CAST(trunc(value) AS BIGINT) AS x FROM events")
def cast_long(spark, d):
    return read(spark, d, "events").select("event_id", casts.cast_long(c("value")).alias("x"))


@query(f"SELECT p_partkey, _pos * p_size AS value FROM {positions('part', 'p_partkey')}")
def map_indexed(spark, d):
    return S.map_indexed(read(spark, d, "part"), ["p_partkey"], lambda i: i * c("p_size")).select("p_partkey", "value")


@query(f"""SELECT a._pos AS _pos, a.p_size * 1000 + b.s_nationkey AS value FROM {positions('part', 'p_partkey')} a
JOIN {positions('supplier', 's_suppkey')} b ON a._pos = b._pos""")
def tuple_map_zip(spark, d):
    a = read(spark, d, "part").select("p_partkey", c("p_size").alias("v"))
    b = read(spark, d, "supplier").select("s_suppkey", c("s_nationkey").alias("v"))
    return S.zip_map([(a, ["p_partkey"]), (b, ["s_suppkey"])], lambda x, y: x * 1000 + y)


@query("SELECT l_returnflag AS k, bool_and(l_quantity > 1) AS b FROM lineitem GROUP BY 1 UNION ALL SELECT 'none', true")
def every_pred(spark, d):
    rows = read(spark, d, "lineitem")
    none = rows.filter("false").agg(R.every(c("l_quantity") > 1).alias("b")).select(F.lit("none").alias("k"), "b")
    return rows.groupBy(c("l_returnflag").alias("k")).agg(R.every(c("l_quantity") > 1).alias("b")).union(none)


@query("SELECT r_name || '/' || n_name AS v FROM region CROSS JOIN nation")
def cartesian_map(spark, d):
    return M.cartesian(read(spark, d, "region"), read(spark, d, "nation")).select(F.concat_ws("/", "r_name", "n_name").alias("v"))


@query("SELECT p_partkey, nullif(regexp_extract(p_name, '^([a-z]+) .*$', 1), '') AS g FROM part")
def re_matches(spark, d):
    return read(spark, d, "part").select("p_partkey", casts.re_matches(c("p_name"), "([a-z]+) .*", 1).alias("g"))


@query("""SELECT vec_id, list_sum(list_transform(embedding[1:8], lambda x: round(x::DOUBLE, 3))) > 0 AS pos, len(embedding[61:64]) AS n,
round(embedding[64]::DOUBLE, 4) AS z, round(embedding[1]::DOUBLE, 4) AS a FROM embeddings""")
def array_sequence(spark, d):
    e = c("embedding")
    total = F.aggregate(A.take(e, 8), F.lit(0.0), lambda x, y: x + F.round(y.cast("double"), 3))
    return read(spark, d, "embeddings").select("vec_id", (total > 0).alias("pos"), F.size(A.take_last(e, 4)).cast("long").alias("n"), F.round(A.nth(e, -1).cast("double"), 4).alias("z"), F.round(F.get(A.shift(e, 3), 2).cast("double"), 4).alias("a"))


# ---- keyed frames


def _by_nation(spark, d) -> tuple[DataFrame, DataFrame]:
    """Counts by nation, each with a null key."""
    a = read(spark, d, "customer").groupBy(F.when(c("c_nationkey") != 3, c("c_nationkey")).alias("k")).agg(F.count("*").alias("v"))
    b = read(spark, d, "supplier").groupBy(F.when(c("s_nationkey") > 4, c("s_nationkey")).alias("k")).agg(F.count("*").alias("v"))
    return a, b


TWO = """WITH a AS (SELECT CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS k, count(*) AS v FROM customer GROUP BY 1),
b AS (SELECT CASE WHEN s_nationkey > 4 THEN s_nationkey END AS k, count(*) AS v FROM supplier GROUP BY 1) """


@query(TWO + "SELECT k, CAST(sum(v) AS BIGINT) AS v FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1")
def map_union_sum(spark, d):
    return M.union(*_by_nation(spark, d), lambda x, y: x + y)


@query(TWO + "SELECT k, arg_max(v, s) AS v FROM (SELECT *, 0 AS s FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY 1")
def merge_rhs_wins(spark, d):
    return M.merge(*_by_nation(spark, d), None)


@query(TWO + "SELECT k, max(v) AS v FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT k, v * 2 FROM b) GROUP BY 1")
def merge_with_n(spark, d):
    a, b = _by_nation(spark, d)
    return M.merge_with(F.max, a, b, b.withColumn("v", c("v") * 2))


@query(TWO + "SELECT a.k, a.v * 1000 + b.v AS v FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def map_intersection(spark, d):
    return M.intersection(*_by_nation(spark, d), lambda x, y: x * 1000 + y)


@query(TWO + "SELECT k, v FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.k IS NOT DISTINCT FROM b.k)")
def map_difference(spark, d):
    return M.difference(*_by_nation(spark, d))


@query(TWO + "SELECT k, v FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.k IS NOT DISTINCT FROM b.k)")
def map_set_trim(spark, d):
    return M.trimmed(*_by_nation(spark, d))


@query(TWO + """SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.v IS NULL THEN a.v ELSE coalesce(a.v, 0) + b.v END AS v FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k
WHERE b.v IS NULL OR b.v < 3 OR a.v IS NULL""")
def compute_upsert(spark, d):
    return M.upsert(*_by_nation(spark, d), lambda old, new: F.when((new < 3) | old.isNull(), F.coalesce(old, F.lit(0)) + new))


def _nations(spark, d) -> DataFrame:
    return read(spark, d, "nation").select(c("n_nationkey").alias("k"), c("n_name").alias("v"))


@query("SELECT n_nationkey AS k, lower(n_name) AS v FROM nation WHERE n_nationkey % 3 <> 0")
def update_values_drop_nil(spark, d):
    return M.update_values(_nations(spark, d), lambda k, v: F.when(k % 3 != 0, F.lower(v)))


@query("SELECT substr(n_name, 1, 1) AS k, arg_max(n_nationkey, n_nationkey) AS v FROM nation WHERE n_nationkey <> 5 GROUP BY 1")
def mapmap(spark, d):
    return M.mapmap(_nations(spark, d), F.substring("v", 1, 1), c("k"), c("k"), c("k") != 5)


@query("SELECT n_regionkey AS k, max(n_nationkey) AS v FROM nation GROUP BY 1")
def map_invert(spark, d):
    return M.invert(read(spark, d, "nation").select(c("n_nationkey").alias("k"), c("n_regionkey").alias("v")))


@query("SELECT n_nationkey AS k FROM nation")
def keys(spark, d):
    return _nations(spark, d).select("k")


@query("SELECT n_name AS v FROM nation")
def vals(spark, d):
    return _nations(spark, d).select("v")


@query("SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1")
def map_last_wins(spark, d):
    return M.keyed(read(spark, d, "orders"), c("o_custkey"), c("o_totalprice"), c("o_orderkey"))


def _sets(spark, d) -> tuple[DataFrame, DataFrame]:
    return read(spark, d, "orders").select(c("o_custkey").alias("k")), read(spark, d, "customer").select((c("c_custkey") + c("c_nationkey")).alias("k"))


SETS = "WITH a AS (SELECT o_custkey AS k FROM orders), b AS (SELECT c_custkey + c_nationkey AS k FROM customer) "


@query(SETS + "SELECT k FROM a UNION SELECT k FROM b")
def set_union(spark, d):
    return M.set_union(*_sets(spark, d))


@query(SETS + "SELECT k FROM a INTERSECT SELECT k FROM b")
def set_intersection(spark, d):
    return M.set_intersection(*_sets(spark, d))


@query(SETS + "SELECT k FROM a EXCEPT SELECT k FROM b")
def set_difference(spark, d):
    return M.set_difference(*_sets(spark, d))


@query(SETS + "(SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL (SELECT k FROM b EXCEPT SELECT k FROM a)")
def set_xor(spark, d):
    return M.set_xor(*_sets(spark, d))


@query(SETS + "SELECT k FROM a INTERSECT SELECT k FROM b INTERSECT SELECT l_partkey FROM lineitem")
def intersect_sets(spark, d):
    return M.intersect_sets(*_sets(spark, d), read(spark, d, "lineitem").select(c("l_partkey").alias("k")))


@query("""SELECT count(DISTINCT n_nationkey) FILTER (WHERE n_nationkey >= 3 AND n_nationkey < 9) = 6 AS a, bool_or(n_nationkey >= 24 AND n_nationkey < 40) AS b,
min(n_nationkey) AS lo, max(n_nationkey) AS hi, count(DISTINCT n_nationkey) FILTER (WHERE n_nationkey >= 20 AND n_nationkey < 30) = 10 AS c FROM nation""")
def bitset_ranges(spark, d):
    k = c("n_nationkey")
    return read(spark, d, "nation").agg(bitset.contains_range(k, 3, 9).alias("a"), bitset.intersects_range(k, 24, 40).alias("b"), bitset.min_value(k).alias("lo"), bitset.max_value(k).alias("hi"), bitset.contains_range(k, 20, 30).alias("c"))


# ---- sorting and positions


@query(f"SELECT event_id, row_number() OVER (ORDER BY v NULLS LAST, event_id) - 1 AS _pos FROM ({NAN_SQL})")
def sort_nan_last(spark, d):
    return S.with_pos(with_nan(read(spark, d, "events")), [sorting.nan_last(c("v")), "event_id"]).select("event_id", "_pos")


@query(f"SELECT event_id, row_number() OVER (ORDER BY NOT (v IS NULL OR isnan(v)), v NULLS FIRST, event_id) - 1 AS _pos FROM ({NAN_SQL})")
def sort_nan_first(spark, d):
    return S.with_pos(with_nan(read(spark, d, "events")), [*sorting.nan_first(c("v")), "event_id"]).select("event_id", "_pos")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_brand DESC, p_partkey) - 1 AS _pos FROM part")
def sort_by_desc(spark, d):
    return S.with_pos(read(spark, d, "part"), [sorting.descending(c("p_brand")), "p_partkey"]).select("p_partkey", "_pos")


@query(f"SELECT row_number() OVER (ORDER BY p_size, _pos) - 1 AS _pos, _pos AS _index FROM {positions('part', 'p_partkey')}")
def argsort(spark, d):
    return sorting.argsort(read(spark, d, "part"), ["p_partkey"], c("p_size"))


@query(f"""SELECT i._pos, p.p_partkey FROM (SELECT _pos, p_size AS v FROM {positions('part', 'p_partkey')}) i JOIN {positions('part', 'p_partkey')} p ON p._pos = i.v""")
def reindex(spark, d):
    part = read(spark, d, "part")
    return S.reindex(part.select("p_partkey"), ["p_partkey"], part.select(c("p_partkey").alias("i"), "p_size"), ["i"], "p_size").select("_pos", "p_partkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS _pos FROM orders")
def reverse(spark, d):
    return S.reverse(read(spark, d, "orders"), ["o_orderkey"]).select("o_orderkey", "_pos")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def take_min(spark, d):
    return sorting.take_min(read(spark, d, "orders"), 20, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS n FROM orders) WHERE n > 20")
def drop_min(spark, d):
    return sorting.drop_min(read(spark, d, "orders"), 20, ["o_totalprice", "o_orderkey"]).select("o_orderkey")


def _orders(spark, d) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey")


ORDERS = positions("orders", "o_orderkey")


@query(f"SELECT o_orderkey FROM {ORDERS} WHERE _pos < 17")
def take(spark, d):
    return S.take(_orders(spark, d), ["o_orderkey"], 17)


@query(f"SELECT o_orderkey FROM {ORDERS} WHERE _pos >= 17")
def drop(spark, d):
    return S.drop(_orders(spark, d), ["o_orderkey"], 17)


@query(f"SELECT o_orderkey FROM {ORDERS} WHERE _pos >= 1")
def rest(spark, d):
    return S.rest(_orders(spark, d), ["o_orderkey"])


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 9")
def take_last(spark, d):
    return S.take_last(_orders(spark, d), ["o_orderkey"], 9)


@query(f"SELECT o_orderkey FROM {ORDERS} WHERE _pos < (SELECT count(*) FROM orders) - 9")
def drop_last(spark, d):
    return S.drop_last(_orders(spark, d), ["o_orderkey"], 9)


@query(f"SELECT o_orderkey, _pos - 100 AS _pos FROM {ORDERS} WHERE _pos BETWEEN 100 AND 149")
def subvec(spark, d):
    return S.subvec(_orders(spark, d), ["o_orderkey"], 100, 150)


@query("SELECT arg_min(o_custkey, o_orderkey) AS a, arg_max(o_custkey, o_orderkey) AS z FROM orders")
def first_last(spark, d):
    return read(spark, d, "orders").agg(S.first(c("o_custkey"), c("o_orderkey")).alias("a"), S.last(c("o_custkey"), c("o_orderkey")).alias("z"))


@query("SELECT count(*) FILTER (WHERE p_retailprice < 1000) AS a, count(*) FILTER (WHERE p_retailprice < 0) AS b, count(*) FILTER (WHERE p_retailprice < 1e9) AS z FROM part")
def binary_search(spark, d):
    x = c("p_retailprice")
    return read(spark, d, "part").agg(sorting.binary_search(x, F.lit(1000)).alias("a"), sorting.binary_search(x, F.lit(0)).alias("b"), sorting.binary_search(x, F.lit(1e9)).alias("z"))


def _shift(n: int) -> str:
    f = f"coalesce(lag(value, {n}) OVER w, first_value(value) OVER w)" if n > 0 else f"coalesce(lead(value, {-n}) OVER w, last_value(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
    return f"SELECT event_id, {f} AS shifted FROM events WINDOW w AS (ORDER BY event_id)"


@query(_shift(2))
def shift_fwd(spark, d):
    return S.shift(read(spark, d, "events"), ["event_id"], 2, "value").select("event_id", "shifted")


@query(_shift(-3))
def shift_back(spark, d):
    return S.shift(read(spark, d, "events"), ["event_id"], -3, "value").select("event_id", "shifted")


@query("""SELECT CASE WHEN p < 10 THEN p ELSE p + (SELECT count(*) FROM nation) END AS _pos, k FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS p, o_orderkey AS k FROM orders)
UNION ALL SELECT row_number() OVER (ORDER BY n_nationkey) - 1 + 10, n_nationkey FROM nation""")
def splice(spark, d):
    b = read(spark, d, "nation").select(c("n_nationkey").cast("long").alias("k"))
    return S.splice(_orders(spark, d).select(c("o_orderkey").alias("k")), ["k"], 10, b, ["k"])


@query("""SELECT row_number() OVER (ORDER BY s, k) - 1 AS _pos, k FROM (SELECT 0 AS s, n_nationkey::BIGINT AS k FROM nation UNION ALL SELECT 1, s_suppkey FROM supplier UNION ALL SELECT 2, r_regionkey::BIGINT FROM region)""")
def concat_all(spark, d):
    frames = [(read(spark, d, t).select(c(k).cast("long").alias("k")), ["k"]) for t, k in (("nation", "n_nationkey"), ("supplier", "s_suppkey"), ("region", "r_regionkey"))]
    return S.concat([frames[0], (None, []), *frames[1:]])


@query("""SELECT row_number() OVER (ORDER BY k, s, o) - 1 AS _pos, s AS _src, o FROM (SELECT c_nationkey AS k, 0 AS s, c_custkey AS o FROM customer UNION ALL SELECT s_nationkey, 1, s_suppkey FROM supplier)""")
def merge_sorted(spark, d):
    a = read(spark, d, "customer").select(c("c_nationkey").alias("k"), c("c_custkey").alias("o"))
    b = read(spark, d, "supplier").select(c("s_nationkey").alias("k"), c("s_suppkey").alias("o"))
    return S.merge_sorted([a, b], "k", "o").select("_pos", "_src", "o")


# ---- runs


RUNS = """SELECT event_id, event_type, value, sum(CASE WHEN event_type IS DISTINCT FROM p OR n = 0 THEN 1 ELSE 0 END) OVER (ORDER BY event_id) - 1 AS run
FROM (SELECT *, lag(event_type) OVER (ORDER BY event_id) AS p, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events)"""


@query(f"SELECT CAST(run AS BIGINT) AS run, min(event_type) AS k, count(*) AS n FROM ({RUNS}) GROUP BY 1")
def partition_by_runs(spark, d):
    return S.partition_by(read(spark, d, "events"), ["event_id"], c("event_type"), "run").groupBy("run").agg(F.min("event_type").alias("k"), F.count("*").alias("n"))


@query(f"SELECT min(event_id) AS event_id FROM ({RUNS}) GROUP BY run")
def dedup_first_by(spark, d):
    return S.dedup_first_by(read(spark, d, "events"), ["event_id"], c("event_type")).select("event_id")


@query("SELECT (row_number() OVER (ORDER BY event_id) - 1) // 30 AS _batch, event_id FROM events")
def partition_all(spark, d):
    return S.partition_all(read(spark, d, "events"), ["event_id"], 30).select("_batch", "event_id")


@query("""SELECT b AS _batch, event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events) e, (SELECT unnest(range(0, (SELECT count(*) FROM events))) AS b) s
WHERE p >= b * 7 AND p < b * 7 + 10""")
def partition_all_step(spark, d):
    return S.partition_all(read(spark, d, "events"), ["event_id"], 10, 7).select("_batch", "event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM orders WHERE o_totalprice > 200000)")
def take_while(spark, d):
    return S.take_while(read(spark, d, "orders"), c("o_orderkey"), c("o_totalprice") <= 200000).select("o_orderkey")


@query("""WITH RECURSIVE r AS (SELECT doc_id, n_chars AS c, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents),
f(p, total, mark, after, begins) AS (SELECT -1::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT UNION ALL
  SELECT p, CASE WHEN total >= 20000 THEN total - coalesce(mark, total) ELSE total END, CASE WHEN total < 20000 THEN mark END, CASE WHEN total < 20000 THEN after END,
    CASE WHEN total >= 20000 THEN coalesce(after, p + 1) END
  FROM (SELECT r.p, f.total + r.c AS total, CASE WHEN f.mark IS NULL AND f.total + r.c >= 10000 THEN f.total + r.c ELSE f.mark END AS mark,
    CASE WHEN f.mark IS NULL AND f.total + r.c >= 10000 THEN r.p + 1 ELSE f.after END AS after FROM f JOIN r ON r.p = f.p + 1))
SELECT doc_id, (SELECT count(*) FROM f WHERE begins <= r.p) AS _batch FROM r""")
def partition_by_cost(spark, d):
    return S.partition_by_cost(read(spark, d, "documents").select("doc_id", "n_chars"), ["doc_id"], "n_chars", 20_000).select("doc_id", "_batch")


# ---- parallel application and sources


@query("SELECT round(sum(l_quantity), 2) AS s, count(*) AS n FROM lineitem")
def preduce_custom(spark, d):
    r = R.FunctionReducer(lambda: (0.0, 0), lambda a, x: (a[0] + x.l_quantity, a[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda a: (round(a[0], 2), a[1]))
    return spark.createDataFrame([r.reduce(read(spark, d, "lineitem").select("l_quantity"))], "s double, n long")


@query("SELECT string_agg(n_name, '/' ORDER BY n_nationkey DESC) AS s, count(*) AS n, (SELECT string_agg(o_orderkey, ',' ORDER BY o_totalprice, o_orderkey) FROM orders) AS keys, 1 AS none FROM nation")
def preduce_ordered(spark, d):
    """A merge that doesn't commute, over rows in an order; and the initial value of no rows."""
    text = R.FunctionReducer(tuple, lambda a, x: (*a, x[0]), lambda a, b: a + b, lambda a: "/".join(a))
    names = read(spark, d, "nation").select("n_name", "n_nationkey").repartition(7)
    # text grows in place and has a comma before each key; the whole may be large and doesn't pass the driver
    keys = R.FunctionReducer(bytearray, lambda a, x: a.extend(b",%d" % x[0]) or a, lambda a, b: a.extend(b) or a, lambda a: str(memoryview(a)[1:], "ascii") if a else None)
    orders = read(spark, d, "orders").filter("o_orderkey is not null").select("o_orderkey", "o_totalprice").repartition(5)
    none = R.FunctionReducer(lambda: 1, lambda a, x: a + x[0], lambda a, b: a + b).reduce(names.filter("false").select("n_nationkey"))
    row = keys.reduced(orders, "keys string", [c("o_totalprice").asc_nulls_last(), "o_orderkey"])
    return row.select(F.lit(text.reduce(names, [c("n_nationkey").desc()])).alias("s"), F.lit(names.count()).cast("long").alias("n"), "keys", F.lit(none).alias("none"))


@query("SELECT round(sum(l_quantity), 2) AS s FROM lineitem")
def unmerged_partials(spark, d):
    r = R.FunctionReducer(lambda: 0.0, lambda a, x: a + x.l_quantity, lambda a, b: a + b)
    return spark.createDataFrame([(round(sum(r.partials(read(spark, d, "lineitem").select("l_quantity"))), 2),)], "s double")


@query("SELECT p_partkey, round(p_retailprice * 1.1, 4) AS v FROM part")
def pmap_udf(spark, d):
    def f(x: pd.DataFrame) -> pd.DataFrame:
        return x.assign(v=(x["p_retailprice"] * 1.1).round(4))[["p_partkey", "v"]]

    out = parallel.pmap(read(spark, d, "part").select("p_partkey", "p_retailprice"), f, "p_partkey long, v double", parallel.Options(max_batch_size=500))
    return out.select("p_partkey", F.round("v", 4).alias("v"))


@query("SELECT i // 1000 AS \"group\", CAST(sum(i) AS DOUBLE) AS value FROM range(10500) t(i) GROUP BY 1")
def pgroups(spark, d):
    return parallel.pgroups(spark, 10_500, 1000, lambda a, b: float(sum(range(a, b))))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def bloom_semijoin(spark, d):
    rich = read(spark, d, "orders").filter("o_totalprice > 150000").select("o_custkey")
    held = bloom.build(rich, c("o_custkey"), max(1, rich.count()), 0.01)
    maybe = bloom.probe(read(spark, d, "customer"), c("c_custkey"), held).filter("maybe").select("c_custkey")
    # the filter may let others pass; the join decides
    return maybe.join(rich.distinct(), c("c_custkey") == c("o_custkey"), "left_semi")


@query("SELECT unnest(string_split(text, chr(10))) AS value FROM documents")
def split_lines(spark, d):
    return read(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value"))


@query("SELECT i AS _pos, i * 3 + 5 AS value FROM range(31) t(i)")
def range_source(spark, d):
    return T.numbers(spark, 5, 100, 3)


@query("SELECT i AS _pos, 7 AS value FROM range(12) t(i)")
def repeat_source(spark, d):
    return T.repeat(spark, 12, F.lit(7))


@query("SELECT i // 10 AS part, i AS v FROM range(40) t(i)")
def iterable_source(spark, d):
    def rows(part: int):
        for i in range(part * 10, part * 10 + 10):
            yield part, i

    return T.iterable(spark, rows, 4, "part long, v long")


@query("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
def into_union(spark, d):
    return T.into(read(spark, d, "nation").select(c("n_nationkey").alias("k")), read(spark, d, "region").select(c("r_regionkey").alias("k")))


# ---- membership, points and ranges


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AS member FROM customer")
def contains_fn(spark, d):
    rich = read(spark, d, "orders").filter("o_totalprice > 200000").select("o_custkey")
    return M.with_membership(read(spark, d, "customer").select("c_custkey"), c("c_custkey"), rich)


@query(TWO + "SELECT a.k, CASE WHEN b.k IS NULL AND NOT EXISTS (SELECT 1 FROM b x WHERE x.k IS NOT DISTINCT FROM a.k) THEN a.v ELSE a.v + b.v END AS v FROM a LEFT JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def compute_if_present(spark, d):
    return M.compute_if_present(*_by_nation(spark, d), lambda old, new: old + new)


@query(TWO + "SELECT k, v FROM a UNION ALL SELECT k, v FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k IS NOT DISTINCT FROM b.k)")
def compute_if_absent(spark, d):
    return M.compute_if_absent(*_by_nation(spark, d))


@query("SELECT DISTINCT p_size::BIGINT AS value FROM part WHERE p_size >= 0")
def bitset_members(spark, d):
    return bitset.members(read(spark, d, "part"), c("p_size"))


@query(f"SELECT CASE WHEN _pos >= 5 THEN _pos + 3 ELSE _pos END AS _pos, k FROM (SELECT _pos, o_orderkey AS k FROM {ORDERS}) UNION ALL SELECT 5 + i, 100 FROM range(3) t(i)")
def add_constant(spark, d):
    return S.add_constant(_orders(spark, d).select(c("o_orderkey").alias("k")), ["k"], 5, 3, {"k": F.lit(100)})


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= (SELECT min(o_orderkey) FROM orders WHERE o_totalprice > 200000)")
def take_while_rest(spark, d):
    return S.split_while(read(spark, d, "orders"), c("o_orderkey"), c("o_totalprice") <= 200000)[1].select("o_orderkey")


@query("""WITH RECURSIVE r AS (SELECT p_partkey, p_size AS x, row_number() OVER (ORDER BY p_partkey) - 1 AS p FROM part),
f(p, head, run) AS (SELECT p, x, 0::BIGINT FROM r WHERE p = 0 UNION ALL
  SELECT r.p, CASE WHEN abs(f.head - r.x) <= 10 THEN f.head ELSE r.x END, CASE WHEN abs(f.head - r.x) <= 10 THEN f.run ELSE f.run + 1 END FROM f JOIN r ON r.p = f.p + 1)
SELECT p_partkey, run AS _run FROM f JOIN r ON r.p = f.p""")
def partition_by_predicate(spark, d):
    return S.partition_by_predicate(read(spark, d, "part").select("p_partkey", "p_size"), ["p_partkey"], "p_size", lambda a, b: abs(a - b) <= 10).select("p_partkey", "_run")


@query("SELECT l_returnflag AS k, CASE WHEN sum(l_quantity) > 100000 THEN 'many' WHEN sum(l_quantity) > 50000 THEN 'some' ELSE 'few' END AS v, 1 AS one FROM lineitem GROUP BY 1")
def cond_constantly(spark, d):
    n = F.sum("l_quantity")
    return read(spark, d, "lineitem").groupBy(c("l_returnflag").alias("k")).agg(F.when(n > 100_000, "many").when(n > 50_000, "some").otherwise("few").alias("v")).withColumn("one", F.lit(1))


@query(f"SELECT a.event_id, a.v IS NOT DISTINCT FROM b.v OR (isnan(a.v) AND isnan(b.v)) AS same FROM ({NAN_SQL}) a JOIN ({NAN_SQL}) b ON a.event_id = b.event_id WHERE a.v IS NOT NULL")
def double_eq(spark, d):
    e = with_nan(read(spark, d, "events")).filter("v is not null")
    return e.select("event_id", casts.double_eq(c("v"), c("v") * 1).alias("same"))
