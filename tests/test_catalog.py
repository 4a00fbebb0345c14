"""Every query of the catalog against its SQL."""

import math

import duckdb
import pytest

from foldspark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def con(sf_dir):
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalog.SQL:
        assert got
        return
    want = con.sql(catalog.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("rows", ["", "(3, 2.0), (NULL, 1.0), (12, NULL), (5, 1.0), (4, 1.0), (4, 1.0)"])
def test_preduce_ordered_odd_orders(spark, sf_dir, tmp_path, rows):
    con = duckdb.connect()
    con.sql(f"CREATE TABLE nation AS SELECT * FROM '{sf_dir}/nation.parquet'")
    con.sql("CREATE TABLE orders (o_orderkey BIGINT, o_totalprice DOUBLE)")
    if rows:
        con.sql(f"INSERT INTO orders VALUES {rows}")
    for t in ("nation", "orders"):
        con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got = catalog.QUERIES["preduce_ordered"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == con.sql(catalog.SQL["preduce_ordered"]).fetchall()
