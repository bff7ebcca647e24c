"""Every query with SQL against DuckDB on the smallest tables, and every other for rows."""

import importlib.util

import duckdb
import numpy as np
import pytest

from oremill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(v):
    if isinstance(v, list | np.ndarray):
        return [canonical(x) for x in v]
    if v is None or (isinstance(v, float | np.floating) and np.isnan(v)):
        return "null"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, int | float | np.number):
        return repr(float(v) + 0.0)
    return str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(str([canonical(v) for v in r]) for r in df[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, duck, name):
    assert rows_of(registry.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(registry.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 3
    if importlib.util.find_spec("oremill.llm") is None:
        assert "pipeline" not in e.queries()


def test_whole_tables_are_read(spark, duck):
    count = lambda t: duck.execute(f"select count(*) from {t}").fetchone()[0]
    assert registry.QUERIES["distance_expr"](spark, SF).select("id").distinct().count() == count("embeddings")
    assert registry.QUERIES["box_stats"](spark, SF).agg({"n": "sum"}).head()[0] == count("customer")
    part = duck.execute("select p_partkey, p_size::DOUBLE, (p_partkey % 97)::DOUBLE from part order by 1").fetchnumpy()
    ids, x, y = part.values()
    near = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= 4
    label = np.arange(len(ids))
    while (new := np.where(near, label, len(ids)).min(axis=1)).tolist() != label.tolist():
        label = new
    got = {r["id"]: r["component"] for r in registry.QUERIES["single_link_cut"](spark, SF).collect()}
    assert got == dict(zip(ids.tolist(), ids[label].tolist(), strict=True))
