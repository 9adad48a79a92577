"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from regmill.plans import queries as registry


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        path = f"{sf}/{f}/*.parquet" if os.path.isdir(f"{sf}/{f}") else f"{sf}/{f}"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query_equals_its_sql(spark, sf, tables, name):
    df = registry.QUERIES[name](spark, sf)
    want = tables.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_every_query_has_sql_and_the_entry_runs(spark):
    import __spark_entry__ as entry

    assert registry.QUERIES.keys() == registry.ORACLES.keys()
    assert registry.QUERIES.keys() <= entry.queries().keys() and entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).count() > 0


def test_pages_of_any_id_are_dropped(spark, tmp_path):
    spark.range(999_997, 1_000_010).withColumnRenamed("id", "page_id").write.parquet(str(tmp_path / "pages.parquet"))
    got = registry.QUERIES["pages_dropped"](spark, str(tmp_path)).collect()
    assert sorted(int(r.key) for r in got) == [999_999, 1_000_002, 1_000_005, 1_000_008]


def test_tables_that_grow_are_not_broadcast(spark, sf):
    from regmill.plans import render

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    pages = render.company_pages(spark, sf)
    for df in (pages, pages.groupBy().count()):  # of the nation and the region only
        assert plan(df).count("BroadcastHashJoin") == 2 and "SortMergeJoin" in plan(df)
    assert "Broadcast" not in plan(render.lobbyist_pages(spark, sf))
    assert render.lobbyist_pages(spark, sf).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
