"""Every registered change-analytics query against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from stratamesh.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df):
    return sorted(tuple("null" if v is None or v != v else repr(float(v) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_tile_files_of_all_points(spark, sf):
    pts = registry.lineitem_points(spark, sf, 1.0)
    got = {r["file"].split("-")[0] for r in registry.QUERIES["tile_files_all"](spark, sf).select("file").distinct().collect()}
    assert got == {str(r["classification"]) for r in pts.select("classification").distinct().collect()}


def test_knn_self_finds_others(spark, sf):
    got = registry.QUERIES["knn_self_k5"](spark, sf).collect()
    assert all(r["source_id"] == r["target_id"] or r["distance"] == 0 for r in got if r["rank"] == 1)
    assert any(r["distance"] > 0 for r in got) and any(r["source_id"] != r["target_id"] for r in got)
