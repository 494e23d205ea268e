"""Every query with SQL is held against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from gridlens.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted((tuple(cell(r[i]) for i in order) for r in found), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    r = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(r.columns)
    assert rows([tuple(x) for x in df.collect()], df.columns) == rows(r.fetchall(), r.columns)


@pytest.mark.parametrize("name", ["grid_figures", "figure_points"])
def test_figures_of_many_entities_equal_sql(spark, tmp_path, name):
    """Sixty event types, and small values without a type: all are compared or drawn."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (CASE WHEN value >= 5 THEN event_type || user_id % 12 END AS event_type) FROM '/root/testdata/sf0.01/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df, r = catalog.queries()[name](spark, str(tmp_path)), c.sql(catalog.oracle_sql()[name])
    assert rows([tuple(x) for x in df.collect()], df.columns) == rows(r.fetchall(), r.columns)


def test_stream_equals_batch(spark):
    live = {r["event_id"]: r for r in catalog.queries()["stream_equals_batch"](spark, SF).collect()}
    batch = {r["event_id"]: r for r in catalog.scored(spark, SF).collect()}
    assert live.keys() == batch.keys()
    for k, r in live.items():
        assert r["base_n"] == batch[k]["base_n"] and r["stat_alarm"] == batch[k]["stat_alarm"]
        assert (r["z_robust"] is None) == (batch[k]["z_robust"] is None) and (r["z_robust"] is None or abs(r["z_robust"] - batch[k]["z_robust"]) < 1e-5)
