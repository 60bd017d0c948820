"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from pelorus.plans import changes, queries
from pelorus.sources.tables import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
NAMES = [*queries.QUERIES, *changes.ORACLES]


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return v if v is None or isinstance(v, (int, bool)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = (queries.callables() | changes.CALLABLES)[name](spark, FOLDER)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    ran = duck.execute((queries.oracles() | changes.ORACLES)[name])
    columns = [c[0] for c in ran.description]
    assert sorted(columns) == order
    want = sorted((tuple(plain(dict(zip(columns, r))[c]) for c in order) for r in ran.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["customer", "y", "n", "total"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    plan = queries.callables()["point_lookup"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(c_custkey), EqualTo(c_custkey,7)]" in plan


def test_stream_equals_batch(spark, tmp_path):
    from pelorus.sources.tables import scan
    from pelorus.streaming.windows import event_stream, windowed

    events = scan(spark, FOLDER, "events")
    events.write.parquet(str(tmp_path / "in"))
    query = windowed(event_stream(spark, str(tmp_path / "in"), events.schema)).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r[0], r[1], r[2]) for r in spark.table("w").collect()) == sorted((r[0], r[1], r[2]) for r in windowed(events).collect())
