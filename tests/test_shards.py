"""Shard ranges reach the scans of the port plans, and shards are written in files of bounded size."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from tidemark.params import PortStopParams
from tidemark.plans import ports
from tidemark.sources import tables
from workload.inputs import Inputs
from workload.voyage_queries import attributes, good, light_years

SF = "/root/testdata/sf0.001"
FIRST, LAST = "20240108", "20240121"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def partition_filters(df):
    """The partition filters of the scans that have a shard column."""
    return [f for f in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan_of(df)) if "dt" in f]


@pytest.fixture(scope="module")
def q(spark):
    return Inputs(spark, SF)


@pytest.fixture(scope="module")
def stored(spark, q, tmp_path_factory):
    """Visits and identities by day."""
    folder = tmp_path_factory.mktemp("shards")
    tables.write_sharded(q.port_visits().drop("dt"), str(folder / "visits"), "start_timestamp")
    tables.write_sharded(q.vessel_daily(), str(folder / "daily"), "day")
    plain = q.port_visits().selectExpr("vessel_id", "start_timestamp", "end_timestamp", "'a1' AS start_anchorage_id").distinct()
    tables.write_sharded(plain, str(folder / "study"), "start_timestamp")
    return {name: tables.read_sharded(spark, str(folder / name)) for name in ("visits", "daily", "study")}


def stop_table(q, visits, daily, params):
    return ports.port_stop_table(visits, daily, good(q), attributes(q), q.anchorages(), q.stored_voyages(), params)


def test_port_stop_table_reads_its_shards_only(q, stored):
    params = PortStopParams(720, FIRST, LAST)
    got = stop_table(q, stored["visits"], stored["daily"], params)
    filters = partition_filters(got)
    assert len(filters) >= 2 and all(FIRST in f and LAST in f for f in filters)
    inside = F.date_format("start_timestamp", "yyyyMMdd").between(FIRST, LAST)
    want = stop_table(q, q.port_visits().where(inside), q.vessel_daily(), PortStopParams(720))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.count() > 0


def test_port_visit_table_reads_its_shards_only(q, stored):
    def build(visits, daily, shards):
        return ports.port_visit_table(
            visits, q.anchorages(), daily, q.stored_voyages(), attributes(q), q.study_encountered(), light_years(q),
            q.by_year(), (2024,), shards,
        )

    got = build(stored["study"], stored["daily"], (FIRST, LAST))
    filters = partition_filters(got)
    assert len(filters) >= 2 and all(FIRST in f and LAST in f for f in filters)
    inside = F.date_format("start_timestamp", "yyyyMMdd").between(FIRST, LAST)
    want = build(stored["study"].where(inside).drop("dt"), q.vessel_daily(), (None, None))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.count() > 0


def test_shards_are_compared_as_they_are(spark, stored, tmp_path):
    for name, table in stored.items():
        filters = partition_filters(table.where(F.col("dt").between(FIRST, LAST)))
        assert filters and not [f for f in filters if "cast" in f], name
    path = str(tmp_path / "old")
    rows = spark.createDataFrame([(1, "0999-01-02"), (2, "2024-01-08"), (3, None)], "id int, day string")
    tables.write_sharded(rows.withColumn("t", F.col("day").cast("timestamp")), path, "t")
    for schema in (None, "id int", "id int, dt string"):
        got = tables.read_sharded(spark, path, schema=schema)
        assert {r.id: r.dt for r in got.collect()} == {1: "09990102", 2: "20240108", 3: None}
        assert [r.id for r in tables.read_sharded(spark, path, FIRST, LAST, schema).collect()] == [2]


def test_a_range_needs_shards(q):
    with pytest.raises(ValueError):
        ports.explode_events(q.port_visits().drop("dt"), PortStopParams(first_shard=FIRST))
    assert ports.explode_events(q.port_visits().drop("dt")).count() == 1000


@pytest.fixture
def small_partitions_stay(spark):
    """Files this small would be put together again by adaptive execution."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_large_days_have_several_files(spark, tmp_path, small_partitions_stay):
    rows = [(i, "x" * 1000, "2024-01-01" if i < 300 else "2024-01-02" if i < 310 else None) for i in range(311)]
    df = spark.createDataFrame(rows, "id int, text string, day string").withColumn("t", F.col("day").cast("timestamp"))
    df = df.withColumn("nested", F.array(F.struct("id"))).withColumn("m", F.create_map("text", "id"))
    path = str(tmp_path / "sized")
    tables.write_sharded(df, path, "t", file_bytes=200_000)
    files = {os.path.basename(d): len(glob.glob(f"{d}/*.parquet")) for d in glob.glob(f"{path}/dt=*")}
    assert 2 <= files["dt=20240101"] <= 4 and files["dt=20240102"] == 1
    assert len(files) == 3 and spark.read.parquet(path).count() == 311
