"""Trips fanned out to all ports of a label."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import voyages
from workload.registry import formed, tidy

TRIPS = [("t1", "A", "B"), ("t2", "A", None), ("t3", "Z", "Z"), ("t1", "A", "B")]
PORTS = [("p1", "A"), ("p2", "A"), ("p3", "B"), ("p4", "B"), ("p5", "C")]


def _tables(spark):
    trips = spark.createDataFrame(TRIPS, "trip_id string, start_anchorage_label string, end_anchorage_label string")
    ports = spark.createDataFrame(PORTS, "port_id string, label string")
    votes = [F.lit(i).alias("not_associated" if v == "iuu_no" else v) for i, v in enumerate(voyages.VOTES) if v != "la_no"]
    # Two rows of votes for p1, none for p2.
    risk = ports.where("port_id <> 'p2'").unionByName(ports.where("port_id = 'p1'")).select("port_id", *votes)
    return trips, ports, risk


def _rows(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_fan_out_gives_the_rows_of_both_joins(spark):
    trips, ports, risk = _tables(spark)
    plain = voyages.attach_ports(trips, ports, ("label",))
    got = voyages.fan_out_ports(trips, ports)
    assert _rows(got, plain.columns) == _rows(plain, plain.columns) and plain.count() == 11
    voted = voyages.attach_votes(plain, risk)
    got = voyages.fan_out_ports(trips, ports, ("label",), risk)
    assert _rows(got, voted.columns) == _rows(voted, voted.columns)


def test_columns_of_a_trip_are_fixed_before_the_fan_out(spark):
    trips, ports, _ = _tables(spark)
    plan = voyages.fan_out_ports(trips, ports)._jdf.queryExecution().optimizedPlan().toString()
    generate, exchange = plan.rindex("Generate"), plan.index("RepartitionByExpression")
    assert plan.count("Generate") == 2 and generate < exchange


def test_formed_columns_stay_as_they_are(spark):
    rows = spark.sql("SELECT 'a' AS k, timestamp'2024-01-02 03:04:05' AS at, 0.12345678D AS x, 1 AS other")
    spec = "k at:t x:d missing"
    early = formed(rows, spec)
    assert early.columns == rows.columns
    done = tidy(early.crossJoin(spark.range(2)), "k at:t x:d")
    assert done.collect() == [tuple(tidy(rows, "k at:t x:d").first())] * 2
