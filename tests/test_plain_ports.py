"""Single ports are unrolled as plain values."""

from __future__ import annotations

from tidemark.plans import voyages


def test_ports_alone_are_plain_values(spark):
    trips = spark.createDataFrame([("t1", "A", "B"), ("t2", None, "A")], "trip_id string, start_anchorage_label string, end_anchorage_label string")
    ports = spark.createDataFrame([("p1", "A"), ("p2", "A"), ("p3", "B")], "port_id string, label string")
    got = voyages.fan_out_ports(trips, ports)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(") == 2 and "inline(" not in plan
    plain = voyages.attach_ports(trips, ports, ("label",))
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
