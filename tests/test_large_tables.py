"""Steps whose tasks grew with the input, or that moved rows twice."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranking
from tidemark.operators.intervals import contained_in
from tidemark.plans import encounters, risk, vessels
from tidemark.session import configure, stored
from workload import inputs
from workload.inputs import ENCOUNTERS, Inputs

SF = "/root/testdata/sf0.001"


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_attributes_are_dealt_before_copies_go(spark):
    q = Inputs(spark, SF)
    for rows in ("any", "each"):
        got = vessels.attributes_by_year(q.by_year().unionByName(q.by_year()), squid_rows=rows)
        plan = _optimized(got)
        assert plan.index("Aggregate") < plan.index("RepartitionByExpression [ssvid")
        assert sorted(map(str, got.collect())) == sorted(
            map(str, vessels.attributes_by_year(q.by_year(), squid_rows=rows).collect())
        )


def test_joined_partitions_stay_small(spark):
    configure(spark)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"


def test_members_meet_spans_without_buckets(spark):
    day = lambda y, d: datetime(y, 1, d)
    members = spark.createDataFrame(
        [(i, s, day(y, a), day(y, b)) for i, (s, y, a, b) in enumerate([
            ("1", 2000, 2, 3), ("1", 2001, 1, 1), ("1", 2000, 9, 20), ("2", 2000, 2, 3), ("3", 2000, 2, 3), (None, 2000, 2, 3),
        ])], "event_id int, ssvid string, event_start timestamp, event_end timestamp",
    )
    spans = spark.createDataFrame(
        [("1", day(2000, 1), day(2000, 10)), ("1", day(2000, 2), day(2001, 1)), ("2", day(2000, 9), day(2000, 1)),
         ("3", None, day(2001, 1)), (None, day(1999, 1), day(2005, 1))],
        "carrier_ssvid string, carrier_first_timestamp timestamp, carrier_last_timestamp timestamp",
    )
    got = encounters.carrier_members(members, spans)
    want = contained_in(
        members, spans.withColumn("ssvid", F.col("carrier_ssvid")), ["ssvid"], at="event_start", until="event_end",
        start="carrier_first_timestamp", end="carrier_last_timestamp",
    )
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.count() == 4 and "_bucket" not in _optimized(got)


def _loaded(q):
    return (
        encounters.load_encounters(q.encounters(), ENCOUNTERS), q.encounter_daily(),
        encounters.curated_carriers(q.carriers(), ENCOUNTERS),
    )


def _rows(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_neighbours_are_read_without_their_columns(spark):
    loaded, daily, carriers = _loaded(Inputs(spark, SF))
    nameless = daily.limit(3).withColumn("ssvid", F.lit(None).cast("string"))
    got = encounters.member_pairs(loaded, daily.unionByName(nameless).unionByName(daily), carriers)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "struct<event:string,ssvid:string>" in plan and "ExistingRDD" not in plan
    members = vessels.resolve_identity(loaded, daily, "event_date")
    want = encounters.pair_members(encounters.carrier_members(members, carriers), members)
    assert _rows(got, want.columns) == _rows(want, want.columns) != []


def test_only_listed_carriers_keep_their_columns(spark):
    loaded, daily, carriers = _loaded(Inputs(spark, SF))
    met = encounters.met_members(loaded, daily, carriers)
    ids = {r[0] for r in carriers.select("carrier_ssvid").collect()}
    rows = met.select("ssvid", F.col("own").isNotNull().alias("whole")).collect()
    assert {r.ssvid in ids for r in rows if r.whole} == {True}
    assert {r.ssvid in ids for r in rows if not r.whole} == {False}


def test_carriers_get_attributes_before_they_meet(spark):
    q = Inputs(spark, SF)
    loaded, daily, carriers = _loaded(q)
    info = q.vessel_info().unionByName(q.vessel_info().limit(20))
    got = encounters.attributed_pairs(loaded, daily, carriers, info, ENCOUNTERS, q.anchorages())
    pairs = encounters.encounters_away_from_port(
        encounters.member_pairs(loaded, daily, carriers), q.anchorages(), ENCOUNTERS
    )
    for role in ("carrier", "neighbor"):
        pairs = encounters.valid_attributes(encounters.with_attributes(pairs, info, role, ENCOUNTERS), role)
    assert _rows(got, got.columns) == _rows(pairs.select(got.columns).distinct(), got.columns) != []
    assert len(set(got.columns)) == len(got.columns) and not [c for c in got.columns if c.startswith("_")]


def test_carrier_trips_are_worked_out_once(spark):
    q = Inputs(spark, SF)
    got = risk.carrier_scores(q.carrier_rows(), q.carrier_loitering())
    assert "lineitem" not in got._jdf.queryExecution().executedPlan().toString()
    assert "min_by" not in _optimized(got)
    assert got.count() == got.select("trip_id").distinct().count() > 0


def _shown(rows, column):
    return sorted((str(r.g), r.n, *[round(x, 6) for x in r[column]]) for r in rows)


@pytest.mark.parametrize("held", [0, 10_000])
def test_values_of_a_quantile_stay_where_they_are(spark, monkeypatch, held):
    hints = []
    broadcast = F.broadcast
    monkeypatch.setattr(ranking.F, "broadcast", lambda df: hints.append(1) or broadcast(df))
    monkeypatch.setattr(ranking, "_HELD", held)
    rows = spark.range(3000).selectExpr("IF(id % 3 = 0, NULL, id % 2) AS g", "id * 7919 % 3001 AS x")
    got = ranking.exact_quantiles(rows, "x", (0.1, 0.5), ["g"], most=100).collect()
    want = rows.groupBy("g").agg(F.count("x").alias("n"), F.percentile("x", F.array(F.lit(0.1), F.lit(0.5))).alias("p")).collect()
    assert _shown(got, "quantiles") == _shown(want, "p")
    assert bool(hints) == bool(held)


def test_stored_keeps_rows_and_types(spark):
    rows = spark.sql("SELECT 'a' AS k, CAST(NULL AS INT) AS n, array(1, 2) AS l")
    assert stored(rows).collect() == rows.collect()


def test_vessels_are_dealt_before_years_repeat_them(spark, monkeypatch):
    q = Inputs(spark, SF)
    want = q.by_year()
    assert "Repartition" not in _optimized(want)
    monkeypatch.setattr(inputs, "ROWS_PER_TASK", 40)
    got = q.by_year()
    plan = _optimized(got)
    assert plan.index("Generate") < plan.index("RepartitionByExpression [c_custkey")
    assert got.rdd.getNumPartitions() == q.table("customer").count() // 40 > 1
    assert _rows(got, got.columns) == _rows(want, want.columns)
