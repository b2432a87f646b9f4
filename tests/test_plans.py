"""Hand-written cases of the domain plans."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import classes
from tidemark.functions.clock import hex_millis
from tidemark.functions.geo import cell_area_km2, degree_bin, midpoint
from tidemark.plans import attribution, effort, ports, report, risk, vessels, voyages
from tidemark.sources import schemas, tables

T = datetime(2015, 1, 1)


def hours(n):
    return T + timedelta(hours=n)


ANCHORAGES = [
    ("x", "X", None, "AAA", 0.0, 0.0, True), ("y", "Y", None, "BBB", 1.0, 1.0, True),
    ("c1", "C", "PANAMA CANAL", "PAN", 9.0, -80.0, True), ("c2", "C", "PANAMA CANAL", "PAN", 9.1, -80.0, False),
]


def run_core(spark, legs, **params):
    rows = [(v, [v], s, e, a, b) for v, s, e, a, b in legs]
    df = spark.createDataFrame(rows, schemas.LEGS)
    anchorages = spark.createDataFrame(ANCHORAGES, schemas.ANCHORAGES)
    out = voyages.voyages_from_legs(df, anchorages, voyages.VoyageParams(**params))
    return sorted(
        ((r.ssvid, r.trip_start, r.trip_end, r.trip_start_anchorage_id, r.trip_end_anchorage_id) for r in out.collect()),
        key=str,
    )


def test_canal_chain_is_one_voyage(spark):
    legs = [
        ("1", hours(0), hours(10), "x", "c1"), ("1", hours(12), hours(14), "c1", "c2"), ("1", hours(16), hours(40), "c2", "y"),
        ("1", hours(50), hours(60), "y", "x"),
    ]
    assert run_core(spark, legs) == [("1", hours(0), hours(40), "x", "y"), ("1", hours(50), hours(60), "y", "x")]


def test_chain_that_stays_in_the_canal_has_no_end(spark):
    df = spark.createDataFrame(
        [("1", hours(0), hours(10), "x", "c1", True), ("1", hours(12), hours(14), "c1", "c2", True)],
        "ssvid string, trip_start timestamp, trip_end timestamp, trip_start_anchorage_id string,"
        " trip_end_anchorage_id string, ends_in_canal boolean",
    )
    rows = voyages.merge_canal_transits(df).collect()
    assert [(r.trip_start, r.trip_end, r.trip_end_anchorage_id) for r in rows] == [(hours(0), None, "c2")]


def test_open_voyage_and_sentinels(spark):
    far = datetime(2100, 1, 1)
    legs = [
        ("1", hours(0), far, "x", "ACTIVE_VOYAGE"), ("2", datetime(1850, 1, 1), hours(9), "NO_PREVIOUS_DATA", "y"),
        ("3", hours(0), hours(90), "10000001", "y"), ("4", hours(0), hours(1), "x", "y"),
    ]
    assert run_core(spark, legs) == [
        ("1", hours(0), None, "x", "ACTIVE_VOYAGE"), ("2", None, hours(9), "NO_PREVIOUS_DATA", "y"),
    ]


def test_equal_bounds_of_two_vessels_stay_apart(spark):
    legs = [("1", hours(0), hours(10), "x", "y"), ("2", hours(0), hours(10), "y", "x")]
    assert run_core(spark, legs) == [("1", hours(0), hours(10), "x", "y"), ("2", hours(0), hours(10), "y", "x")]


@pytest.mark.parametrize("limit, merged", [(0.0, 2), (3.0, 1)])
def test_short_stops(spark, limit, merged):
    overlapping = [("1", hours(0), hours(10), "x", "y"), ("1", hours(8), hours(20), "y", "x")]
    assert len(run_core(spark, overlapping, min_port_stop_hr=limit)) == 1
    touching = [("1", hours(0), hours(10), "x", "y"), ("1", hours(10), hours(20), "y", "x")]
    assert len(run_core(spark, touching, min_port_stop_hr=limit)) == merged
    later = [("1", hours(0), hours(10), "x", "y"), ("1", hours(12), hours(20), "y", "x")]
    assert len(run_core(spark, later, min_port_stop_hr=limit)) == merged


def test_duplicate_legs_change_nothing(spark):
    legs = [("1", hours(0), hours(10), "x", "c1"), ("1", hours(12), hours(40), "c1", "y"), ("1", hours(50), hours(60), "y", "x")]
    assert run_core(spark, legs * 3) == run_core(spark, legs)


def test_duplicate_open_leg_after_canal_starts_no_trip(spark):
    legs = [("1", hours(0), hours(10), "x", "c1"), ("1", hours(12), datetime(2100, 1, 1), "c1", "ACTIVE_VOYAGE")]
    assert run_core(spark, legs * 2) == run_core(spark, legs)


def test_trip_id_before_1970(spark):
    df = spark.sql("select timestamp'0001-02-03 00:00:00' as t union all select timestamp'2015-01-01 00:00:00'")
    assert sorted(r[0] for r in df.select(hex_millis(F.col("t"))).collect()) == ["-3882683afc00", "014aa2cab000"]


# -- port stops ---------------------------------------------------------------------------------

KINDS = {"n": "PORT_ENTRY", "b": "PORT_STOP_BEGIN", "e": "PORT_STOP_END", "g": "PORT_GAP", "x": "PORT_EXIT"}


def stops_of(spark, text, minutes=None, places=None):
    """Durations in minutes of a visit whose events are spelled as letters."""
    minutes = minutes or [60 * i for i in range(len(text))]
    places = places or "a" * len(text)
    events = [(T + timedelta(minutes=m), p, KINDS[k]) for k, m, p in zip(text, minutes, places)]
    # The visit comes in two rows; its events still form one sequence.
    half = len(events) // 2
    rows = [("v", T, hours(99), 0.0, 0.0, 0.0, 0.0, "a", "a", part, "20150101") for part in (events[half:], events[:half])]
    df = spark.createDataFrame(rows, schemas.PORT_VISITS)
    out = ports.port_stops(df)
    return [r.duration_min for r in sorted(out.collect(), key=lambda r: r.stop_begin_time)]


@pytest.mark.parametrize("sliced", [False, True])
def test_port_event_sequences(spark, sliced):
    if sliced:
        spark.conf.set("tidemark.rowsPerGroup", "2")
    try:
        assert stops_of(spark, "nbex") == [60]
        assert stops_of(spark, "ngbe") == []
        assert stops_of(spark, "nbegbe") == []
        assert stops_of(spark, "nbegxbe") == [60]
        assert stops_of(spark, "nbge") == [120]
        assert stops_of(spark, "nb") == [None]
        # A pause of 29 minutes joins two stops, 30 minutes or another place does not.
        assert stops_of(spark, "bebe", [0, 60, 89, 120]) == [120]
        assert stops_of(spark, "bebe", [0, 60, 90, 120]) == [60, 30]
        assert stops_of(spark, "bebe", [0, 60, 89, 120], "aabb") == [60, 31]
        assert stops_of(spark, "bebebe", [0, 60, 70, 100, 110, 200]) == [200]
    finally:
        spark.conf.unset("tidemark.rowsPerGroup")


# -- vessels ---------------------------------------------------------------------------------------


def test_frequent_names(spark):
    def n(*pairs):
        return list(pairs)

    six = n(*[(f"N{i}", 10) for i in range(6)])
    cases = [(0, None, 0), (1, [], 0), (2, n(("A", 4), ("B", 9), ("A", 6)), 1), (3, six, 6), (4, six[:5], 5),
             (5, n((None, 50), ("A", 9)), 0), (6, n(("A", None), ("A", 10)), 1)]
    df = spark.createDataFrame([(i, a) for i, a, _ in cases], "i int, a array<struct<value: string, count: bigint>>")
    got = {r.i: r.n for r in df.select("i", vessels.frequent_names(F.col("a")).alias("n")).collect()}
    assert got == {i: want for i, _, want in cases}


def test_bad_list_with_null_keeps_the_rest(spark):
    from workload.inputs import Inputs

    by_year = Inputs(spark, "/root/testdata/sf0.001").by_year().where("year = 2000")
    listed = spark.createDataFrame([([1, None],), (None,)], "ssvid array<bigint>")
    kept = vessels.quality_vessel_years(by_year, listed, rules=())
    assert kept.count() == by_year.count() - 1


def test_gear_names(spark):
    names = {"BOUY 7": True, "BUOY": False, "X 55%": True, "55%": False, "3.7V": True, "ABC@12V": True, "123-456": True,
             "12-3A": False, "NETFISHING": True, "net mark": False, "-": True}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.g for r in df.select("n", classes.is_gear_name(F.col("n")).alias("g")).collect()} == names


def test_classes(spark):
    df = spark.createDataFrame(
        [("CHN", 719.9, 0.0), ("LBR", 720.0, -0.1), ("XYZ", 8640.0, 2.0), (None, None, 1.9)], "f string, h double, s double"
    )
    got = df.select(classes.flag_group(F.col("f")), classes.time_at_sea(F.col("h")), classes.risk_class(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [
        ("china", "less_than_1m", 1), ("group1", "1_3m", 0), ("other", "12m_and_more", 2), (None, None, 1)
    ]


# -- effort, risk, attribution, report ----------------------------------------------------------------


def test_cells(spark):
    df = spark.createDataFrame([(0.5,), (-0.5,), (2.5,), (90.0,)], "x double")
    got = df.select(degree_bin(F.col("x")), cell_area_km2(F.col("x"))).collect()
    assert [r[0] for r in got] == [1.0, -1.0, 3.0, 90.0] and all(r[1] > 0 for r in got)
    assert got[0][1] == pytest.approx(12390, rel=1e-2)
    wrapped = spark.createDataFrame([(179.0, -179.0)], "a double, b double")
    assert wrapped.select(midpoint(F.col("a"), F.col("b")), midpoint(F.col("a"), F.col("b"), wrap=True)).first()[:] in [(0.0, 180.0), (0.0, -180.0)]


def test_density_equals_direct_sum(spark):
    import math

    cells = [(0, 0.0, 0.0, 1.0), (0, 2.0, -3.0, 0.5), (1, -1.0, 4.0, 0.25), (0, 0.0, 0.0, 0.25)]
    df = spark.createDataFrame(cells, "risk_class int, lat_bin double, lon_bin double, scaled double")
    got = effort.density_map(df, points=9, lon_range=(-4.0, 4.0), lat_range=(-4.0, 4.0))
    values = {(r.risk_class, r.gx, r.gy): r.density for r in got.collect()}
    assert len(values) == 2 * 81

    def phi(x):
        return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)

    for (c, gx, gy), z in values.items():
        mine = [r for r in cells if r[0] == c]
        direct = sum(w * phi((gx - 4 - lon) / 1.25) * phi((gy - 4 - lat) / 1.25) for _, lat, lon, w in mine)
        assert z == pytest.approx(direct / (sum(r[3] for r in mine) * 1.25**2), rel=1e-9, abs=1e-15)


def test_null_votes(spark):
    df = spark.createDataFrame([(1, 0, 1, None, 2), (2, 0, 0, 0, 0), (3, 1, 1, 1, 1)],
                               "id int, iuu_no_to int, iuu_low_to int, iuu_med_to int, iuu_high_to int")
    assert sorted(r.id for r in risk.observed_trips(df).collect()) == [1, 3]
    strict = risk.observed_trips(df, null_votes="propagate").collect()
    assert [(r.id, r.risk_score) for r in strict] == [(3, pytest.approx(1.0))]


def test_attribution_adds_up(spark):
    import itertools

    combos = itertools.product(["x", "yy", None], ["p", "q"], ["m", "n"])
    rows = [(a, b, c, float(3 * (b == "q") * (c == "m") + i * i)) for i, (a, b, c) in enumerate(combos)]
    df = spark.createDataFrame(rows, "f string, g string, h string, y double")
    factors = ["f", "g", "h"]
    terms = attribution.attribution_terms(attribution.factor_cells(df, factors, "y"), factors).collect()
    assert len(terms) == 12
    for r in terms:
        total = r["f"] + r["g"] + r["h"] + 2 * (r["f x g"] + r["f x h"] + r["g x h"])
        assert total == pytest.approx(r["cell_mean"] - r["base"])


def test_single_row_category_is_dropped(spark):
    df = spark.createDataFrame([("a", "p", 1.0), ("a", "q", 2.0), ("b", "p", 3.0)], "f string, g string, y double")
    terms = attribution.attribution_terms(attribution.factor_cells(df, ["f", "g"], "y"), ["f", "g"])
    assert {(r.factor, r.category) for r in attribution.solo_effects(terms, ["f", "g"]).collect()} == {("f", "a"), ("g", "p")}


def test_boosted_trees_beat_the_mean(spark):
    rows = [(a, b, "t", (2.0 if a == "x" else -1.0) + (0.5 if b == "p" else 0.0)) for a in "xyz" for b in "pq" for _ in range(4)]
    df = spark.createDataFrame(rows, "flag_group string, vessel_class string, time_at_sea string, risk_score double")
    got = risk.impute_boosted(df.withColumnRenamed("risk_score", "truth"), df, rate=0.3, trees=8, depth=3)
    errors = [(r.risk_score - r.truth) ** 2 for r in got.collect()]
    mean = sum(r[3] for r in rows) / len(rows)
    assert sum(errors) < 0.3 * sum((r[3] - mean) ** 2 for r in rows)


def test_labels(spark):
    df = spark.createDataFrame([("('flag', 'gear')",), ("('tas', 'tas')",), ("with_gear x loitering",)], "t string")
    assert [r[0] for r in df.select(report.term_label(F.col("t"))).collect()] == [
        "Flag × Gear type", "Time at sea", "With_gear × Loitering"
    ]


# -- sources -------------------------------------------------------------------------------------------


def test_csv_with_bom_blanks_and_scientific_numbers(spark, tmp_path):
    path = tmp_path / "ports.csv"
    text = "﻿port,country,fishing_capacity_m3,carrier_capacity_m3,port_id\nA, China,1.40E+07,1900000,p407\nB, Peru,,1,\n"
    path.write_text(text, encoding="utf-8")
    got = tables.read_csv(spark, str(path), schemas.PORT_CAPACITY, numbers=["fishing_capacity_m3", "carrier_capacity_m3"])
    assert [tuple(r) for r in got.collect()] == [("A", "China", 1.4e7, 1.9e6, "p407"), ("B", "Peru", None, 1.0, None)]


def test_shard_range_reads_only_its_partitions(spark, tmp_path):
    df = spark.createDataFrame([(i, T + timedelta(days=i)) for i in range(10)], "i int, t timestamp")
    tables.write_sharded(df, str(tmp_path / "s"), "t")
    part = tables.read_sharded(spark, str(tmp_path / "s"), "20150103", "20150105")
    assert sorted(r.i for r in part.collect()) == [2, 3, 4]
    assert len(part.inputFiles()) == 10 and "PartitionFilters: [isnotnull" in part._jdf.queryExecution().toString()
