"""Single relational constructs: sources, filters, joins, aggregates, windows, functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import classes
from tidemark.functions.clock import hex_millis, hours_between, null_after, null_before, whole_minutes
from tidemark.functions.geo import cell_area_km2, degree_bin, haversine_m, inside_world, midpoint
from tidemark.operators.intervals import contained_in
from tidemark.operators.ranking import exact_quantiles, running_sums
from tidemark.operators.sequences import ordered_scan
from tidemark.operators.skew import slice_groups
from tidemark.operators.spatial import far_from_all, near_any as near_any_site, radius_join
from tidemark.params import PortStopParams
from tidemark.plans import policy, ports, risk, vessels, voyages
from tidemark.session import scratch_path
from tidemark.sources import schemas, tables
from workload.inputs import VOYAGES, Inputs
from workload.inputs_sql import distance_m
from workload.registry import query

# -- A: sources and sinks ------------------------------------------------------------------------


@query("a1_table_scan", "o_orderkey:i o_totalprice:d", "orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000")
def table_scan(q: Inputs):
    columns = ["o_orderkey", "o_totalprice", "o_orderstatus"]
    orders = tables.read_table(q.spark, f"{q.dir}/orders.parquet", columns)
    return orders.where("o_orderstatus = 'F' AND o_totalprice > 300000")


def _sharded(q: Inputs) -> str:
    path = scratch_path(q.spark, "events-by-day")
    tables.write_sharded(q.table("events").select("event_id", "ts", "value"), path, "ts")
    return path


@query(
    "a2_shard_range_scan", "dt n:i total:d",
    "(SELECT strftime(ts, '%Y%m%d') AS dt, count(*) AS n, sum(value) AS total FROM events GROUP BY 1) WHERE dt BETWEEN '20240105' AND '20240112'",
)
def shard_range(q: Inputs):
    shards = tables.read_sharded(q.spark, _sharded(q), "20240105", "20240112")
    return shards.groupBy("dt").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


_WEEKS = ("20240108", "20240121")
_IN_WEEKS = "strftime(start_timestamp, '%Y%m%d') BETWEEN '{}' AND '{}'".format(*_WEEKS)


def _sharded_visits(q: Inputs):
    path = scratch_path(q.spark, "visits-by-day")
    tables.write_sharded(q.port_visits().drop("dt"), path, "start_timestamp")
    return tables.read_sharded(q.spark, path)


@query(
    "k37_port_events_in_shards", "vessel_id start_timestamp:t timestamp:t anchorage_id event_type",
    f"(SELECT * FROM port_events WHERE {_IN_WEEKS})", "port_events",
)
def events_in_shards(q: Inputs):
    return ports.explode_events(_sharded_visits(q), PortStopParams(first_shard=_WEEKS[0], last_shard=_WEEKS[1]))


@query(
    "k40_stop_durations_in_shards", "vessel_id start_timestamp:t anchorage_id stop_begin_time:t duration_min:i",
    f"(SELECT * FROM durations_30 WHERE {_IN_WEEKS})", "durations_30",
)
def durations_in_shards(q: Inputs):
    return ports.port_stops(_sharded_visits(q), PortStopParams(first_shard=_WEEKS[0], last_shard=_WEEKS[1]))


@query("a3_all_shards_scan", "dt n:i", "(SELECT strftime(ts, '%Y%m%d') AS dt, count(*) AS n FROM events GROUP BY 1)")
def all_shards(q: Inputs):
    return tables.read_sharded(q.spark, _sharded(q)).groupBy("dt").agg(F.count("*").alias("n"))


@query(
    "a4_a5_csv_round_trip", "ssvid trip_start:t trip_end:t label",
    "(SELECT ssvid, trip_start, CASE WHEN trip_end < TIMESTAMP '2099-01-01' THEN trip_end END AS trip_end,"
    " CASE WHEN ssvid LIKE '%0' THEN '' WHEN ssvid LIKE '%1' THEN NULL ELSE 'a, \"b\"' END AS label FROM legs)",
    "legs",
)
def csv_round_trip(q: Inputs):
    rows = q.legs().select(
        "ssvid", "trip_start",
        F.when(F.col("trip_end") < "2099-01-01", F.col("trip_end")).alias("trip_end"),
        F.when(F.col("ssvid").endswith("0"), "").when(~F.col("ssvid").endswith("1"), 'a, "b"').alias("label"),
    )
    path = scratch_path(q.spark, "legs-csv")
    tables.write_csv(rows, path)
    return tables.read_csv(
        q.spark, path, "ssvid string, trip_start timestamp, trip_end timestamp, label string", blank_is_null=False
    )


@query(
    "a6_port_capacity_csv", "port country fishing_capacity_m3:d carrier_capacity_m3:d port_id",
    "(SELECT p_name AS port, p_brand AS country, p_size * 1e6 AS fishing_capacity_m3, p_retailprice AS carrier_capacity_m3,"
    " CASE WHEN p_partkey % 2 = 0 THEN 'p' || p_partkey END AS port_id FROM part)",
)
def port_capacity(q: Inputs):
    raw = q.table("part").selectExpr(
        "p_name AS port", "concat(' ', p_brand) AS country",
        "concat(p_size, '.00E+06') AS fishing_capacity_m3", "cast(p_retailprice AS string) AS carrier_capacity_m3",
        "CASE WHEN p_partkey % 2 = 0 THEN concat('p', p_partkey) END AS port_id",
    )
    path = scratch_path(q.spark, "ports-csv")
    raw.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return tables.read_csv(
        q.spark, path, schemas.PORT_CAPACITY, numbers=["fishing_capacity_m3", "carrier_capacity_m3"]
    )


@query("a7_stored_result", "ssvid n:i", "(SELECT ssvid, count(*) AS n FROM clean_legs GROUP BY 1)", "clean_legs")
def stored_result(q: Inputs):
    stored = tables.write_table(voyages.clean_legs(q.legs(), VOYAGES), scratch_path(q.spark, "legs"))
    return stored.groupBy("ssvid").agg(F.count("*").alias("n"))


@query(
    "a8_blank_rows_dropped", "country iso3 entry_date:D",
    "(SELECT n_name AS country, 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS iso3, make_date(2015 + n_nationkey % 3, 1 + n_nationkey % 9, 15) AS entry_date"
    " FROM nation WHERE n_nationkey % 8 <> 7 AND n_nationkey <> 4 AND n_nationkey % 5 <> 3)",
)
def blank_rows(q: Inputs):
    kept = tables.drop_blank_rows(q.policy_dates(), required=["entry_date"])
    return kept.where("country <> 'European Union'").withColumn("entry_date", F.to_date("entry_date"))


# -- B: projections and predicates -----------------------------------------------------------------


@query("b1_projection", "vessel:i price:d", "(SELECT o_custkey AS vessel, o_totalprice AS price FROM orders)")
def projection(q: Inputs):
    return q.table("orders").select(F.col("o_custkey").alias("vessel"), F.col("o_totalprice").alias("price"))


@query("b2_all_but_columns", "o_orderkey:i o_custkey:i o_orderstatus o_totalprice:d", "(SELECT * EXCLUDE (o_orderdate, o_orderpriority) FROM orders)")
def all_but(q: Inputs):
    return q.table("orders").drop("o_orderdate", "o_orderpriority")


@query(
    "b3_replaced_column", "o_orderkey:i o_orderstatus",
    "(SELECT * REPLACE (CASE o_orderstatus WHEN 'F' THEN 'done' ELSE lower(o_orderstatus) END AS o_orderstatus) FROM orders)",
)
def replaced(q: Inputs):
    status = F.col("o_orderstatus")
    return q.table("orders").withColumn("o_orderstatus", F.when(status == "F", "done").otherwise(F.lower(status)))


@query("b4_comparison_filter", "l_orderkey:i l_quantity:d", "lineitem WHERE (l_quantity >= 45 AND l_discount < 0.02) OR l_tax > 0.07")
def comparison(q: Inputs):
    return q.table("lineitem").where("(l_quantity >= 45 AND l_discount < 0.02D) OR l_tax > 0.07D")


@query(
    "b5_null_tolerant_filter", "ssvid year:i overlap_names:d",
    "(SELECT * FROM by_year WHERE overlap_names = 0 OR overlap_names IS NULL)", "by_year",
)
def null_tolerant(q: Inputs):
    names = F.col("activity.overlap_hours_multinames")
    return q.by_year().where((names == 0) | names.isNull()).withColumn("overlap_names", names)


@query(
    "b6_nullable_boolean", "k:i is_true is_false bare",
    "(SELECT o_orderkey AS k, b IS TRUE AS is_true, b IS FALSE AS is_false, coalesce(b, FALSE) AS bare FROM"
    " (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS b FROM orders))",
)
def nullable_boolean(q: Inputs):
    b = F.expr("CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END")
    return q.table("orders").select(
        F.col("o_orderkey").alias("k"), b.eqNullSafe(True).alias("is_true"),
        b.eqNullSafe(False).alias("is_false"), F.coalesce(b, F.lit(False)).alias("bare"),
    )


@query("b7_in_lists", "s_suppkey:i", "supplier WHERE s_nationkey IN (1, 3, 5) AND s_suppkey NOT IN (2, 4, 8)")
def in_lists(q: Inputs):
    return q.table("supplier").where(F.col("s_nationkey").isin(1, 3, 5) & ~F.col("s_suppkey").isin(2, 4, 8))


@query("b8_between", "l_orderkey:i l_quantity:d", "lineitem WHERE l_quantity BETWEEN l_linenumber AND l_linenumber + 3")
def between(q: Inputs):
    return q.table("lineitem").where(F.col("l_quantity").between(F.col("l_linenumber"), F.col("l_linenumber") + 3))


@query(
    "b9_gear_name_pattern", "name is_gear",
    "(SELECT shipname AS name, ssvid IN (SELECT ssvid FROM gear_buoys) AS is_gear FROM vessel_info)", "vessel_info", "gear_buoys",
)
def gear_pattern(q: Inputs):
    name = F.col("ais_identity.shipname_mostcommon.value")
    return q.vessel_info().select(name.alias("name"), classes.is_gear_name(name).alias("is_gear"))


@query(
    "b10_sentinel_to_null", "ssvid trip_start:t trip_end:t",
    "(SELECT ssvid, CASE WHEN trip_start >= TIMESTAMP '1900-01-01' THEN trip_start END AS trip_start,"
    " CASE WHEN trip_end <= TIMESTAMP '2099-12-31' THEN trip_end END AS trip_end FROM legs)",
    "legs",
)
def sentinels(q: Inputs):
    return q.legs().select(
        "ssvid", null_before(F.col("trip_start"), "1900-01-01").alias("trip_start"),
        null_after(F.col("trip_end"), "2099-12-31").alias("trip_end"),
    )


@query("b11_complete_rows", "trip_id flag_group vessel_class time_at_sea", "complete_trips", "complete_trips")
def complete_rows(q: Inputs):
    return risk.complete_trips(q.trips())


@query("b12_column_inequality", "ssvid flag port_iso3", "(SELECT * FROM panel_visits WHERE flag <> port_iso3)", "panel_visits")
def column_inequality(q: Inputs):
    return q.panel_visits().where(F.col("flag") != F.col("port_iso3"))


@query(
    "b13_cohort_filter", "cohort n:i",
    """(SELECT 'cargo' AS cohort, count(*) AS n FROM panel_visits WHERE vessel_class = 'cargo'
        UNION ALL SELECT 'fishing_gear', count(*) FROM panel_visits WHERE vessel_class IN ('trawlers', 'purse_seine')
        UNION ALL SELECT 'group2', count(*) FROM panel_visits WHERE vessel_class IN ('trawlers', 'purse_seine') AND flag_group = 'group2')""",
    "panel_visits",
)
def cohort_filter(q: Inputs):
    parts = [
        policy.select_cohort(q.panel_visits(), name).agg(F.count("*").alias("n")).withColumn("cohort", F.lit(name))
        for name in ("cargo", "fishing_gear", "group2")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "b14_row_sum_filter", "trip_id",
    "(SELECT * FROM trip_rows WHERE list_sum([iuu_no_to, iuu_low_to, iuu_med_to, iuu_high_to]) > 0)", "trip_rows",
)
def row_sum(q: Inputs):
    return risk.observed_trips(q.trips())


# -- C: joins ------------------------------------------------------------------------------------------


@query(
    "c1_dimension_join", "ssvid year:i flag country_name",
    "(SELECT a.*, country_name FROM attributes a LEFT JOIN country_codes c ON a.flag = c.iso3)", "attributes", "country_codes",
)
def dimension_join(q: Inputs):
    return voyages.add_country_name(vessels.attributes_by_year(q.by_year()), q.country_codes(), "flag", "country_name")


@query(
    "c2_two_roles", "ssvid trip_start:t start_anchorage_label end_anchorage_label",
    "(SELECT l.*, a.label AS start_anchorage_label, b.label AS end_anchorage_label FROM legs l LEFT JOIN anchorages a"
    " ON trip_start_anchorage_id = a.s2id LEFT JOIN anchorages b ON trip_end_anchorage_id = b.s2id)",
    "legs", "anchorages",
)
def two_roles(q: Inputs):
    return voyages.with_end_anchorages(q.legs(), q.anchorages(), ("label",))


def _daily_events(q: Inputs):
    return q.table("events").selectExpr("event_id", "cast(user_id AS string) AS vessel_id", "to_date(ts) AS seen")


_DAILY = "(SELECT event_id, user_id::VARCHAR AS vessel_id, ts::DATE AS seen FROM events)"


@query(
    "c3_composite_key_join", "event_id:i ssvid",
    f"(SELECT e.event_id, d.ssvid FROM {_DAILY} e JOIN vessel_daily d ON e.vessel_id = d.vessel_id AND e.seen = d.day)", "vessel_daily",
)
def composite_key(q: Inputs):
    return vessels.resolve_identity(_daily_events(q), q.vessel_daily(), "seen")


@query(
    "c4_left_join_with_right_filter", "ssvid trip_start:t flag",
    "(SELECT l.ssvid, l.trip_start, a.flag FROM clean_legs l LEFT JOIN attributes a ON l.ssvid = a.ssvid AND year(l.trip_start) = a.year WHERE a.is_fishing)",
    "clean_legs", "attributes",
)
def left_join_filtered(q: Inputs):
    legs = voyages.clean_legs(q.legs(), VOYAGES).withColumn("year", F.year("trip_start"))
    known = vessels.attributes_by_year(q.by_year())
    return legs.join(known, ["ssvid", "year"], "left").where(F.col("is_fishing").eqNullSafe(True))


@query(
    "c5_left_join_on_two_keys", "ssvid trip_start:t flag",
    "(SELECT l.ssvid, l.trip_start, a.flag FROM clean_legs l LEFT JOIN attributes a ON l.ssvid = a.ssvid AND year(l.trip_start) = a.year)",
    "clean_legs", "attributes",
)
def left_join_two_keys(q: Inputs):
    legs = voyages.clean_legs(q.legs(), VOYAGES).withColumn("year", F.year("trip_start"))
    return legs.join(vessels.attributes_by_year(q.by_year()), ["ssvid", "year"], "left")


@query(
    "c6_points_in_intervals", "event_id:i trip_id",
    """(SELECT event_id, trip_id FROM events e JOIN trip_risk t ON e.user_id::VARCHAR = t.ssvid AND ts BETWEEN trip_start AND trip_end)""",
    "trip_risk",
)
def points_in_intervals(q: Inputs):
    points = q.table("events").selectExpr("event_id", "cast(user_id AS string) AS ssvid", "ts")
    return contained_in(points, q.trip_risk(), ["ssvid"], at="ts", start="trip_start", end="trip_end", bucket="day")


@query(
    "c6_spans_strictly_in_intervals", "l_orderkey:i trip_start:t n:i",
    """(SELECT l_orderkey, trip_start, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN clean_legs ON ssvid = o_custkey::VARCHAR
        WHERE trip_start < l_shipdate AND trip_end > l_shipdate + INTERVAL 2 DAY GROUP BY ALL)""",
    "clean_legs",
)
def spans_in_intervals(q: Inputs):
    owners = q.table("orders").selectExpr("o_orderkey AS l_orderkey", "cast(o_custkey AS string) AS ssvid")
    spans = q.table("lineitem").join(owners, "l_orderkey").selectExpr(
        "l_orderkey", "ssvid", "l_shipdate AS s", "timestampadd(DAY, 2, l_shipdate) AS e"
    )
    legs = voyages.clean_legs(q.legs(), VOYAGES)
    inside = contained_in(spans, legs, ["ssvid"], at="s", until="e", start="trip_start", end="trip_end", strict=True)
    return inside.groupBy("l_orderkey", "trip_start").agg(F.count("*").alias("n"))


@query(
    "c7_members_of_one_event", "event carrier_ssvid neighbor_ssvid",
    """(SELECT DISTINCT a.event, a.vessel_id AS carrier_ssvid, b.vessel_id AS neighbor_ssvid FROM encounter_rows a JOIN encounter_rows b
        ON a.event = b.event WHERE a.vessel_id::BIGINT < 1000000 AND a.vessel_id <> b.vessel_id)""",
    "encounter_rows",
)
def event_members(q: Inputs):
    rows = q.encounters().select(F.split_part("event_id", F.lit("."), F.lit(1)).alias("event"), "vessel_id").distinct()
    own = rows.where("cast(vessel_id AS bigint) < 1000000").withColumnRenamed("vessel_id", "carrier_ssvid")
    others = rows.withColumnRenamed("vessel_id", "neighbor_ssvid")
    return own.join(others, "event").where("carrier_ssvid <> neighbor_ssvid")


@query(
    "c8_radius_join", "s2id port_id distance_m:d",
    f"""(SELECT s2id, port_id, {distance_m('a.lat', 'a.lon', 'p.lat', 'p.lon')} AS distance_m FROM anchorages a, port_risk p
        WHERE {distance_m('a.lat', 'a.lon', 'p.lat', 'p.lon')} <= 3000)""",
    "anchorages", "port_risk",
)
def radius(q: Inputs):
    sites = q.port_risk().selectExpr("port_id", "lat AS port_lat", "lon AS port_lon")
    return radius_join(q.anchorages(), sites, point=("lat", "lon"), site=("port_lat", "port_lon"), radius_m=3000)


def _suppliers_and_customers(q: Inputs):
    points = q.table("customer").selectExpr(
        "c_custkey", "(c_custkey * 37) % 170 - 85 + (c_custkey % 5) * 0.04D AS lat",
        "cast((c_custkey * 91) % 360 - 180 AS double) AS lon",
    )
    return points, q.anchorages().selectExpr("s2id", "lat AS site_lat", "lon AS site_lon")


_POINTS = """(SELECT c_custkey, (c_custkey * 37) % 170 - 85 + (c_custkey % 5) * 0.04::DOUBLE AS lat,
    ((c_custkey * 91) % 360 - 180)::DOUBLE AS lon FROM customer)"""


@query(
    "c9_near_any_site", "c_custkey:i",
    f"""(SELECT DISTINCT c_custkey FROM {_POINTS} c, anchorages a WHERE {distance_m('c.lat', 'c.lon', 'a.lat', 'a.lon')} < 10000)""",
    "anchorages",
)
def near_any(q: Inputs):
    points, sites = _suppliers_and_customers(q)
    near = near_any_site(points, sites, point=("lat", "lon"), site=("site_lat", "site_lon"), radius_m=10_000)
    return near.select("c_custkey")


@query("c10_semi_join", "o_orderkey:i", "orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def semi_join(q: Inputs):
    rich = q.table("customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return q.table("orders").join(rich, "o_custkey", "left_semi")


@query(
    "c11_either_semi_join", "c_custkey:i",
    """customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)
        OR c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)""",
)
def either_semi(q: Inputs):
    big = q.table("orders").where("o_totalprice > 490000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    rich = q.table("supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    return (
        q.table("customer").join(big.withColumn("a", F.lit(True)), "c_custkey", "left")
        .join(rich.withColumn("b", F.lit(True)), "c_nationkey", "left").where("a OR b")
    )


@query(
    "c12_anti_join_null_safe", "c_custkey:i",
    "customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def anti_join(q: Inputs):
    keys = q.table("orders").selectExpr("CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END AS c_custkey")
    return q.table("customer").join(keys.where("c_custkey IS NOT NULL"), "c_custkey", "left_anti")


@query(
    "c13_anti_join_on_array", "ssvid year:i",
    "(SELECT ssvid, year FROM by_year WHERE c_custkey NOT IN (SELECT id FROM bad_vessels))", "by_year", "bad_vessels",
)
def anti_array(q: Inputs):
    return vessels.quality_vessel_years(q.by_year(), q.bad_vessels(), rules=())


@query(
    "c14_membership_flag", "s2id in_canal",
    "(SELECT s2id, s2id IN (SELECT s2id FROM anchorages WHERE sublabel = 'PANAMA CANAL') AS in_canal FROM anchorages)", "anchorages",
)
def membership(q: Inputs):
    ids = q.anchorages().withColumnRenamed("s2id", "trip_end_anchorage_id").select("trip_end_anchorage_id")
    return voyages.flag_canal_ends(ids, q.anchorages()).selectExpr("trip_end_anchorage_id AS s2id", "ends_in_canal AS in_canal")


@query(
    "c15_typed_pair_key", "vessel_id start_timestamp:t is_encountered",
    """(SELECT v.vessel_id, v.start_timestamp, e.is_encountered FROM study_visits v
        LEFT JOIN (SELECT vessel_id, start_timestamp, k % 8 = 0 AS is_encountered FROM study_visits WHERE k % 4 = 0) e
        ON v.vessel_id || v.start_timestamp::VARCHAR = e.vessel_id || e.start_timestamp::VARCHAR)""",
    "study_visits",
)
def pair_key(q: Inputs):
    known = q.study_encountered().selectExpr("ssvid AS vessel_id", "trip_end AS start_timestamp", "is_encountered")
    return q.study_visits().join(known, ["vessel_id", "start_timestamp"], "left")


@query(
    "c16_aligned_merge", "trip_id n:i",
    "(SELECT t.trip_id, n FROM trip_rows t LEFT JOIN (SELECT trip_id, count(*) AS n FROM carrier_loitering GROUP BY 1) l USING (trip_id))",
    "trip_rows", "carrier_loitering",
)
def aligned_merge(q: Inputs):
    counts = q.carrier_loitering().groupBy("trip_id").agg(F.count("*").alias("n"))
    return q.trips().select("trip_id").join(counts, "trip_id", "left")


@query("c17_rows_not_observed", "trip_id", "(SELECT trip_id FROM complete_trips EXCEPT SELECT trip_id FROM observed_trips)", "complete_trips", "observed_trips")
def not_observed(q: Inputs):
    complete = risk.complete_trips(q.trips())
    return risk.unobserved(complete, risk.observed_trips(complete))


@query(
    "c18_classes_seen", "trip_id",
    "(SELECT trip_id FROM complete_trips WHERE vessel_class IN (SELECT vessel_class FROM observed_trips WHERE risk_score > 3.5))",
    "complete_trips", "observed_trips",
)
def classes_seen(q: Inputs):
    complete = risk.complete_trips(q.trips())
    return risk.seen_classes(complete, risk.observed_trips(complete).where("risk_score > 3.5"))


@query(
    "c19_lookup_and_replace", "ssvid flag flag_sovereign port_iso3_sovereign n:i",
    """(SELECT ssvid, flag, coalesce(f.sovereign, flag) AS flag_sovereign, coalesce(p.sovereign, port_iso3) AS port_iso3_sovereign, count(*) AS n
        FROM panel_visits LEFT JOIN sovereigns f ON flag = f.territory LEFT JOIN sovereigns p ON port_iso3 = p.territory GROUP BY ALL)""",
    "panel_visits", "sovereigns",
)
def lookup_replace(q: Inputs):
    pairs = policy.sovereign_pairs(q.zones(), position="position")
    return policy.with_sovereigns(q.panel_visits(), pairs).groupBy(
        "ssvid", "flag", "flag_sovereign", "port_iso3_sovereign"
    ).agg(F.count("*").alias("n"))


# -- D: aggregates ---------------------------------------------------------------------------------------


@query("d1_distinct_rows", "l_orderkey:i l_linenumber:i", "(SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def distinct_rows(q: Inputs):
    return q.table("lineitem").select("l_orderkey", "l_linenumber").distinct()


@query("d2_grouped_sum", "l_returnflag l_linestatus total:d", "(SELECT l_returnflag, l_linestatus, sum(l_quantity) AS total FROM lineitem GROUP BY ALL)")
def grouped_sum(q: Inputs):
    return q.table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("total"))


@query(
    "d3_f3_nearest_per_group", "o_custkey:i o_orderkey:i",
    "(SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 1)",
)
def nearest(q: Inputs):
    return q.table("orders").groupBy("o_custkey").agg(
        F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey")
    )


@query("d4_few_frequent_names", "ssvid year:i", "few_names", "few_names")
def few_names(q: Inputs):
    return vessels.RULES["few_names"](q.by_year())


@query("d5_count_values", "flag_group n:i", "(SELECT flag_group, count(vessel_class) AS n FROM trip_rows GROUP BY ALL)", "trip_rows")
def count_values(q: Inputs):
    return q.trips().groupBy("flag_group").agg(F.count("vessel_class").alias("n"))


@query(
    "d6_d7_first_and_any", "trip_id to_iuu_high:i with_china:i loitering:i",
    """(SELECT trip_id, max(to_iuu_high) AS to_iuu_high, max(CASE WHEN neighbor_flag_group = 'china' THEN 1 ELSE 0 END) AS with_china,
          (trip_id IN (SELECT trip_id FROM carrier_loitering WHERE ssvid IS NOT NULL))::INT AS loitering
        FROM carrier_rows WHERE neighbor_vessel_class IS NOT NULL GROUP BY trip_id)""",
    "carrier_rows", "carrier_loitering",
)
def first_and_any(q: Inputs):
    return risk.carrier_design(q.carrier_rows(), q.carrier_loitering())


@query(
    "d6_first_of_varying_values", "trip_id to_iuu_high:i time_at_sea",
    """(SELECT trip_id, first(v ORDER BY event_start, neighbor_ssvid) FILTER (v IS NOT NULL) AS to_iuu_high, first(time_at_sea) AS time_at_sea FROM (
          SELECT *, CASE WHEN neighbor_ssvid::BIGINT % 3 <> 0 THEN neighbor_ssvid::BIGINT % 7 END AS v FROM carrier_rows
          WHERE neighbor_vessel_class IS NOT NULL) GROUP BY trip_id)""",
    "carrier_rows",
)
def first_of_varying(q: Inputs):
    """Values that differ from row to row of a trip, some missing: the earliest known one counts."""
    vessel = F.col("neighbor_ssvid").cast("long")
    rows = q.carrier_rows().withColumn("to_iuu_high", F.when(vessel % 3 != 0, vessel % 7))
    return risk.carrier_design(rows, q.carrier_loitering())


@query(
    "d8_column_summary", "mean:d sd:d se:d lower:d upper:d",
    """(SELECT avg(x) AS mean, stddev_samp(x) AS sd, stddev_samp(x) / sqrt(count(x)) AS se, quantile_cont(x, 0.025) AS lower,
          quantile_cont(x, 0.975) AS upper FROM (SELECT abs(l_quantity - 25) AS x FROM lineitem))""",
)
def column_summary(q: Inputs):
    # Equal values are counted first, so the exact quantiles keep one entry per value.
    values = q.table("lineitem").groupBy(F.abs(F.col("l_quantity") - 25).alias("x")).agg(F.count("*").alias("n"))
    rows, quantiles = F.sum("n"), F.percentile("x", F.array(F.lit(0.025), F.lit(0.975)), F.col("n"))
    mean = F.sum(F.col("x") * F.col("n")) / rows
    sd = F.sqrt((F.sum(F.col("x") * F.col("x") * F.col("n")) - rows * mean * mean) / (rows - 1))
    return values.agg(
        mean.alias("mean"), sd.alias("sd"), (sd / F.sqrt(rows)).alias("se"),
        quantiles[0].alias("lower"), quantiles[1].alias("upper"),
    )


@query(
    "d9_conditional_summary", "l_returnflag n:i mean:d sd:d",
    "(SELECT l_returnflag, count(*) AS n, avg(l_tax) AS mean, stddev_pop(l_tax) AS sd FROM lineitem WHERE l_quantity > 40 GROUP BY 1 HAVING count(*) > 1)",
)
def conditional_summary(q: Inputs):
    return q.table("lineitem").where("l_quantity > 40").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.avg("l_tax").alias("mean"), F.stddev_pop("l_tax").alias("sd")
    ).where("n > 1")


@query("d10_scaled_by_group_bounds", "lat_bin:d lon_bin:d risk_class:i scaled:d", "scaled_effort", "scaled_effort")
def scaled_by_bounds(q: Inputs):
    from workload.risk_queries import scaled

    return scaled(q)


@query("d11_quantile_threshold", "cut:d", "(SELECT quantile_cont(l_quantity, 0.95) AS cut FROM lineitem)")
def quantile_threshold(q: Inputs):
    values = q.table("lineitem").groupBy("l_quantity").agg(F.count("*").alias("n"))
    return values.agg(F.percentile("l_quantity", F.lit(0.95), F.col("n")).alias("cut"))


_PROBABILITIES = (0.0, 0.025, 0.5, 0.95, 1.0)


@query(
    "d11_continuous_quantiles", "l_returnflag n:i " + " ".join(f"q{i}:d" for i in range(5)),
    "(SELECT l_returnflag, count(*) AS n, "
    + ", ".join(f"quantile_cont(l_extendedprice, {p}) AS q{i}" for i, p in enumerate(_PROBABILITIES))
    + " FROM lineitem GROUP BY 1)",
)
def continuous_quantiles(q: Inputs):
    found = exact_quantiles(q.table("lineitem"), "l_extendedprice", _PROBABILITIES, ["l_returnflag"])
    return found.select("l_returnflag", "n", *[F.col("quantiles")[i].alias(f"q{i}") for i in range(5)])


@query(
    "d8_continuous_summary", "mean:d sd:d se:d lower:d upper:d",
    """(SELECT avg(x) AS mean, stddev_samp(x) AS sd, stddev_samp(x) / sqrt(count(x)) AS se, quantile_cont(x, 0.025) AS lower,
          quantile_cont(x, 0.975) AS upper FROM (SELECT abs(o_totalprice - 100000)::DOUBLE AS x FROM orders))""",
)
def continuous_summary(q: Inputs):
    rows = q.table("orders").select(F.abs(F.col("o_totalprice") - 100000).cast("double").alias("x"))
    moments = rows.agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), (F.stddev_samp("x") / F.sqrt(F.count("x"))).alias("se")
    )
    bounds = exact_quantiles(rows, "x", (0.025, 0.975)).select(
        F.col("quantiles")[0].alias("lower"), F.col("quantiles")[1].alias("upper")
    )
    # One row each.
    return moments.crossJoin(bounds)


@query("d12_distinct_values", "o_orderpriority", "(SELECT DISTINCT o_orderpriority FROM orders)")
def distinct_values(q: Inputs):
    return q.table("orders").select("o_orderpriority").distinct()


@query("d13_count_rows", "n:i", "(SELECT count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(o_totalprice) >= 2000000))")
def count_rows(q: Inputs):
    big = q.table("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")).where("s >= 2000000")
    return big.agg(F.count("*").alias("n"))


# -- E: ordered scans ----------------------------------------------------------------------------------------

_W = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


def _scan(q: Inputs, **wanted):
    orders = q.table("orders").withColumn("gap", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")))
    key, order = ["o_custkey"], ["o_orderdate", "o_orderkey"]
    return ordered_scan(slice_groups(orders, key, order), key, order, **wanted)


@query(
    "e1_e2_neighbours", "o_orderkey:i before:d after:d since:t",
    f"(SELECT *, lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after,"
    f" coalesce(lag(o_orderdate) OVER w, TIMESTAMP '2000-01-01') AS since FROM orders WINDOW w AS {_W})",
)
def neighbours(q: Inputs):
    scanned = _scan(q, previous={"before": "o_totalprice", "since": "o_orderdate"}, following={"after": "o_totalprice"})
    return scanned.withColumn("since", F.coalesce("since", F.lit("2000-01-01").cast("timestamp")))


@query(
    "e3_current_row", "o_orderkey:i same:d",
    f"(SELECT *, lag(o_totalprice, 0) OVER {_W} AS same FROM orders)",
)
def current_row(q: Inputs):
    # A shift of zero rows is the row itself and needs no window.
    return q.table("orders").withColumn("same", F.col("o_totalprice"))


@query(
    "e4_e5_fills", "o_orderkey:i back:d ahead:d",
    f"""(SELECT o_orderkey, last_value(gap IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS back,
          first_value(gap IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead
        FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS gap FROM orders))""",
)
def fills(q: Inputs):
    return _scan(q, fill_forward={"back": "gap"}, fill_backward={"ahead": "gap"})


@query(
    "e6_block_bounds", "o_custkey:i first_status last_status",
    f"""(SELECT DISTINCT o_custkey, first_value(o_orderstatus) OVER {_W} AS first_status,
          first_value(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS last_status FROM orders)""",
)
def block_bounds(q: Inputs):
    position = F.struct("o_orderdate", "o_orderkey")
    return q.table("orders").groupBy("o_custkey").agg(
        F.min_by("o_orderstatus", position).alias("first_status"), F.max_by("o_orderstatus", position).alias("last_status")
    )


@query(
    "e7_first_by_rank", "p_brand p_partkey:i",
    "(SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r FROM part) WHERE r = 1)",
)
def first_by_rank(q: Inputs):
    return q.table("part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("p_partkey"))


@query(
    "e8_paired_events", "vessel_id stop_begin_time:t stop_end_time:t",
    "(SELECT * FROM durations_30 WHERE stop_end_time IS NOT NULL)", "durations_30",
)
def paired_events(q: Inputs):
    from tidemark.plans.ports import port_stops

    return port_stops(q.port_visits()).where("stop_end_time IS NOT NULL")


@query(
    "e9_f2_f4_cumulative_share", "n:i share:d past",
    """(SELECT n, share, share > 0.95 AS past FROM (SELECT n, sum(step) OVER (ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(step) OVER () AS share
        FROM (SELECT n, sum(n) AS step FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1) GROUP BY n)))""",
)
def cumulative_share(q: Inputs):
    counts = q.table("part").groupBy("p_size").agg(F.count("*").alias("n"))
    running, total = running_sums(counts, "n", F.col("n"), descending=True)
    share = F.col("running") / F.lit(total)
    return running.select("n", share.alias("share"), (share > 0.95).alias("past"))


@query(
    "e9_running_totals", "o_totalprice:d rows:i running:i",
    """(SELECT o_totalprice, rows, sum(step) OVER (ORDER BY o_totalprice) AS running FROM (
          SELECT o_totalprice, count(*) AS rows, sum(round(o_totalprice * 100)::BIGINT) AS step FROM orders GROUP BY 1))""",
)
def running_totals(q: Inputs):
    """A column with nearly as many values as rows."""
    return running_sums(q.table("orders"), "o_totalprice", F.round(F.col("o_totalprice") * 100).cast("long"))[0]


# -- F, G: order and sets ---------------------------------------------------------------------------------------


@query("f1_ordered_result", "n_regionkey:i n_name", "(SELECT * FROM nation ORDER BY n_regionkey, n_name)")
def ordered_result(q: Inputs):
    return q.table("nation").orderBy("n_regionkey", "n_name")


@query("g1_present_in_both", "ssvid", "(SELECT ssvid FROM by_year WHERE year = 1996 INTERSECT SELECT ssvid FROM by_year WHERE year = 1998)", "by_year")
def present_in_both(q: Inputs):
    return vessels.vessels_in_every_year(q.by_year(), (1996, 1998))


@query(
    "g2_ports_in_both_periods", "port_iso3",
    "(SELECT port_iso3 FROM panel WHERE after = 0 INTERSECT SELECT port_iso3 FROM panel WHERE after = 1)", "panel",
)
def ports_in_both(q: Inputs):
    from workload.study_queries import panel

    return panel(q).select("port_iso3").distinct()


@query(
    "g3_concatenation_by_name", "id:i name balance:d nation:i",
    "(SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier)",
)
def concatenation(q: Inputs):
    a = q.table("customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance")
    b = q.table("supplier").selectExpr("s_nationkey AS nation", "s_suppkey AS id", "s_name AS name")
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "g4_appended_rows", "n_nationkey:i n_name n_regionkey:i",
    "(SELECT * FROM nation UNION ALL VALUES (100, 'MACAO', 2), (101, 'HONG KONG', 2))",
)
def appended(q: Inputs):
    return tables.append_rows(q.table("nation"), [(100, "MACAO", 2), (101, "HONG KONG", 2)])


@query(
    "g5_category_pairs", "a b",
    """(SELECT x.c AS a, y.c AS b FROM (SELECT DISTINCT 'flag' AS f, o_orderpriority AS c FROM orders UNION ALL SELECT DISTINCT 'tas', o_orderstatus FROM orders) x,
          (SELECT DISTINCT 'flag' AS f, o_orderpriority AS c FROM orders UNION ALL SELECT DISTINCT 'tas', o_orderstatus FROM orders) y
        WHERE x.c <= y.c AND (x.f <> y.f OR x.c = y.c))""",
)
def category_pairs(q: Inputs):
    orders = q.table("orders")
    categories = (
        orders.select(F.lit("flag").alias("f"), F.col("o_orderpriority").alias("c")).distinct()
        .unionByName(orders.select(F.lit("tas").alias("f"), F.col("o_orderstatus").alias("c")).distinct())
    )
    # Category names are a handful; their pairs are unfolded from one row, without a join.
    names = categories.agg(F.collect_set(F.struct("f", "c")).alias("names"))
    pairs = names.withColumn("x", F.explode("names")).withColumn("y", F.explode("names"))
    allowed = (F.col("x.f") != F.col("y.f")) | (F.col("x.c") == F.col("y.c"))
    return pairs.where((F.col("x.c") <= F.col("y.c")) & allowed).select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))


# -- H: scalar functions -----------------------------------------------------------------------------------------


@query(
    "h1_h2_h3_h4_time_differences", "ssvid trip_start:t hours:d minutes:i millis:i hex",
    """(SELECT *, date_sub('second', trip_start, trip_end) / 3600.0::DOUBLE AS hours, date_sub('minute', trip_start, trip_end) AS minutes,
          epoch_ms(trip_start) AS millis, format('{:012x}', epoch_ms(trip_start)) AS hex FROM legs)""",
    "legs",
)
def time_differences(q: Inputs):
    s, e = F.col("trip_start"), F.col("trip_end")
    return q.legs().select(
        "ssvid", "trip_start", hours_between(s, e).alias("hours"), whole_minutes(s, e).alias("minutes"),
        F.unix_millis(s).alias("millis"), hex_millis(s).alias("hex"),
    )


@query(
    "h5_h6_h20_dates", "event_id:i y:i d:D in_week",
    "(SELECT *, year(ts) AS y, ts::DATE AS d, ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' AS in_week FROM events)",
)
def dates(q: Inputs):
    week = (F.col("ts") >= F.lit("2024-01-08").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-15").cast("timestamp"))
    return q.table("events").select("event_id", F.year("ts").alias("y"), F.to_date("ts").alias("d"), week.alias("in_week"))


@query(
    "h7_h8_h9_h12_texts", "event_id part:i k joined number:i",
    """(SELECT event_id, split_part(event_id || '.' || user_id, '.', 1)::BIGINT AS part, json_extract_string(props, '$.k') AS k,
          event_type || user_id AS joined, try_cast(CASE WHEN event_id % 2 = 0 THEN event_type ELSE user_id::VARCHAR END AS BIGINT) AS number FROM events)""",
)
def texts(q: Inputs):
    return q.table("events").selectExpr(
        "event_id", "cast(split_part(concat(event_id, '.', user_id), '.', 1) AS bigint) AS part",
        "get_json_object(props, '$.k') AS k", "concat(event_type, user_id) AS joined",
        "try_cast(CASE WHEN event_id % 2 = 0 THEN event_type ELSE cast(user_id AS string) END AS bigint) AS number",
    )


@query(
    "h10_h11_h16_conditions", "p_partkey:i matches choice bucket:i",
    """(SELECT p_partkey, regexp_matches(p_type, 'A.*R') AS matches, CASE WHEN p_size > 25 THEN 'large' WHEN p_size IS NULL THEN NULL ELSE 'small' END AS choice,
          CASE WHEN p_size - 20 < 0 THEN 0 WHEN p_size - 20 < 2 THEN 1 ELSE 2 END AS bucket FROM part)""",
)
def conditions(q: Inputs):
    size = F.col("p_size")
    return q.table("part").select(
        "p_partkey", F.col("p_type").rlike("A.*R").alias("matches"),
        F.when(size > 25, "large").when(size.isNull(), None).otherwise("small").alias("choice"),
        classes.risk_class(size - 20).alias("bucket"),
    )


@query(
    "h13_h14_h15_numbers", "ssvid lat_bin:d lon_bin:d middle:d loghours:d",
    "(SELECT user_id::VARCHAR AS ssvid, round((user_id * 13) % 150 - 75 + (event_id % 20) * 0.25::DOUBLE) AS lat_bin,"
    " round((user_id * 29) % 350 - 175 + (event_id % 16) * 0.25::DOUBLE) AS lon_bin, (user_id + event_id) / 2.0 AS middle,"
    " ln((60 + event_id) / 60.0::DOUBLE) AS loghours FROM events)",
)
def numbers(q: Inputs):
    events = q.table("events")
    lat = (F.col("user_id") * 13) % 150 - 75 + (F.col("event_id") % 20) * F.lit(0.25)
    lon = (F.col("user_id") * 29) % 350 - 175 + (F.col("event_id") % 16) * F.lit(0.25)
    return events.select(
        F.col("user_id").cast("string").alias("ssvid"), degree_bin(lat).alias("lat_bin"), degree_bin(lon).alias("lon_bin"),
        midpoint(F.col("user_id"), F.col("event_id")).alias("middle"),
        F.log((60 + F.col("event_id")) / F.lit(60.0)).alias("loghours"),
    )


@query(
    "h17_indicator_columns", "o_orderkey:i o_orderstatus_F:i o_orderstatus_O:i",
    "(SELECT o_orderkey, (o_orderstatus = 'F')::INT AS o_orderstatus_F, (o_orderstatus = 'O')::INT AS o_orderstatus_O FROM orders)",
)
def indicators(q: Inputs):
    return risk.one_hot(q.table("orders"), {"o_orderstatus": ["F", "O"]})


@query(
    "h18_readable_labels", "raw label",
    """(SELECT DISTINCT vessel_class AS raw, upper(vessel_class[1]) || CASE WHEN vessel_class IN ('trawlers', 'trollers', 'driftnets')
          THEN vessel_class[2:-2] ELSE replace(vessel_class[2:], '_', ' ') END AS label FROM trip_rows WHERE vessel_class IS NOT NULL)""",
    "trip_rows",
)
def readable(q: Inputs):
    from tidemark.plans.report import category_label

    raw = q.trips().where("vessel_class IS NOT NULL").select(F.col("vessel_class").alias("raw")).distinct()
    return raw.withColumn("label", category_label(F.col("raw")))


@query(
    "h19_name_to_code", "n_name iso3",
    "(SELECT n_name, 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS iso3 FROM nation WHERE n_nationkey % 8 <> 7 AND n_nationkey <> 4 AND n_nationkey % 5 <> 3)",
)
def name_to_code(q: Inputs):
    codes = tables.drop_blank_rows(q.policy_dates(), required=["country", "entry_date"]).select(
        F.col("country").alias("n_name"), "iso3"
    )
    return q.table("nation").select("n_name").join(codes, "n_name")


# -- I: nested data ------------------------------------------------------------------------------------------------


@query("i1_i5_exploded_structs", "vessel_id start_timestamp:t timestamp:t anchorage_id event_type", "port_events", "port_events")
def exploded(q: Inputs):
    return q.port_visits().select("vessel_id", "start_timestamp", F.explode("events").alias("e")).select(
        "vessel_id", "start_timestamp", "e.timestamp", "e.anchorage_id", "e.event_type"
    )


@query(
    "i2_outer_explode", "ssvid year:i registered",
    "(SELECT ssvid, year, unnest(CASE WHEN len(registered) = 0 THEN [NULL] ELSE registered END) AS registered FROM by_year)", "by_year",
)
def outer_explode(q: Inputs):
    return q.by_year().select("ssvid", "year", F.explode_outer("registry_info.best_known_vessel_class").alias("registered"))


@query(
    "i3_two_arrays", "ssvid source first_timestamp:t",
    """(SELECT c_custkey::VARCHAR AS ssvid, source, first_timestamp FROM customer, (VALUES ('a'), ('b')) AS r(source),
          LATERAL (SELECT TIMESTAMP '1994-01-01' + to_days((c_custkey % 400)::INT) AS first_timestamp
            UNION ALL SELECT TIMESTAMP '2000-01-01' + to_days((c_custkey % 300)::INT)) WHERE c_custkey % 11 <> 3)""",
)
def two_arrays(q: Inputs):
    rows = q.carriers().select("identity.ssvid", F.explode("registry.source").alias("source"), "activity")
    return rows.select("ssvid", "source", F.explode("activity.first_timestamp").alias("first_timestamp"))


@query("i4_exploded_ids", "id:i", "bad_vessels", "bad_vessels")
def exploded_ids(q: Inputs):
    return q.bad_vessels().select(F.explode("ssvid").alias("id")).where("id IS NOT NULL")


@query(
    "i6_array_element", "event_id:i first",
    "(SELECT event_id, split_part(event_type || '.x', '.', 1) AS first FROM events)",
)
def array_element(q: Inputs):
    parts: Column = F.split(F.concat("event_type", F.lit(".x")), r"\.")
    return q.table("events").select("event_id", F.element_at(parts, 1).alias("first"))


# -- J: geography --------------------------------------------------------------------------------------------------


@query(
    "j1_j2_j3_distances", "s2id distance_m:d within",
    f"(SELECT s2id, d AS distance_m, d <= 5000000 AS within FROM (SELECT s2id, {distance_m('lat', 'lon', '10', '20')} AS d FROM anchorages))",
    "anchorages",
)
def distances(q: Inputs):
    d = haversine_m(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0))
    return q.anchorages().select("s2id", d.alias("distance_m"), (d <= 5_000_000).alias("within"))


@query(
    "j4_far_from_all_sites", "c_custkey:i",
    f"""(SELECT c_custkey FROM {_POINTS} WHERE c_custkey NOT IN (SELECT c_custkey FROM {_POINTS} c, anchorages a
          WHERE {distance_m('c.lat', 'c.lon', 'a.lat', 'a.lon')} < 10000))""",
    "anchorages",
)
def far_from_sites(q: Inputs):
    points, sites = _suppliers_and_customers(q)
    return far_from_all(points, sites, point=("lat", "lon"), site=("site_lat", "site_lon"), radius_m=10_000)


@query(
    "j5_valid_positions", "event_id lat_mean:d lon_mean:d",
    "(SELECT * FROM encounter_rows WHERE abs(lat_mean) < 90 AND abs(lon_mean) < 180)", "encounter_rows",
)
def valid_positions(q: Inputs):
    return q.encounters().where(inside_world(F.col("lat_mean"), F.col("lon_mean")))


@query(
    "j6_j7_cells", "lat_bin:d km2:d n:i",
    """(SELECT round(lat) AS lat_bin, 40680631.590769 * radians(1.0) * abs(sin(radians(round(lat) + 1)) - sin(radians(round(lat)))) AS km2, count(*) AS n
        FROM fishing_rows GROUP BY ALL)""",
    "fishing_rows",
)
def cells(q: Inputs):
    from tidemark.plans.effort import fishing_positions

    rows = fishing_positions(q.positions(), q.segments())
    counted = rows.groupBy(degree_bin(F.col("lat")).alias("lat_bin")).agg(F.count("*").alias("n"))
    return counted.withColumn("km2", cell_area_km2(F.col("lat_bin")))


@query(
    "j8_midpoints", "ssvid lon_mean:d lat_mean:d loitering_start_timestamp:t", "loitering", "loitering",
)
def midpoints(q: Inputs):
    from tidemark.plans.encounters import loitering_events

    return loitering_events(q.loitering())


# -- U: parameters ---------------------------------------------------------------------------------------------------


@query(
    "u1_parameters", "ssvid n:i",
    """(SELECT ssvid, count(*) AS n FROM legs WHERE trip_start <= TIMESTAMP '1998-12-31' AND trip_end >= TIMESTAMP '1997-01-01'
        AND trip_start_anchorage_id <> '10000001' AND trip_end_anchorage_id <> '10000001' GROUP BY 1)""",
    "legs",
)
def parameters(q: Inputs):
    from tidemark.params import VoyageParams

    window = VoyageParams(minimum="1997-01-01", maximum="1998-12-31")
    return voyages.clean_legs(q.legs(), window).groupBy("ssvid").agg(F.count("*").alias("n"))
