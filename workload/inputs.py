"""Plan inputs derived from the given tables, on Spark.

The tables hold orders, events and so on; each input below is a projection or
aggregate of one or two of them with the columns the plans read.
:mod:`workload.inputs_sql` states the same inputs for the check SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.params import EncounterParams, VoyageParams
from tidemark.session import configure

# The study windows of this data.
VOYAGES = VoyageParams(minimum="1995-01-01", maximum="2001-12-31")
ENCOUNTERS = EncounterParams(last_event="2001-12-31", carrier_first_seen="2000-06-30")

RAW_GEAR = (
    "'trawlers','trollers','driftnets','purse_seines','tuna_purse_seines','other_purse_seines',"
    "'set_gillnets','squid_jigger','pole_and_line','set_longlines','pots_and_traps','drifting_longlines'"
)
FLAGS = "'CHN','PAN','LBR','ESP','UNK','XXX',cast(null as string)"
YEARS = "1995,1996,1997,1998,1999,2000,2001,2024"

# Rows of a table that a task repeats.
ROWS_PER_TASK = 25_000


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        """A given table; wall-clock times become UTC timestamps."""
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        for column, kind in df.dtypes:
            if kind == "timestamp_ntz":
                df = df.withColumn(column, F.col(column).cast("timestamp"))
        return df

    def dealt(self, name: str, key: str) -> DataFrame:
        """A given table dealt over tasks by its rows, for rows that are repeated before a shuffle.

        A file of some MB is read by one task, which would sort all the copies by itself.
        Spark reads the number of rows off the footers.
        """
        rows = self.table(name)
        tasks = rows.count() // ROWS_PER_TASK
        return rows.repartition(tasks, key) if tasks > 1 else rows

    # -- ports ---------------------------------------------------------------------

    def anchorages(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "concat('a', s_suppkey) AS s2id",
            "concat('PORT_', s_suppkey % 40) AS label",
            "CASE WHEN s_suppkey % 9 = 0 THEN 'PANAMA CANAL' END AS sublabel",
            "concat('N', lpad(cast(s_nationkey AS string), 2, '0')) AS iso3",
            "cast((s_suppkey * 37) % 170 - 85 AS double) AS lat",
            "cast((s_suppkey * 91) % 360 - 180 AS double) AS lon",
            "s_suppkey % 3 <> 0 AS at_dock",
        )

    def port_risk(self) -> DataFrame:
        vote = "CASE WHEN s_suppkey % 6 = 0 THEN 0L ELSE {} END"
        return self.table("supplier").where("s_suppkey % 2 = 0").selectExpr(
            "concat('p', s_suppkey) AS port_id",
            "concat('PORT_', s_suppkey % 40) AS port",
            "concat('N', lpad(cast(s_nationkey AS string), 2, '0')) AS country",
            "(s_suppkey * 37) % 170 - 85 + CASE WHEN s_suppkey % 10 = 4 THEN 0.05D ELSE 0.01D END AS lat",
            "cast((s_suppkey * 91) % 360 - 180 AS double) AS lon",
            vote.format("3 * ((s_suppkey DIV 4) % 2)") + " AS not_associated",
            vote.format("s_suppkey % 4") + " AS iuu_low",
            vote.format("s_suppkey % 3") + " AS iuu_med",
            vote.format("s_suppkey % 5") + " AS iuu_high",
            vote.format("(s_suppkey + 1) % 4") + " AS la_low",
            vote.format("(s_suppkey + 1) % 3") + " AS la_med",
            vote.format("(s_suppkey + 1) % 5") + " AS la_high",
        )

    # -- trips ---------------------------------------------------------------------

    def legs(self) -> DataFrame:
        """Every ninth leg is listed twice."""
        twice = self.table("orders").withColumn("_copy", F.expr("explode(sequence(0, int(o_orderkey % 9 = 0)))"))
        return twice.selectExpr(
            "cast(o_custkey AS string) AS ssvid",
            "array(cast(o_custkey AS string)) AS vessel_ids",
            "CASE WHEN o_orderkey % 101 = 0 THEN timestamp'1800-01-01 00:00:00'"
            " ELSE timestampadd(HOUR, o_orderkey % 24, o_orderdate) END AS trip_start",
            "CASE WHEN o_orderkey % 103 = 0 THEN timestamp'2100-01-01 00:00:00' ELSE timestampadd(HOUR,"
            " (o_orderkey % 45) * 24 + o_orderkey % 24 + o_orderkey % 7, o_orderdate) END AS trip_end",
            "CASE WHEN o_orderkey % 101 = 0 THEN 'NO_PREVIOUS_DATA' WHEN o_orderkey % 97 = 0 THEN '10000001'"
            " ELSE concat('a', o_orderkey % 100) END AS trip_start_anchorage_id",
            "CASE WHEN o_orderkey % 103 = 0 THEN 'ACTIVE_VOYAGE'"
            " ELSE concat('a', (o_orderkey * 7 + 3) % 100) END AS trip_end_anchorage_id",
        )

    # -- vessels -------------------------------------------------------------------

    def vessel_info(self) -> DataFrame:
        customers = self.table("customer").selectExpr(
            "c_custkey AS k", "c_custkey AS id", "c_name AS name", "c_nationkey AS nation",
            "c_custkey % 4 <> 1 AS on_fishing_list_best",
        )
        suppliers = self.table("supplier").selectExpr(
            "s_suppkey AS k", "1000000 + s_suppkey AS id", "s_name AS name", "s_nationkey AS nation",
            "s_suppkey % 3 <> 0 AS on_fishing_list_best",
        )
        return customers.unionByName(suppliers).selectExpr(
            "cast(id AS string) AS ssvid",
            "named_struct("
            " 'shipname_mostcommon', named_struct('value', CASE k % 29 WHEN 0 THEN 'BOUY 7' WHEN 1 THEN 'X 55%'"
            "   WHEN 2 THEN '3.7V' WHEN 3 THEN 'ABC@12V3' WHEN 4 THEN 'NET MARK' WHEN 5 THEN '123-456' ELSE name END),"
            " 'n_shipname_mostcommon', named_struct('value', concat('S', id)),"
            " 'n_imo_mostcommon', named_struct('value', concat('I', id)),"
            " 'n_callsign_mostcommon', named_struct('value', concat('C', id)),"
            f" 'flag_mmsi', element_at(array({FLAGS}), cast((nation + 3) % 7 + 1 AS int))) AS ais_identity",
            f"named_struct('best_flag', element_at(array({FLAGS}), cast(nation % 7 + 1 AS int)),"
            f" 'best_vessel_class', element_at(array({RAW_GEAR}), cast(k % 12 + 1 AS int))) AS best",
            "named_struct('first_timestamp', timestampadd(DAY, k % 400, timestamp'1994-01-01 00:00:00'),"
            " 'last_timestamp', timestampadd(DAY, -(k % 300), timestamp'2001-12-31 00:00:00'),"
            " 'frac_spoofing', (k % 40) / 400D) AS activity",
            "on_fishing_list_best",
        )

    def by_year(self) -> DataFrame:
        customers = self.dealt("customer", "c_custkey")
        years = customers.withColumn("year", F.expr(f"explode(array({YEARS}))"))
        return years.where("NOT (c_custkey % 10 = 3 AND year = 1996)").selectExpr(
            "cast(c_custkey AS string) AS ssvid",
            "year",
            f"named_struct('best_flag', element_at(array({FLAGS}), cast(c_nationkey % 7 + 1 AS int)),"
            f" 'best_vessel_class', element_at(array({RAW_GEAR}), cast(c_custkey % 12 + 1 AS int))) AS best",
            "named_struct('inferred_vessel_class_byyear', CASE WHEN c_custkey % 17 <> 0 THEN 'x' END,"
            " 'inferred_vessel_class_ag', CASE WHEN c_custkey % 2 = 0 THEN 'pole_and_line'"
            f" ELSE element_at(array({RAW_GEAR}), cast(c_custkey % 12 + 1 AS int)) END) AS inferred",
            "named_struct('overlap_hours', cast(c_custkey % 90 AS double),"
            " 'overlap_hours_multinames', CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 < 8 THEN 0D ELSE 1D END,"
            " 'offsetting', c_custkey % 13 = 0, 'fishing_hours', cast((c_custkey + year) % 90 AS double),"
            " 'active_hours', cast(c_custkey % 300 AS double)) AS activity",
            "named_struct('n_shipname', transform(filter(sequence(0, 9), i -> i < c_custkey % 10), i ->"
            " named_struct('value', CASE WHEN i <> 6 THEN concat('NAME', i % 6) END,"
            " 'count', (c_custkey + i) % 15 + 6)),"
            f" 'flag_mmsi', element_at(array({FLAGS}), cast((c_nationkey + 3) % 7 + 1 AS int))) AS ais_identity",
            "named_struct('best_known_vessel_class', CASE WHEN c_custkey % 5 = 0 THEN cast(array() AS array<string>)"
            " WHEN c_custkey % 3 = 0 THEN array('trawlers', 'squid_jigger')"
            " ELSE array('trawlers', 'set_longlines') END) AS registry_info",
            "c_custkey % 4 <> 1 AS on_fishing_list_best",
        )

    def bad_vessels(self) -> DataFrame:
        return self.table("customer").where("c_custkey % 97 = 5").selectExpr(
            "array(c_custkey, c_custkey + 2, cast(null AS bigint)) AS ssvid"
        )

    def offset_segments(self) -> DataFrame:
        return self.table("customer").withColumn("i", F.expr("explode(sequence(0, 2))")).selectExpr(
            "concat(c_custkey, '-', i) AS seg_id",
            "cast(c_custkey AS string) AS ssvid",
            "c_custkey % 50 + i AS positions",
            "cast((c_custkey % 20) * 200 AS double) AS dist_avg_pos_sat_vessel_km",
            "(c_custkey + i) % 9 AS sat_positions_known",
        )

    def country_codes(self) -> DataFrame:
        return self.table("nation").selectExpr(
            "element_at(array('CHN','PAN','LBR','ESP','XXX'), cast(n_nationkey % 5 + 1 AS int)) AS iso3",
            "concat('COUNTRY_', n_nationkey % 5) AS country_name",
        )

    # -- encounters and loitering ----------------------------------------------------

    def encounters(self) -> DataFrame:
        own = self.table("orders").selectExpr("o_orderkey AS k", "o_custkey AS member", "o_orderdate")
        # Dealt by order, which serves the removal of copies and the join.
        met = (
            self.table("lineitem")
            .selectExpr("l_orderkey AS k", "1000000 + l_suppkey AS member")
            .repartition("k")
            .distinct()
            .join(own.select("k", "o_orderdate"), "k")
        )
        return own.unionByName(met.select("k", "member", "o_orderdate")).selectExpr(
            "concat(k, '.', member) AS event_id",
            "cast(member AS string) AS vessel_id",
            "timestampadd(HOUR, 26, o_orderdate) AS event_start",
            "timestampadd(HOUR, 27 + k % 20, o_orderdate) AS event_end",
            "(k * 37) % 170 - 85 + (k % 5) * 0.04D AS lat_mean",
            "cast((k * 91) % 360 - 180 AS double) AS lon_mean",
            "concat('{\"median_distance_km\": ', k % 9, ', \"median_speed_knots\": ', k % 4, '}') AS event_info",
        )

    def encounter_daily(self) -> DataFrame:
        return self.encounters().where("cast(vessel_id AS bigint) % 29 <> 4").selectExpr(
            "vessel_id", "vessel_id AS ssvid", "to_date(event_start) AS day"
        )

    def carriers(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "named_struct('ssvid', cast(c_custkey AS string), 'imo', concat('I', c_custkey),"
            " 'n_shipname', c_name, 'n_callsign', concat('C', c_custkey)) AS identity",
            "CASE WHEN c_custkey % 11 = 3 THEN cast(array() AS array<struct<source:string>>)"
            " ELSE array(named_struct('source', 'a'), named_struct('source', 'b')) END AS registry",
            "array(named_struct('first_timestamp', timestampadd(DAY, c_custkey % 400, timestamp'1994-01-01 00:00:00'),"
            " 'last_timestamp', timestampadd(DAY, c_custkey % 500, timestamp'1999-06-01 00:00:00')),"
            " named_struct('first_timestamp', timestampadd(DAY, c_custkey % 300, timestamp'2000-01-01 00:00:00'),"
            " 'last_timestamp', timestamp'2001-12-31 00:00:00')) AS activity",
            "c_custkey % 7 <> 0 AS is_carrier",
            "CASE WHEN c_custkey % 5 = 4 THEN 2 ELSE 3 END AS confidence",
        )

    def loitering(self) -> DataFrame:
        vessels = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        return self.table("lineitem").join(vessels, "l_orderkey").selectExpr(
            "cast(o_custkey AS string) AS ssvid",
            "l_shipdate AS loitering_start_timestamp",
            "timestampadd(HOUR, cast(l_quantity AS bigint), l_shipdate) AS loitering_end_timestamp",
            "cast((l_partkey * 7) % 360 - 180 AS double) AS start_lon",
            "cast((l_suppkey * 3) % 160 - 80 AS double) AS start_lat",
            "cast((l_partkey * 7) % 360 - 179 AS double) AS end_lon",
            "cast((l_suppkey * 3) % 160 - 79 AS double) AS end_lat",
            "l_quantity AS loitering_hours",
            "l_discount * 400 AS avg_distance_from_shore_nm",
            "l_tax * 40 AS avg_speed_knots",
        )

    # -- port events ---------------------------------------------------------------------

    def port_visits(self) -> DataFrame:
        """Visits with nested events. A visit spans several rows of at most 64 events."""
        kind = (
            "CASE event_type WHEN 'view' THEN 'PORT_ENTRY' WHEN 'click' THEN 'PORT_STOP_BEGIN'"
            " WHEN 'purchase' THEN 'PORT_STOP_END' WHEN 'error' THEN 'PORT_GAP' ELSE 'PORT_EXIT' END"
        )
        return (
            self.table("events")
            .selectExpr(
                "cast(user_id AS string) AS vessel_id",
                "date_trunc('WEEK', ts) AS start_timestamp",
                "timestampadd(DAY, 7, date_trunc('WEEK', ts)) AS end_timestamp",
                "event_id DIV 64 AS part",
                "named_struct('timestamp', ts, 'anchorage_id', concat('a', event_id % 3),"
                f" 'event_type', {kind}) AS event",
            )
            .groupBy("vessel_id", "start_timestamp", "end_timestamp", "part")
            .agg(F.collect_list("event").alias("events"))
            .withColumn("dt", F.date_format("start_timestamp", "yyyyMMdd"))
            .drop("part")
        )

    def vessel_daily(self) -> DataFrame:
        return self.table("events").selectExpr(
            "cast(user_id AS string) AS vessel_id",
            "cast(120 + user_id % 120 AS string) AS ssvid",
            "to_date(ts) AS day",
        )

    def stored_voyages(self) -> DataFrame:
        """Voyages some of whose bounds coincide with port visits."""
        visits = self.table("events").selectExpr("user_id", "date_trunc('WEEK', ts) AS w").distinct()
        return visits.selectExpr(
            "cast(120 + user_id % 120 AS string) AS ssvid",
            "timestampadd(HOUR, 168 + CASE WHEN user_id % 5 = 0 THEN 0 ELSE 1 END, w) AS trip_start",
            "timestampadd(HOUR, CASE WHEN user_id % 2 = 0 THEN 0 ELSE -1 END, w) AS trip_end",
        )

    # -- port visits of the policy study ---------------------------------------------------

    def study_visits(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "cast(o_custkey AS string) AS vessel_id",
            "timestampadd(HOUR, o_orderkey % 24, o_orderdate) AS start_timestamp",
            "timestampadd(HOUR, o_orderkey % 24 + 1 + o_orderkey % 40, o_orderdate) AS end_timestamp",
            "concat('a', o_orderkey % 100) AS start_anchorage_id",
            "o_orderkey AS k",
        )

    def study_daily(self) -> DataFrame:
        return self.study_visits().where("k % 13 <> 0").selectExpr(
            "vessel_id", "vessel_id AS ssvid", "to_date(start_timestamp) AS day"
        )

    def study_voyages(self) -> DataFrame:
        return self.study_visits().selectExpr(
            "vessel_id AS ssvid",
            "timestampadd(MINUTE, CASE WHEN k % 7 = 0 THEN 0 ELSE 1 END, end_timestamp) AS trip_start",
            "timestampadd(MINUTE, CASE WHEN k % 3 <> 0 THEN 0 ELSE -1 END, start_timestamp) AS trip_end",
        )

    def study_encountered(self) -> DataFrame:
        return self.study_visits().where("k % 4 = 0").selectExpr(
            "vessel_id AS ssvid", "start_timestamp AS trip_end", "k % 8 = 0 AS is_encountered"
        )

    def panel_visits(self) -> DataFrame:
        """Port visits with port state, flag state and class; years 1996 and 1998 matter."""
        flags = self.table("customer").selectExpr("c_custkey AS o_custkey", "c_nationkey")
        return self.table("orders").join(flags, "o_custkey").selectExpr(
            "year(o_orderdate) AS year",
            "cast(o_custkey AS string) AS ssvid",
            "o_orderdate AS start_timestamp",
            "concat('N', lpad(cast((o_orderkey * o_orderkey) % 25 AS string), 2, '0')) AS port_iso3",
            "concat('N', lpad(cast(c_nationkey AS string), 2, '0')) AS flag",
            "element_at(array('trawlers','purse_seine','cargo','tanker'), cast(o_custkey % 4 + 1 AS int)) AS vessel_class",
            "element_at(array('group1','group2','other'), cast(c_nationkey % 3 + 1 AS int)) AS flag_group",
        )

    def zones(self) -> DataFrame:
        name = "concat('N', lpad(cast({} AS string), 2, '0'))"
        return self.table("nation").withColumn("i", F.expr("explode(sequence(0, 1))")).selectExpr(
            "CASE WHEN n_nationkey % 4 = 3 THEN 'Overlapping claim' ELSE '200NM' END AS eez_type",
            name.format("n_nationkey") + " AS territory1_iso3",
            name.format("CASE WHEN n_nationkey % 6 = 0 THEN (n_nationkey + 5 + i) % 25 ELSE n_nationkey END")
            + " AS sovereign1_iso3",
            "n_nationkey * 2 + i AS position",
        )

    def policy_dates(self) -> DataFrame:
        """Countries with an entry date as text; blank and aggregate rows included."""
        return self.table("nation").selectExpr(
            "CASE WHEN n_nationkey % 8 = 7 THEN NULL WHEN n_nationkey = 4 THEN 'European Union' ELSE n_name END AS country",
            "CASE WHEN n_nationkey % 8 = 7 THEN NULL ELSE concat('N', lpad(cast(n_nationkey AS string), 2, '0')) END AS iso3",
            "CASE WHEN n_nationkey % 8 = 7 OR n_nationkey % 5 = 3 THEN NULL"
            " ELSE concat(cast(2015 + n_nationkey % 3 AS string), '-0', cast(1 + n_nationkey % 9 AS string), '-15') END AS entry_date",
        )

    # -- effort ---------------------------------------------------------------------------

    def positions(self) -> DataFrame:
        return self.table("events").selectExpr(
            "cast(user_id AS string) AS ssvid",
            "cast(user_id * 10 + event_id % 10 AS string) AS seg_id",
            "ts AS timestamp",
            "(user_id * 13) % 150 - 75 + (event_id % 20) * 0.25D AS lat",
            "(user_id * 29) % 350 - 175 + (event_id % 16) * 0.25D AS lon",
            "value / 10 AS hours",
            "(event_id % 100) / 100D AS nnet_score2",
        )

    def segments(self) -> DataFrame:
        return self.table("events").selectExpr("user_id * 10 + event_id % 10 AS k").distinct().selectExpr(
            "cast(k AS string) AS seg_id", "k % 25 AS positions",
            "k % 7 <> 0 AS good_seg", "k % 11 = 0 AS overlapping_and_short",
        )

    def trip_risk(self) -> DataFrame:
        users = self.table("events").select("user_id").distinct()
        return users.withColumn("k", F.expr("explode(sequence(0, 9))")).selectExpr(
            "concat(user_id, '-', k) AS trip_id",
            "cast(user_id AS string) AS ssvid",
            "timestampadd(HOUR, 72 * k + user_id % 24, timestamp'2024-01-01 00:00:00') AS trip_start",
            "timestampadd(HOUR, 72 * k + user_id % 24 + 48, timestamp'2024-01-01 00:00:00') AS trip_end",
            "cast((user_id + k) % 3 AS int) AS risk_class",
        )

    # -- durations and factors ----------------------------------------------------------------

    def durations(self) -> DataFrame:
        suppliers = self.table("supplier").selectExpr("s_suppkey AS l_suppkey", "s_nationkey")
        parts = self.table("part").selectExpr("p_partkey AS l_partkey", "p_type")
        return (
            self.table("lineitem").join(suppliers, "l_suppkey").join(parts, "l_partkey").selectExpr(
                "concat(l_returnflag, l_linestatus) AS flag_group",
                "cast(s_nationkey AS string) AS port_iso3",
                "p_type AS vessel_class",
                # Port states and classes differ, so that there are levels to find.
                "(30 + floor(l_extendedprice) % 3000) * (8 + s_nationkey % 9 + length(p_type) % 4) DIV 8 AS duration_min",
            )
        )

    def factors(self) -> DataFrame:
        """Scored trips with three categorical factors."""
        return self.table("orders").join(
            self.table("customer").selectExpr("c_custkey AS o_custkey", "c_mktsegment"), "o_custkey"
        ).selectExpr(
            "concat('t', o_orderkey) AS trip_id", "o_orderkey AS k",
            "o_orderpriority AS flag", "c_mktsegment AS gear", "o_orderstatus AS tas",
            "o_totalprice / 100000 - 2 AS risk_score",
        )

    def trips(self) -> DataFrame:
        """Fishing trip features: classes and arrival votes, some of them missing."""
        flags = "'china','group1','group2','group3','other',''"
        gear = (
            "'trawlers','trollers','driftnets','purse_seine','set_gillnet','squid_jigger','pole_and_line',"
            "'set_longline','pots_and_traps','drifting_longline',cast(null as string)"
        )
        time = "'less_than_1m','1_3m','3_6m','6_12m','12m_and_more'"

        def vote(n: int) -> str:
            # Every third order went to a port without votes; some votes are missing.
            return (
                f"CASE WHEN o_orderkey % 3 = 0 THEN 0L WHEN o_orderkey % 19 = {n} THEN NULL"
                f" ELSE (o_orderkey DIV {n + 2}) % {n + 3} END"
            )

        return self.table("orders").selectExpr(
            "concat('t', o_orderkey) AS trip_id",
            "cast(o_custkey AS string) AS ssvid",
            "o_orderdate AS trip_start",
            "timestampadd(DAY, o_orderkey % 45, o_orderdate) AS trip_end",
            f"element_at(array({flags}), cast(o_custkey % 6 + 1 AS int)) AS flag_group",
            f"element_at(array({gear}), cast(o_orderkey % 11 + 1 AS int)) AS vessel_class",
            f"element_at(array({time}), cast((o_orderkey + o_custkey) % 5 + 1 AS int)) AS time_at_sea",
            *[f"{vote(i)} AS iuu_{v}_to" for i, v in enumerate(("no", "low", "med", "high"))],
        )

    def carrier_rows(self) -> DataFrame:
        """Carrier-trip features: one row per met vessel of a trip (an order)."""
        own = self.table("orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey", "o_orderdate")
        flags = "'china','group1','group2','group3','other'"
        gear = "'trawlers','purse_seine','squid_jigger','pole_and_line','set_longline',cast(null as string)"
        time = "'less_than_1m','1_3m','3_6m','6_12m','12m_and_more'"
        votes = [
            f"CASE WHEN l_orderkey % 4 = 0 THEN 0L WHEN l_orderkey % 23 = {i} THEN NULL"
            f" ELSE (l_orderkey DIV {i + 2}) % {i + 3} END AS to_{r}_{v}"
            for r in ("iuu", "la")
            for i, v in enumerate(("no", "low", "med", "high"))
        ]
        return self.table("lineitem").join(own, "l_orderkey").selectExpr(
            "concat('t', l_orderkey) AS trip_id",
            "timestampadd(HOUR, l_linenumber, o_orderdate) AS event_start",
            "timestampadd(HOUR, l_linenumber + 2, o_orderdate) AS event_end",
            "cast(l_suppkey AS string) AS neighbor_ssvid",
            "cast(o_custkey AS string) AS carrier_ssvid",
            "cast((l_partkey * 7) % 360 - 180 AS double) AS lon_mean",
            "cast((l_suppkey * 3) % 160 - 80 AS double) AS lat_mean",
            f"element_at(array({time}), cast(l_orderkey % 5 + 1 AS int)) AS time_at_sea",
            f"element_at(array({flags}), cast(o_custkey % 5 + 1 AS int)) AS carrier_flag_group",
            f"element_at(array({flags}), cast((l_suppkey DIV 3) % 5 + 1 AS int)) AS neighbor_flag_group",
            f"element_at(array({gear}), cast(l_partkey % 6 + 1 AS int)) AS neighbor_vessel_class",
            *votes,
        )

    def carrier_loitering(self) -> DataFrame:
        """The rows of every third trip name no vessel and do not count as loitering."""
        return self.table("lineitem").selectExpr(
            "concat('t', l_orderkey) AS trip_id",
            "CASE WHEN l_orderkey % 3 <> 0 THEN cast(l_suppkey AS string) END AS ssvid",
            "cast((l_partkey * 5) % 360 - 180 AS double) AS lon_mean",
            "cast((l_suppkey * 7) % 160 - 80 AS double) AS lat_mean",
        )
