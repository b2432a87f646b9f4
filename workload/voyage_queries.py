"""Voyages, vessels and fishing trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import classes
from tidemark.operators.skew import slice_groups
from tidemark.plans import vessels, voyages
from workload.inputs import VOYAGES, Inputs
from workload.inputs_sql import distance_m, flag_group, gear_class, time_at_sea
from workload.registry import query

ENDS = "ssvid trip_start:t trip_end:t trip_start_anchorage_id trip_end_anchorage_id"
SIDES = (
    "start_anchorage_lat:d start_anchorage_lon:d start_anchorage_label start_anchorage_iso3 "
    "end_anchorage_lat:d end_anchorage_lon:d end_anchorage_label end_anchorage_iso3 trip_duration_hr:d"
)
VOTES = " ".join(f"{v}_{role}:i" for role in ("to", "from") for v in voyages.VOTES)


@query("k01_clean_legs", ENDS, "clean_legs", "clean_legs")
def clean_legs(q: Inputs):
    return voyages.clean_legs(q.legs(), VOYAGES)


@query(
    "k02_enriched_legs", ENDS + " start_anchorage_iso3 end_anchorage_iso3 trip_duration_hr:d",
    "enriched_legs", "enriched_legs",
)
def enriched_legs(q: Inputs):
    return voyages.enrich_legs(clean_legs(q), q.anchorages())


@query("k03_canal_flags", ENDS + " ends_in_canal", "canal_legs", "canal_legs")
def canal_flags(q: Inputs):
    return voyages.flag_canal_ends(enriched_legs(q), q.anchorages(), VOYAGES)


@query("k04_canal_transits_merged", ENDS, "transits", "transits")
def transits(q: Inputs):
    flagged = voyages.flag_canal_ends(clean_legs(q), q.anchorages(), VOYAGES)
    legs = voyages.distinct_legs(flagged)
    return voyages.merge_canal_transits(slice_groups(legs, voyages.KEY, voyages.ORDER, counted=q.legs()))


@query("k05_port_stop_hours", ENDS + " port_stop_duration_hr:d", "stops", "stops")
def port_stop_hours(q: Inputs):
    return voyages.with_port_stops(transits(q))


@query("k06_short_stops_merged", ENDS + " port_stop_duration_hr:d", "voyages", "voyages")
def short_stops(q: Inputs):
    return voyages.merge_short_stops(port_stop_hours(q), VOYAGES)


@query("k07_labelled_voyages", ENDS + " port_stop_duration_hr:d " + SIDES, "labelled", "labelled")
def labelled(q: Inputs):
    return voyages.label_voyages(short_stops(q), q.anchorages())


@query("k08_voyages_from_legs", "trip_id " + ENDS + " port_stop_duration_hr:d " + SIDES, "final_trips", "final_trips")
def voyage_core(q: Inputs):
    return voyages.voyages_from_legs(q.legs(), q.anchorages(), VOYAGES)


@query(
    "k09_homonym_labels",
    "s2id port_id label relabelled port_label",
    """(SELECT *, CASE WHEN s2id IN ('54c1d7b1', '54906be3') THEN 'NEWPORT (OREGON)'
          WHEN s2id IN ('4cac27cf') THEN 'STONINGTON (MAINE)' ELSE label END AS relabelled,
        CASE port_id WHEN 'p610' THEN 'NEWPORT (OREGON)' WHEN 'p641' THEN 'STONINGTON (MAINE)' ELSE label END AS port_label
      FROM (SELECT CASE c_custkey % 5 WHEN 0 THEN '54c1d7b1' WHEN 1 THEN '54906be3' WHEN 2 THEN '4cac27cf' ELSE 'a' || c_custkey END AS s2id,
              CASE c_custkey % 4 WHEN 0 THEN 'p610' WHEN 1 THEN 'p641' ELSE 'p' || c_custkey END AS port_id,
              c_mktsegment AS label FROM customer))""",
)
def homonyms(q: Inputs):
    ports = q.table("customer").selectExpr(
        "CASE c_custkey % 5 WHEN 0 THEN '54c1d7b1' WHEN 1 THEN '54906be3' WHEN 2 THEN '4cac27cf'"
        " ELSE concat('a', c_custkey) END AS s2id",
        "CASE c_custkey % 4 WHEN 0 THEN 'p610' WHEN 1 THEN 'p641' ELSE concat('p', c_custkey) END AS port_id",
        "c_mktsegment AS label",
    )
    return ports.withColumns(
        {
            "relabelled": classes.relabel(F.col("label"), F.col("s2id"), classes.HOMONYM_ANCHORAGES),
            "port_label": classes.relabel(F.col("label"), F.col("port_id"), classes.HOMONYM_PORTS),
        }
    )


@query("k10_gear_buoys", "ssvid", "gear_buoys", "gear_buoys")
def gear_buoys(q: Inputs):
    return vessels.gear_buoys(q.vessel_info())


@query("k11_quality_vessel_years", "ssvid year:i geartype flag", "quality_years", "quality_years")
def quality_years(q: Inputs):
    return vessels.quality_vessel_years(q.by_year(), q.bad_vessels(), gear_buoys(q))


@query(
    "k12_light_vessel_years", "ssvid year:i geartype flag",
    "(SELECT *, best_class AS geartype, best_flag AS flag FROM light_years)", "light_years",
)
def light_years(q: Inputs):
    return vessels.quality_vessel_years(q.by_year(), q.bad_vessels(), rules=vessels.LIGHT_RULES)


@query("k13_offset_vessels", "ssvid positions:i", "offset_vessels", "offset_vessels")
def offset_vessels(q: Inputs):
    return vessels.offset_vessels(q.offset_segments())


@query("k14_good_vessels", "ssvid year:i geartype flag", "good", "good")
def good(q: Inputs):
    return vessels.good_vessels(quality_years(q), offset_vessels(q))


@query(
    "k15_trips_of_good_vessels", "trip_id ssvid trip_start:t start_year:i",
    """(SELECT *, year(trip_start) AS start_year FROM final_trips
        WHERE trip_start::DATE BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' AND ssvid IN (SELECT ssvid FROM good))""",
    "final_trips", "good",
)
def trips_of_good_vessels(q: Inputs):
    return voyages.restrict_to_vessels(voyage_core(q), good(q), VOYAGES)


@query(
    "k15b_trips_of_good_vessel_years", "trip_id ssvid trip_start:t year:i",
    """(SELECT *, year(trip_start) AS year FROM final_trips
        WHERE (ssvid, year(trip_start)) IN (SELECT (ssvid, year) FROM good))""",
    "final_trips", "good",
)
def trips_of_good_years(q: Inputs):
    return vessels.restrict_to_vessel_years(voyage_core(q).withColumn("year", F.year("trip_start")), good(q))


@query("k16_vessel_attributes", "ssvid year:i flag vessel_class is_fishing", "attributes", "attributes")
def attributes(q: Inputs):
    return vessels.attributes_by_year(q.by_year())


@query(
    "k16_vessel_attributes_each_class", "ssvid year:i flag vessel_class is_fishing",
    """(SELECT DISTINCT ssvid, year, CASE WHEN best_flag = 'UNK' THEN flag_mmsi ELSE best_flag END AS flag,
          CASE WHEN class_ag = 'pole_and_line' AND r = 'squid_jigger' THEN 'squid_jigger' ELSE best_class END AS vessel_class,
          on_list AS is_fishing
        FROM (SELECT *, unnest(CASE WHEN len(registered) = 0 THEN [NULL] ELSE registered END) AS r FROM by_year))""",
    "by_year",
)
def attributes_each(q: Inputs):
    return vessels.attributes_by_year(q.by_year(), squid_rows="each")


@query(
    "k17_flag_groups", "flag flag_group n:i",
    f"(SELECT flag, {flag_group('flag')} AS flag_group, count(*) AS n FROM attributes GROUP BY ALL)", "attributes",
)
def flag_groups(q: Inputs):
    return attributes(q).groupBy("flag", classes.flag_group(F.col("flag")).alias("flag_group")).agg(
        F.count("*").alias("n")
    )


@query(
    "k18_gear_classes", "vessel_class gear light n:i",
    f"""(SELECT vessel_class, {gear_class('vessel_class')} AS gear,
           CASE WHEN vessel_class LIKE '%purse_seines' THEN 'purse_seine' ELSE vessel_class END AS light, count(*) AS n
         FROM attributes GROUP BY ALL)""",
    "attributes",
)
def gear_classes(q: Inputs):
    raw = F.col("vessel_class")
    return attributes(q).groupBy(
        "vessel_class",
        classes.gear_class(raw).alias("gear"),
        classes.gear_class(raw, keep_unknown=True).alias("light"),
    ).agg(F.count("*").alias("n"))


@query(
    "k19_time_at_sea", "time_at_sea n:i",
    f"(SELECT {time_at_sea('l_extendedprice / 8')} AS time_at_sea, count(*) AS n FROM lineitem GROUP BY ALL)",
)
def times_at_sea(q: Inputs):
    hours = F.col("l_extendedprice") / 8
    return q.table("lineitem").groupBy(classes.time_at_sea(hours).alias("time_at_sea")).agg(F.count("*").alias("n"))


@query("k20_anchorage_port_match", "port_id s2id label iso3 distance_km:d", "matched_all", "matched_all")
def matched_all(q: Inputs):
    return voyages.match_ports(q.anchorages(), q.port_risk())


@query("k20_anchorage_port_match_without_duplicates", "port_id s2id label iso3 distance_km:d", "matched", "matched")
def matched(q: Inputs):
    return voyages.match_ports(q.anchorages(), q.port_risk(), exclude_ports=classes.DUPLICATE_PORTS)


_CONTESTED = f"""(WITH a AS MATERIALIZED (SELECT s2id || '-' || j AS s2id, label, iso3, lat + j * 0.003::DOUBLE AS lat, lon
            FROM anchorages, (VALUES (0), (1)) AS v(j)),
          p AS MATERIALIZED (SELECT port_id || '-' || i AS port_id, lat + d AS lat, lon
            FROM port_risk, (VALUES (0, 0.010::DOUBLE), (1, 0.004::DOUBLE), (2, -0.013::DOUBLE)) AS v(i, d)),
          near AS MATERIALIZED (SELECT s2id, label, iso3, port_id, {distance_m('a.lat', 'a.lon', 'p.lat', 'p.lon')} / 1000 AS distance_km
            FROM a, p WHERE abs(a.lat - p.lat) < 1)
        SELECT s2id, label, iso3, port_id, distance_km FROM (
          SELECT *, row_number() OVER (PARTITION BY port_id ORDER BY distance_km, s2id) AS r FROM (
            SELECT *, row_number() OVER (PARTITION BY s2id ORDER BY distance_km, port_id) AS q
            FROM near WHERE distance_km <= 3) WHERE q = 1) WHERE r = 1)"""


@query("k20_contested_port_match", "port_id s2id label iso3 distance_km:d", _CONTESTED, "anchorages", "port_risk")
def contested(q: Inputs):
    """Several ports in reach of an anchorage, and several anchorages nearest to one port."""
    sites = q.anchorages().withColumn("j", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns(
        {"s2id": F.concat_ws("-", "s2id", "j"), "lat": F.col("lat") + F.col("j") * F.lit(0.003)}
    ).drop("j")
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate((0.010, 0.004, -0.013))])
    around = q.port_risk().withColumn("s", F.explode(shifts)).withColumns(
        {"port_id": F.concat_ws("-", "port_id", "s.i"), "lat": F.col("lat") + F.col("s.d")}
    ).drop("s")
    return voyages.match_ports(sites, around)


@query(
    "k21_trip_ports", "trip_id from_port_id to_port_id",
    """(SELECT t.trip_id, f.port_id AS from_port_id, g.port_id AS to_port_id FROM final_trips t
        LEFT JOIN matched f ON t.start_anchorage_label = f.label AND t.start_anchorage_iso3 = f.iso3
        LEFT JOIN matched g ON t.end_anchorage_label = g.label AND t.end_anchorage_iso3 = g.iso3)""",
    "final_trips", "matched",
)
def trip_ports(q: Inputs):
    return voyages.attach_ports(voyage_core(q), matched(q))


@query(
    "k21_trip_ports_by_label", "trip_id from_port_id to_port_id",
    """(SELECT t.trip_id, f.port_id AS from_port_id, g.port_id AS to_port_id FROM final_trips t
        LEFT JOIN matched_all f ON t.start_anchorage_label = f.label
        LEFT JOIN matched_all g ON t.end_anchorage_label = g.label)""",
    "final_trips", "matched_all",
)
def trip_ports_by_label(q: Inputs):
    trips = voyage_core(q).select("trip_id", "start_anchorage_label", "end_anchorage_label")
    return voyages.fan_out_ports(trips, matched_all(q))


def votes_sql(style: str) -> str:
    named = {"suffix": "{v}_{role}", "prefix": "{role}_{v}"}[style]
    parts = []
    for role in ("to", "from"):
        for v in voyages.VOTES:
            raw = "not_associated" if v.endswith("_no") else v
            parts.append(f"{role}_risk.{raw} AS {named.format(v=v, role=role)}")
    return ", ".join(parts)


@query(
    "k22_port_votes", "trip_id from_port_id to_port_id " + VOTES,
    f"""(SELECT t.trip_id, f.port_id AS from_port_id, g.port_id AS to_port_id, {votes_sql('suffix')} FROM final_trips t
        LEFT JOIN matched f ON t.start_anchorage_label = f.label AND t.start_anchorage_iso3 = f.iso3
        LEFT JOIN matched g ON t.end_anchorage_label = g.label AND t.end_anchorage_iso3 = g.iso3
        LEFT JOIN port_risk to_risk ON g.port_id = to_risk.port_id LEFT JOIN port_risk from_risk ON f.port_id = from_risk.port_id)""",
    "final_trips", "matched", "port_risk",
)
def port_votes(q: Inputs):
    return voyages.attach_votes(trip_ports(q), q.port_risk())


@query(
    "k23_flag_state_names", "ssvid year:i flag country_name",
    "(SELECT a.*, country_name FROM attributes a LEFT JOIN country_codes c ON a.flag = c.iso3)",
    "attributes", "country_codes",
)
def flag_names(q: Inputs):
    return voyages.add_country_name(attributes(q), q.country_codes(), "flag", "country_name")


@query(
    "k24_fishing_trip_features",
    "trip_id trip_start_anchorage_id start_anchorage_label trip_end_anchorage_id end_anchorage_label ssvid trip_start:t"
    " trip_end:t from_port_id to_port_id flag_group flag time_at_sea vessel_class " + VOTES,
    f"""(SELECT t.*, f.port_id AS from_port_id, g.port_id AS to_port_id, {flag_group('flag')} AS flag_group,
          {time_at_sea('trip_duration_hr')} AS time_at_sea, {votes_sql('suffix')}
        FROM (SELECT * EXCLUDE (vessel_class), {gear_class('vessel_class')} AS vessel_class FROM vessel_trips) t
        LEFT JOIN matched f ON t.start_anchorage_label = f.label AND t.start_anchorage_iso3 = f.iso3
        LEFT JOIN matched g ON t.end_anchorage_label = g.label AND t.end_anchorage_iso3 = g.iso3
        LEFT JOIN port_risk to_risk ON g.port_id = to_risk.port_id LEFT JOIN port_risk from_risk ON f.port_id = from_risk.port_id)""",
    "vessel_trips", "matched", "port_risk",
)
def fishing_features(q: Inputs):
    return voyages.fishing_trip_features(
        q.legs(), q.anchorages(), q.port_risk(), good(q), attributes(q), VOYAGES
    )
