"""Encounters, loitering, port stops and port visits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.skew import slice_groups
from tidemark.params import PortStopParams
from tidemark.plans import encounters, ports, vessels
from tidemark.plans.voyages import voyages_from_legs
from workload.inputs import ENCOUNTERS, VOYAGES, Inputs
from workload.inputs_sql import flag_group, gear_class, time_at_sea
from workload.registry import formed, query
from workload.voyage_queries import attributes, good, light_years, votes_sql, voyage_core

EVENT = (
    "event_id event event_start:t event_end:t lat_mean:d lon_mean:d median_distance_km median_speed_knots"
)
NAMES = " ".join(
    f"{role}_{c}" for role in ("carrier", "neighbor") for c in ("shipname", "imo", "callsign", "flag", "label")
)
# Short pauses are rare in this data at 30 minutes, so the chain also runs at 12 hours.
LONG_PAUSE = PortStopParams(short_gap_min=720)


@query(
    "k25_encounter_load", EVENT + " vessel_id year:i event_date:D",
    """(SELECT *, year(event_start) AS year, event_start::DATE AS event_date FROM encounter_rows
        WHERE event_end <= TIMESTAMP '2001-12-31' AND lat_mean < 90 AND lat_mean > -90 AND lon_mean < 180 AND lon_mean > -180)""",
    "encounter_rows",
)
def encounter_load(q: Inputs):
    return encounters.load_encounters(q.encounters(), ENCOUNTERS)


@query("k26_identity_by_day", EVENT + " event_date:D ssvid", "members", "members")
def members(q: Inputs):
    return vessels.resolve_identity(encounter_load(q), q.encounter_daily(), "event_date")


@query(
    "k27_curated_carriers",
    "carrier_ssvid carrier_imo_ais carrier_shipname_ais carrier_callsign_ais carrier_first_timestamp:t carrier_last_timestamp:t",
    "carriers", "carriers",
)
def carriers(q: Inputs):
    return encounters.curated_carriers(q.carriers(), ENCOUNTERS)


@query(
    "k28_carrier_encounters", EVENT + " ssvid carrier_ssvid carrier_first_timestamp:t carrier_last_timestamp:t",
    "carrier_members", "carrier_members",
)
def carrier_members(q: Inputs):
    return encounters.carrier_members(members(q), carriers(q))


@query("k29_encounter_pairs", EVENT + " carrier_ssvid neighbor_ssvid event_duration_hr:d", "pairs", "pairs")
def pairs(q: Inputs):
    return encounters.member_pairs(encounter_load(q), q.encounter_daily(), carriers(q))


@query(
    "k30_pair_attributes", EVENT + " carrier_ssvid neighbor_ssvid event_duration_hr:d " + NAMES,
    "attributed", "attributed",
)
def attributed(q: Inputs):
    return encounters.attributed_pairs(
        encounter_load(q), q.encounter_daily(), carriers(q), q.vessel_info(), ENCOUNTERS
    )


@query("k31_encounters_away_from_port", EVENT + " carrier_ssvid neighbor_ssvid", "at_sea", "at_sea")
def away_from_port(q: Inputs):
    return encounters.attributed_pairs(
        encounter_load(q), q.encounter_daily(), carriers(q), q.vessel_info(), ENCOUNTERS, q.anchorages()
    )


@query(
    "k32_encounters_in_trips", "trip_id trip_start:t trip_end:t " + EVENT + " carrier_ssvid neighbor_ssvid",
    "carrier_trips", "carrier_trips",
)
def in_trips(q: Inputs):
    pairs_at_sea = encounters.encounter_pairs(
        q.encounters(), q.encounter_daily(), q.carriers(), q.vessel_info(), q.anchorages(), ENCOUNTERS
    )
    return encounters.encounters_in_trips(voyage_core(q), pairs_at_sea)


@query(
    "k33_plausible_neighbors", "trip_id event_id carrier_ssvid neighbor_ssvid neighbor_first_seen:t",
    "(SELECT * FROM carrier_trips WHERE trip_start >= neighbor_first_seen AND neighbor_is_fishing)", "carrier_trips",
)
def plausible(q: Inputs):
    return encounters.plausible_neighbors(in_trips(q))


_VOTES = " ".join(f"{role}_{v}:i" for role in ("from", "to") for v in encounters.VOTES)


_FEATURES = (
    "trip_id event_start:t event_end:t trip_start:t trip_end:t from_country to_country from_port to_port"
    " trip_start_port_id trip_end_port_id lon_mean:d lat_mean:d carrier_ssvid neighbor_ssvid carrier_flag neighbor_flag"
    " carrier_flag_group neighbor_flag_group time_at_sea neighbor_vessel_class " + _VOTES
)


@query(
    "k34_carrier_trip_features",
    _FEATURES,
    f"""(SELECT DISTINCT c.trip_id, event_start, event_end, trip_start, trip_end, trip_duration_hr, {votes_sql('prefix')},
          from_risk.country AS from_country, to_risk.country AS to_country, from_risk.port AS from_port, to_risk.port AS to_port,
          f.port_id AS trip_start_port_id, g.port_id AS trip_end_port_id, lon_mean, lat_mean, carrier_ssvid, neighbor_ssvid,
          carrier_flag, neighbor_flag, carrier_label, neighbor_label,
          {flag_group('carrier_flag')} AS carrier_flag_group, {flag_group('neighbor_flag')} AS neighbor_flag_group,
          {time_at_sea('trip_duration_hr')} AS time_at_sea, {gear_class('neighbor_label')} AS neighbor_vessel_class
        FROM carrier_trips c LEFT JOIN matched_all f ON c.start_anchorage_label = f.label
        LEFT JOIN matched_all g ON c.end_anchorage_label = g.label
        LEFT JOIN port_risk to_risk ON g.port_id = to_risk.port_id LEFT JOIN port_risk from_risk ON f.port_id = from_risk.port_id
        WHERE trip_start >= neighbor_first_seen AND neighbor_is_fishing)""",
    "carrier_trips", "matched_all", "port_risk",
)
def carrier_features(q: Inputs):
    return encounters.carrier_trip_features(
        q.legs(), q.anchorages(), q.port_risk(), q.encounters(), q.encounter_daily(), q.carriers(),
        q.vessel_info(), q.country_codes(), VOYAGES, ENCOUNTERS, shape=lambda rows: formed(rows, _FEATURES),
    )


LOITERING = (
    "ssvid loitering_start_timestamp:t loitering_end_timestamp:t lon_mean:d lat_mean:d loitering_hours:d"
    " avg_distance_from_shore_nm:d avg_speed_knots:d"
)


@query("k35_loitering_events", LOITERING, "loitering", "loitering")
def loitering(q: Inputs):
    return encounters.loitering_events(q.loitering())


@query(
    "k36_loitering_in_trips", LOITERING + " carrier_ssvid trip_start:t trip_end:t trip_id",
    """(SELECT DISTINCT l.*, t.ssvid AS carrier_ssvid, trip_start, trip_end, trip_id FROM loitering l
        JOIN final_trips t ON l.ssvid = t.ssvid AND loitering_start_timestamp BETWEEN trip_start AND trip_end
          AND loitering_end_timestamp BETWEEN trip_start AND trip_end)""",
    "loitering", "final_trips",
)
def loitering_in_trips(q: Inputs):
    trips = voyages_from_legs(q.legs(), q.anchorages(), VOYAGES).withColumn("carrier_ssvid", F.col("ssvid"))
    return encounters.loitering_in_trips(loitering(q), trips)


# -- port stops ----------------------------------------------------------------------------------

VISIT = "vessel_id start_timestamp:t end_timestamp:t"


@query(
    "k37_port_events", VISIT + " date:D year:i timestamp:t anchorage_id event_type", "port_events", "port_events"
)
def port_events(q: Inputs):
    return ports.explode_events(q.port_visits())


@query("k38_plausible_stops", VISIT + " timestamp:t anchorage_id event_type", "plausible", "plausible")
def plausible_stops(q: Inputs):
    return ports.drop_implausible(slice_groups(port_events(q), ports.VISIT, ports.ORDER, counted=q.port_visits(), weight=F.size("events")))


@query("k39_close_stops_joined", VISIT + " timestamp:t anchorage_id event_type", "joined_30", "joined_30")
def joined_stops(q: Inputs):
    return ports.join_close_stops(plausible_stops(q))


@query("k39_close_stops_joined_12h", VISIT + " timestamp:t anchorage_id event_type", "joined_720", "joined_720")
def joined_stops_12h(q: Inputs):
    return ports.join_close_stops(plausible_stops(q), LONG_PAUSE)


STOP = VISIT + " anchorage_id stop_begin_time:t stop_end_time:t duration_min:i"


@query("k40_stop_durations", STOP + " year:i date:D", "durations_30", "durations_30")
def stop_durations(q: Inputs):
    return ports.port_stops(q.port_visits())


@query(
    "k41_dock_stops", STOP + " port_iso3 port at_dock",
    """(SELECT DISTINCT d.*, a.iso3 AS port_iso3, a.label AS port, at_dock FROM durations_720 d
        JOIN anchorages a ON d.anchorage_id = a.s2id WHERE at_dock AND duration_min IS NOT NULL)""",
    "durations_720", "anchorages",
)
def dock_stops(q: Inputs):
    return ports.dock_stops(ports.port_stops(q.port_visits(), LONG_PAUSE), q.anchorages())


TOUCHES = """((ssvid, start_timestamp) IN (SELECT (ssvid, trip_end) FROM stored_voyages)
          OR (ssvid, end_timestamp) IN (SELECT (ssvid, trip_start) FROM stored_voyages))"""


@query(
    "k42_visits_touching_voyages", STOP + " ssvid",
    f"""(SELECT d.*, v.ssvid FROM durations_720 d JOIN vessel_daily v ON d.vessel_id = v.vessel_id AND d.date = v.day
        WHERE {TOUCHES})""",
    "durations_720", "vessel_daily", "stored_voyages",
)
def touching(q: Inputs):
    stops = vessels.resolve_identity(ports.port_stops(q.port_visits(), LONG_PAUSE), q.vessel_daily(), "date")
    return ports.touching_voyages(stops, q.stored_voyages())


@query(
    "k43_port_stop_table", STOP + " ssvid flag vessel_class port_iso3 port",
    f"""(SELECT * EXCLUDE (vessel_class), {gear_class('vessel_class')} AS vessel_class FROM dock_stops
        WHERE flag IS NOT NULL AND {gear_class('vessel_class')} IS NOT NULL AND {TOUCHES})""",
    "dock_stops", "stored_voyages",
)
def port_stop_table(q: Inputs):
    return ports.port_stop_table(
        q.port_visits(), q.vessel_daily(), good(q), attributes(q), q.anchorages(), q.stored_voyages(), LONG_PAUSE
    )


@query(
    "k44_port_visit_table",
    "year:i ssvid start_timestamp:t end_timestamp:t start_anchorage_id port_name port_iso3 flag flag_group is_fishing"
    " is_encountered vessel_class",
    "study_table", "study_table",
)
def port_visit_table(q: Inputs):
    return ports.port_visit_table(
        q.study_visits(), q.anchorages(), q.study_daily(), q.study_voyages(), attributes(q),
        q.study_encountered(), light_years(q), q.by_year(), (1996, 1998),
    )
