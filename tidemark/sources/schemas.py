"""Declared schemas of the input tables (DDL strings), so nothing is inferred."""

LEGS = (
    "ssvid string, vessel_ids array<string>, trip_start timestamp, trip_end timestamp, "
    "trip_start_anchorage_id string, trip_end_anchorage_id string"
)
ANCHORAGES = (
    "s2id string, label string, sublabel string, iso3 string, lat double, lon double, at_dock boolean"
)
PORT_RISK = (
    "port_id string, port string, country string, lat double, lon double, not_associated bigint, "
    "iuu_low bigint, iuu_med bigint, iuu_high bigint, la_low bigint, la_med bigint, la_high bigint"
)
VESSEL_INFO = (
    "ssvid string, ais_identity struct<shipname_mostcommon: struct<value: string>, "
    "n_shipname_mostcommon: struct<value: string>, n_imo_mostcommon: struct<value: string>, "
    "n_callsign_mostcommon: struct<value: string>, flag_mmsi: string>, "
    "best struct<best_flag: string, best_vessel_class: string>, "
    "activity struct<first_timestamp: timestamp, last_timestamp: timestamp, frac_spoofing: double>, "
    "on_fishing_list_best boolean"
)
VESSEL_INFO_BY_YEAR = (
    "ssvid string, year int, best struct<best_flag: string, best_vessel_class: string>, "
    "inferred struct<inferred_vessel_class_byyear: string, inferred_vessel_class_ag: string>, "
    "activity struct<overlap_hours: double, overlap_hours_multinames: double, offsetting: boolean, "
    "fishing_hours: double, active_hours: double>, "
    "ais_identity struct<n_shipname: array<struct<value: string, count: bigint>>, flag_mmsi: string>, "
    "registry_info struct<best_known_vessel_class: array<string>>, on_fishing_list_best boolean"
)
SEGMENTS = (
    "seg_id string, ssvid string, positions bigint, dist_avg_pos_sat_vessel_km double, "
    "sat_positions_known bigint, good_seg boolean, overlapping_and_short boolean"
)
POSITIONS = (
    "ssvid string, seg_id string, timestamp timestamp, lat double, lon double, hours double, "
    "nnet_score2 double"
)
PORT_VISITS = (
    "vessel_id string, start_timestamp timestamp, end_timestamp timestamp, start_lat double, "
    "start_lon double, end_lat double, end_lon double, start_anchorage_id string, "
    "end_anchorage_id string, "
    "events array<struct<timestamp: timestamp, anchorage_id: string, event_type: string>>, dt string"
)
VESSEL_DAILY = "vessel_id string, ssvid string, day date, dt string"
ENCOUNTERS = (
    "event_id string, vessel_id string, event_start timestamp, event_end timestamp, "
    "lat_mean double, lon_mean double, event_info string"
)
CARRIERS = (
    "identity struct<ssvid: string, imo: string, n_shipname: string, n_callsign: string>, "
    "registry array<struct<source: string>>, "
    "activity array<struct<first_timestamp: timestamp, last_timestamp: timestamp>>, "
    "is_carrier boolean, confidence int"
)
LOITERING = (
    "ssvid string, loitering_start_timestamp timestamp, loitering_end_timestamp timestamp, "
    "start_lon double, start_lat double, end_lon double, end_lat double, loitering_hours double, "
    "avg_distance_from_shore_nm double, avg_speed_knots double"
)
COUNTRY_CODES = "iso3 string, country_name string"
ZONES = "eez_type string, territory1_iso3 string, sovereign1_iso3 string"
POLICY_DATES = (
    "country string, iso3 string, apec_member string, entry_date string, simple_signature_date string, "
    "ratification_date string, acceptance_date string, approval_date string, accession_date string, "
    "rest string"
)
CONVENTION_DATES = "participant string, date string"
PORT_CAPACITY = (
    "port string, country string, fishing_capacity_m3 string, carrier_capacity_m3 string, port_id string"
)
