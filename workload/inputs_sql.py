"""The derived inputs and shared intermediate results as SQL text for checks."""

from __future__ import annotations

from workload.inputs import YEARS

_FLAGS = "['CHN','PAN','LBR','ESP','UNK','XXX',NULL]"
_GEAR = (
    "['trawlers','trollers','driftnets','purse_seines','tuna_purse_seines','other_purse_seines',"
    "'set_gillnets','squid_jigger','pole_and_line','set_longlines','pots_and_traps','drifting_longlines']"
)


def _vote(value: str) -> str:
    return f"CASE WHEN s_suppkey % 6 = 0 THEN 0 ELSE {value} END"


def _trip_vote(i: int) -> str:
    return (
        f"CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 19 = {i} THEN NULL"
        f" ELSE (o_orderkey // {i + 2}) % {i + 3} END"
    )


_LEVELS = ("no", "low", "med", "high")

# name -> (names it reads, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *reads: str) -> None:
    CTES[name] = (reads, body)


def with_ctes(select: str, *names: str) -> str:
    """``WITH`` clause of the named parts and all they read, then ``select``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for other in CTES[name][0]:
                add(other)
            ordered.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered) + f"\n{select}"


cte("anchorages", """
    SELECT 'a' || s_suppkey AS s2id, 'PORT_' || (s_suppkey % 40) AS label,
      CASE WHEN s_suppkey % 9 = 0 THEN 'PANAMA CANAL' END AS sublabel,
      'N' || lpad(s_nationkey::VARCHAR, 2, '0') AS iso3,
      ((s_suppkey * 37) % 170 - 85)::DOUBLE AS lat, ((s_suppkey * 91) % 360 - 180)::DOUBLE AS lon,
      s_suppkey % 3 <> 0 AS at_dock
    FROM supplier""")
cte("port_risk", f"""
    SELECT 'p' || s_suppkey AS port_id, 'PORT_' || (s_suppkey % 40) AS port,
      'N' || lpad(s_nationkey::VARCHAR, 2, '0') AS country,
      (s_suppkey * 37) % 170 - 85 + (CASE WHEN s_suppkey % 10 = 4 THEN 0.05 ELSE 0.01 END)::DOUBLE AS lat,
      ((s_suppkey * 91) % 360 - 180)::DOUBLE AS lon,
      {_vote('3 * ((s_suppkey // 4) % 2)')} AS not_associated,
      {_vote('s_suppkey % 4')} AS iuu_low, {_vote('s_suppkey % 3')} AS iuu_med, {_vote('s_suppkey % 5')} AS iuu_high,
      {_vote('(s_suppkey + 1) % 4')} AS la_low, {_vote('(s_suppkey + 1) % 3')} AS la_med,
      {_vote('(s_suppkey + 1) % 5')} AS la_high
    FROM supplier WHERE s_suppkey % 2 = 0""")
cte("legs", """
    SELECT o_custkey::VARCHAR AS ssvid,
      CASE WHEN o_orderkey % 101 = 0 THEN TIMESTAMP '1800-01-01' ELSE o_orderdate + to_hours(o_orderkey % 24) END AS trip_start,
      CASE WHEN o_orderkey % 103 = 0 THEN TIMESTAMP '2100-01-01'
        ELSE o_orderdate + to_hours((o_orderkey % 45) * 24 + o_orderkey % 24 + o_orderkey % 7) END AS trip_end,
      CASE WHEN o_orderkey % 101 = 0 THEN 'NO_PREVIOUS_DATA' WHEN o_orderkey % 97 = 0 THEN '10000001'
        ELSE 'a' || (o_orderkey % 100) END AS trip_start_anchorage_id,
      CASE WHEN o_orderkey % 103 = 0 THEN 'ACTIVE_VOYAGE' ELSE 'a' || ((o_orderkey * 7 + 3) % 100) END AS trip_end_anchorage_id
    FROM orders JOIN range(2) r(i) ON i = 0 OR o_orderkey % 9 = 0""")
cte("vessel_info", f"""
    SELECT id::VARCHAR AS ssvid,
      CASE k % 29 WHEN 0 THEN 'BOUY 7' WHEN 1 THEN 'X 55%' WHEN 2 THEN '3.7V' WHEN 3 THEN 'ABC@12V3'
        WHEN 4 THEN 'NET MARK' WHEN 5 THEN '123-456' ELSE name END AS shipname,
      'S' || id AS n_shipname, 'I' || id AS n_imo, 'C' || id AS n_callsign,
      CASE WHEN {_FLAGS}[nation % 7 + 1] = 'UNK' THEN {_FLAGS}[(nation + 3) % 7 + 1] ELSE {_FLAGS}[nation % 7 + 1] END AS flag,
      {_GEAR}[k % 12 + 1] AS best_class,
      TIMESTAMP '1994-01-01' + to_days((k % 400)::INT) AS first_timestamp,
      TIMESTAMP '2001-12-31' - to_days((k % 300)::INT) AS last_timestamp,
      (k % 40) / 400.0 AS frac_spoofing, on_list
    FROM (SELECT c_custkey AS k, c_custkey AS id, c_name AS name, c_nationkey AS nation, c_custkey % 4 <> 1 AS on_list FROM customer
          UNION ALL
          SELECT s_suppkey, 1000000 + s_suppkey, s_name, s_nationkey, s_suppkey % 3 <> 0 FROM supplier)""")
cte("by_year", f"""
    SELECT c_custkey::VARCHAR AS ssvid, year, {_FLAGS}[c_nationkey % 7 + 1] AS best_flag,
      {_FLAGS}[(c_nationkey + 3) % 7 + 1] AS flag_mmsi, {_GEAR}[c_custkey % 12 + 1] AS best_class,
      CASE WHEN c_custkey % 17 <> 0 THEN 'x' END AS class_byyear,
      CASE WHEN c_custkey % 2 = 0 THEN 'pole_and_line' ELSE {_GEAR}[c_custkey % 12 + 1] END AS class_ag,
      c_custkey % 90 AS overlap_hours,
      CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 < 8 THEN 0 ELSE 1 END AS overlap_names,
      c_custkey % 13 = 0 AS offsetting, (c_custkey + year) % 90 AS fishing_hours, c_custkey % 300 AS active_hours,
      CASE WHEN c_custkey % 5 = 0 THEN []::VARCHAR[] WHEN c_custkey % 3 = 0 THEN ['trawlers', 'squid_jigger']
        ELSE ['trawlers', 'set_longlines'] END AS registered,
      c_custkey % 4 <> 1 AS on_list, c_custkey
    FROM customer, unnest([{YEARS}]) AS y(year)
    WHERE NOT (c_custkey % 10 = 3 AND year = 1996)""")
cte("shipnames", """
    SELECT ssvid, year, CASE WHEN i <> 6 THEN 'NAME' || (i % 6) END AS value, (c_custkey + i) % 15 + 6 AS count
    FROM by_year, range(10) AS r(i) WHERE i < c_custkey % 10""", "by_year")
cte("bad_vessels", """
    SELECT c_custkey AS id FROM customer WHERE c_custkey % 97 = 5
    UNION ALL SELECT c_custkey + 2 FROM customer WHERE c_custkey % 97 = 5""")
cte("offset_vessels", """
    SELECT c_custkey::VARCHAR AS ssvid, sum(c_custkey % 50 + i)::BIGINT AS positions
    FROM customer, range(3) AS r(i)
    WHERE (c_custkey % 20) * 200 > 3000 AND (c_custkey + i) % 9 > 5 GROUP BY 1""")
cte("country_codes", """
    SELECT DISTINCT ['CHN','PAN','LBR','ESP','XXX'][n_nationkey % 5 + 1] AS iso3,
      'COUNTRY_' || (n_nationkey % 5) AS country_name FROM nation""")
cte("encounter_rows", """
    SELECT k || '.' || member AS event_id, k::VARCHAR AS event, member::VARCHAR AS vessel_id,
      o_orderdate + to_hours(26) AS event_start, o_orderdate + to_hours(27 + k % 20) AS event_end,
      (k * 37) % 170 - 85 + (k % 5) * 0.04::DOUBLE AS lat_mean, ((k * 91) % 360 - 180)::DOUBLE AS lon_mean,
      (k % 9)::VARCHAR AS median_distance_km, (k % 4)::VARCHAR AS median_speed_knots
    FROM (SELECT o_orderkey AS k, o_custkey AS member, o_orderdate FROM orders
          UNION ALL
          SELECT DISTINCT l_orderkey, 1000000 + l_suppkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
cte("members", """
    SELECT event_id, event, vessel_id AS ssvid, event_start, event_end, event_start::DATE AS event_date,
      lat_mean, lon_mean, median_distance_km, median_speed_knots
    FROM encounter_rows
    WHERE event_end <= TIMESTAMP '2001-12-31' AND lat_mean < 90 AND lat_mean > -90 AND lon_mean < 180 AND lon_mean > -180
      AND vessel_id::BIGINT % 29 <> 4""", "encounter_rows")
cte("carriers", """
    SELECT DISTINCT c_custkey::VARCHAR AS carrier_ssvid, 'I' || c_custkey AS carrier_imo_ais, c_name AS carrier_shipname_ais,
      'C' || c_custkey AS carrier_callsign_ais, a.f AS carrier_first_timestamp, a.l AS carrier_last_timestamp
    FROM (SELECT *, CASE WHEN c_custkey % 11 = 3 THEN []::INT[] ELSE [1, 2] END AS registry,
            [{'f': TIMESTAMP '1994-01-01' + to_days((c_custkey % 400)::INT), 'l': TIMESTAMP '1999-06-01' + to_days((c_custkey % 500)::INT)},
             {'f': TIMESTAMP '2000-01-01' + to_days((c_custkey % 300)::INT), 'l': TIMESTAMP '2001-12-31'}] AS activity
          FROM customer), unnest(registry) AS r(x), unnest(activity) AS t(a)
    WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 4
      AND c_custkey::VARCHAR NOT IN ('111111111', '0', '888888888', '416202700') AND a.f <= TIMESTAMP '2000-06-30'""")
cte("carrier_members", """
    SELECT m.*, c.* FROM members m JOIN carriers c ON m.ssvid = c.carrier_ssvid
      AND m.event_start BETWEEN c.carrier_first_timestamp AND c.carrier_last_timestamp
      AND m.event_end BETWEEN c.carrier_first_timestamp AND c.carrier_last_timestamp""", "members", "carriers")
cte("pairs", """
    SELECT DISTINCT a.event_id, a.event, a.carrier_ssvid, b.ssvid AS neighbor_ssvid, a.event_start, a.event_end,
      a.lat_mean, a.lon_mean, a.median_distance_km, a.median_speed_knots,
      date_sub('minute', a.event_start, a.event_end) / 60.0::DOUBLE AS event_duration_hr
    FROM carrier_members a JOIN members b ON a.event = b.event WHERE a.carrier_ssvid <> b.ssvid""", "carrier_members", "members")
cte("attributed", """
    SELECT p.*, c.n_shipname AS carrier_shipname, c.n_imo AS carrier_imo, c.n_callsign AS carrier_callsign,
      c.flag AS carrier_flag, c.best_class AS carrier_label,
      n.n_shipname AS neighbor_shipname, n.n_imo AS neighbor_imo, n.n_callsign AS neighbor_callsign,
      n.flag AS neighbor_flag, n.best_class AS neighbor_label,
      n.first_timestamp AS neighbor_first_seen, n.on_list AS neighbor_is_fishing
    FROM pairs p
    JOIN vessel_info c ON p.carrier_ssvid = c.ssvid AND p.event_start >= c.first_timestamp AND p.event_end <= c.last_timestamp
    JOIN vessel_info n ON p.neighbor_ssvid = n.ssvid AND p.event_start >= n.first_timestamp AND p.event_end <= n.last_timestamp
    WHERE c.frac_spoofing < 0.05 AND n.frac_spoofing < 0.05""", "pairs", "vessel_info")


def distance_m(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"2 * 6371010.0 * asin(least(1.0, sqrt(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2))))"
    )


cte("at_sea", f"""
    SELECT * FROM attributed WHERE event_id NOT IN (
      SELECT e.event_id FROM (SELECT DISTINCT event_id, lat_mean, lon_mean FROM attributed) e, anchorages a
      WHERE {distance_m('e.lat_mean', 'e.lon_mean', 'a.lat', 'a.lon')} < 10000)""", "attributed", "anchorages")

# -- the voyage core ----------------------------------------------------------------------

_ORDER = (
    "trip_start NULLS FIRST, trip_end NULLS FIRST, "
    "trip_start_anchorage_id NULLS FIRST, trip_end_anchorage_id NULLS FIRST"
)
_BACK = (
    "trip_start DESC NULLS LAST, trip_end DESC NULLS LAST, "
    "trip_start_anchorage_id DESC NULLS LAST, trip_end_anchorage_id DESC NULLS LAST"
)
_BACK_BY_END = (
    "trip_end DESC NULLS LAST, trip_start DESC NULLS LAST, "
    "trip_start_anchorage_id DESC NULLS LAST, trip_end_anchorage_id DESC NULLS LAST"
)
cte("clean_legs", """
    SELECT ssvid, CASE WHEN trip_start < TIMESTAMP '1900-01-01' THEN NULL ELSE trip_start END AS trip_start,
      CASE WHEN trip_end > TIMESTAMP '2099-12-31' THEN NULL ELSE trip_end END AS trip_end,
      trip_start_anchorage_id, trip_end_anchorage_id
    FROM legs WHERE trip_start <= TIMESTAMP '2001-12-31' AND trip_end >= TIMESTAMP '1995-01-01'
      AND trip_start_anchorage_id <> '10000001' AND trip_end_anchorage_id <> '10000001'""", "legs")
cte("enriched_legs", """
    SELECT DISTINCT l.*, b.iso3 AS start_anchorage_iso3, c.iso3 AS end_anchorage_iso3,
      date_sub('second', trip_start, trip_end) / 3600.0::DOUBLE AS trip_duration_hr
    FROM clean_legs l LEFT JOIN anchorages b ON trip_start_anchorage_id = b.s2id
    LEFT JOIN anchorages c ON trip_end_anchorage_id = c.s2id""", "clean_legs", "anchorages")
cte("canal_legs", """
    SELECT *, trip_end_anchorage_id IN (SELECT s2id FROM anchorages WHERE sublabel = 'PANAMA CANAL') AS ends_in_canal
    FROM enriched_legs""", "enriched_legs", "anchorages")
cte("canal_filled", f"""
    SELECT *, last_value(CASE WHEN before THEN NULL ELSE trip_start END IGNORE NULLS) OVER
        (PARTITION BY ssvid ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s,
      first_value(CASE WHEN ends_in_canal THEN NULL ELSE trip_end END IGNORE NULLS) OVER
        (PARTITION BY ssvid ORDER BY {_ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e
    FROM (SELECT *, lag(ends_in_canal) OVER (PARTITION BY ssvid ORDER BY {_ORDER}) AS before FROM canal_legs)""", "canal_legs")
cte("transits", f"""
    SELECT DISTINCT ssvid, s AS trip_start, e AS trip_end,
      first_value(trip_start_anchorage_id) OVER (PARTITION BY ssvid, s, e ORDER BY {_ORDER}) AS trip_start_anchorage_id,
      first_value(trip_end_anchorage_id) OVER (PARTITION BY ssvid, s, e ORDER BY {_BACK_BY_END}) AS trip_end_anchorage_id
    FROM canal_filled""", "canal_filled")
cte("stops", f"""
    SELECT *, date_sub('second', trip_end, lead(trip_start) OVER (PARTITION BY ssvid ORDER BY {_ORDER})) / 3600.0::DOUBLE
      AS port_stop_duration_hr
    FROM transits""", "transits")
cte("short_filled", f"""
    SELECT *, last_value(CASE WHEN before THEN NULL ELSE trip_start END IGNORE NULLS) OVER
        (PARTITION BY ssvid ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s,
      first_value(CASE WHEN short THEN NULL ELSE trip_end END IGNORE NULLS) OVER
        (PARTITION BY ssvid ORDER BY {_ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e
    FROM (SELECT *, lag(short) OVER (PARTITION BY ssvid ORDER BY {_ORDER}) AS before
          FROM (SELECT *, coalesce(port_stop_duration_hr < 0, FALSE) AS short FROM stops))""", "stops")
cte("voyages", f"""
    SELECT DISTINCT ssvid, s AS trip_start, e AS trip_end,
      first_value(trip_start_anchorage_id) OVER (PARTITION BY ssvid, s, e ORDER BY {_ORDER}) AS trip_start_anchorage_id,
      first_value(trip_end_anchorage_id) OVER (PARTITION BY ssvid, s, e ORDER BY {_BACK}) AS trip_end_anchorage_id,
      first_value(port_stop_duration_hr) OVER (PARTITION BY ssvid, s, e ORDER BY {_BACK}) AS port_stop_duration_hr
    FROM short_filled""", "short_filled")
cte("labelled", """
    SELECT v.*, b.lat AS start_anchorage_lat, b.lon AS start_anchorage_lon, b.label AS start_anchorage_label,
      b.iso3 AS start_anchorage_iso3, c.lat AS end_anchorage_lat, c.lon AS end_anchorage_lon,
      c.label AS end_anchorage_label, c.iso3 AS end_anchorage_iso3,
      date_sub('second', trip_start, trip_end) / 3600.0::DOUBLE AS trip_duration_hr
    FROM voyages v LEFT JOIN anchorages b ON trip_start_anchorage_id = b.s2id
    LEFT JOIN anchorages c ON trip_end_anchorage_id = c.s2id""", "voyages", "anchorages")
cte("final_trips", """
    SELECT *, ssvid || '-' || format('{:012x}', epoch_ms(CASE WHEN trip_start_anchorage_id = 'NO_PREVIOUS_DATA'
        THEN TIMESTAMP '0001-02-03' ELSE trip_start END)) AS trip_id
    FROM labelled
    WHERE (trip_end >= TIMESTAMP '1995-01-01' OR trip_end IS NULL)
      AND (trip_end_anchorage_id = 'ACTIVE_VOYAGE' OR trip_duration_hr > 2 OR trip_start_anchorage_id = 'NO_PREVIOUS_DATA')
      AND (trip_start <= TIMESTAMP '2001-12-31' OR trip_start IS NULL)""", "labelled")


def port_match(name: str, exclude: str) -> None:
    cte(f"near_{name}", f"""
        SELECT s2id, label, iso3, port_id, {distance_m('a.lat', 'a.lon', 'p.lat', 'p.lon')} / 1000 AS distance_km
        FROM anchorages a, port_risk p WHERE abs(a.lat - p.lat) < 1 AND {exclude}""", "anchorages", "port_risk")
    cte(name, f"""
        SELECT s2id, label, iso3, port_id, distance_km FROM (
          SELECT *, row_number() OVER (PARTITION BY port_id ORDER BY distance_km, s2id) AS r FROM (
            SELECT *, row_number() OVER (PARTITION BY s2id ORDER BY distance_km, port_id) AS q
            FROM near_{name} WHERE distance_km <= 3) WHERE q = 1) WHERE r = 1""", f"near_{name}")


port_match("matched_all", "TRUE")
port_match("matched", "port_id NOT IN ('p57','p504','p505','p768','p609','p317','p51','p74','p52','p63','p2','p173')")

# -- vessels ---------------------------------------------------------------------------------

GEAR_PATTERN = (
    r"(.*)([\s]+[0-9]+%)$|[0-9]\.[0-9]V|(.*)[@]+([0-9]+V[0-9]?)$|BOUY|NET MARK|NETMARK|NETFISHING"
    r"|NET FISHING|^[0-9]*\-[0-9]*$"
)
cte("gear_buoys", f"SELECT ssvid FROM vessel_info WHERE regexp_matches(shipname, '{GEAR_PATTERN}')", "vessel_info")
cte("few_names", """
    SELECT y.ssvid, y.year FROM by_year y LEFT JOIN (
      SELECT ssvid, year, count(*) AS n FROM (
        SELECT ssvid, year, value FROM shipnames WHERE value IS NOT NULL GROUP BY ALL HAVING sum(count) >= 10) GROUP BY ALL
    ) s ON y.ssvid = s.ssvid AND y.year = s.year WHERE coalesce(n, 0) <= 5""", "by_year", "shipnames")
cte("light_years", """
    SELECT y.* FROM by_year y JOIN few_names f ON y.ssvid = f.ssvid AND y.year = f.year
    WHERE (overlap_names = 0 OR overlap_names IS NULL) AND overlap_hours < 72 AND NOT offsetting
      AND y.ssvid::BIGINT NOT IN (SELECT id FROM bad_vessels)""", "by_year", "few_names", "bad_vessels")
cte("quality_years", """
    SELECT ssvid, year, best_class AS geartype, best_flag AS flag FROM light_years
    WHERE on_list AND ssvid NOT IN (SELECT ssvid FROM gear_buoys) AND class_byyear IS NOT NULL
      AND fishing_hours > 24 AND active_hours > 120""", "light_years", "gear_buoys")
cte("good", "SELECT * FROM quality_years WHERE ssvid NOT IN (SELECT ssvid FROM offset_vessels)",
    "quality_years", "offset_vessels")
cte("attributes", """
    SELECT ssvid, year, CASE WHEN best_flag = 'UNK' THEN flag_mmsi ELSE best_flag END AS flag,
      CASE WHEN class_ag = 'pole_and_line' AND list_contains(registered, 'squid_jigger') THEN 'squid_jigger'
        ELSE best_class END AS vessel_class, on_list AS is_fishing
    FROM by_year""", "by_year")


def flag_group(x: str) -> str:
    from tidemark.functions.classes import FLAG_GROUPS

    branches = " ".join(
        "WHEN {} IN ({}) THEN '{}'".format(x, ",".join(f"'{c}'" for c in members), name)
        for name, members in FLAG_GROUPS.items()
    )
    return f"CASE {branches} WHEN {x} IS NULL THEN NULL ELSE 'other' END"


def gear_class(x: str) -> str:
    return (
        f"CASE WHEN {x} LIKE '%purse_seines' THEN 'purse_seine' WHEN {x} = 'set_gillnets' THEN 'set_gillnet'"
        f" WHEN {x} = 'set_longlines' THEN 'set_longline' WHEN {x} = 'drifting_longlines' THEN 'drifting_longline'"
        f" WHEN {x} IN ('trawlers','trollers','driftnets','squid_jigger','pole_and_line','pots_and_traps') THEN {x} END"
    )


def time_at_sea(x: str) -> str:
    return (
        f"CASE WHEN {x} < 720 THEN 'less_than_1m' WHEN {x} < 2160 THEN '1_3m' WHEN {x} < 4320 THEN '3_6m'"
        f" WHEN {x} < 8640 THEN '6_12m' WHEN {x} >= 8640 THEN '12m_and_more' END"
    )


cte("vessel_trips", """
    SELECT t.*, flag, vessel_class FROM final_trips t JOIN attributes a ON t.ssvid = a.ssvid AND year(trip_start) = a.year
    WHERE is_fishing AND trip_start::DATE BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'
      AND t.ssvid IN (SELECT ssvid FROM good)""", "final_trips", "attributes", "good")

# -- carriers ----------------------------------------------------------------------------------

cte("carrier_trips", """
    SELECT e.*, t.trip_id, t.trip_start, t.trip_end, t.trip_duration_hr, t.start_anchorage_label, t.end_anchorage_label
    FROM final_trips t JOIN at_sea e ON t.ssvid = e.carrier_ssvid
    WHERE t.trip_start < e.event_start AND t.trip_end > e.event_end""", "final_trips", "at_sea")
cte("loitering_rows", """
    SELECT o_custkey::VARCHAR AS ssvid, l_shipdate AS loitering_start_timestamp,
      l_shipdate + to_hours(l_quantity::BIGINT) AS loitering_end_timestamp,
      ((l_partkey * 7) % 360 - 179.5)::DOUBLE AS lon_mean, ((l_suppkey * 3) % 160 - 79.5)::DOUBLE AS lat_mean,
      l_quantity AS loitering_hours, l_discount * 400 AS avg_distance_from_shore_nm, l_tax * 40 AS avg_speed_knots
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
cte("loitering", """
    SELECT * FROM loitering_rows
    WHERE loitering_hours >= 8 AND avg_distance_from_shore_nm >= 20 AND avg_speed_knots < 2""", "loitering_rows")

# -- port events ---------------------------------------------------------------------------------

_EVENT_ORDER = "(PARTITION BY vessel_id, start_timestamp ORDER BY timestamp, anchorage_id, event_type)"
cte("port_events", """
    SELECT user_id::VARCHAR AS vessel_id, date_trunc('week', ts)::TIMESTAMP AS start_timestamp,
      date_trunc('week', ts)::TIMESTAMP + to_days(7) AS end_timestamp, date_trunc('week', ts)::DATE AS date,
      year(date_trunc('week', ts)) AS year, ts AS timestamp, 'a' || (event_id % 3) AS anchorage_id,
      CASE event_type WHEN 'view' THEN 'PORT_ENTRY' WHEN 'click' THEN 'PORT_STOP_BEGIN' WHEN 'purchase' THEN 'PORT_STOP_END'
        WHEN 'error' THEN 'PORT_GAP' ELSE 'PORT_EXIT' END AS event_type
    FROM events""")
cte("plausible", f"""
    SELECT * EXCLUDE (flag, flag2) FROM (
      SELECT *, CASE WHEN lag(flag) OVER w = 'weird_begin' AND event_type = 'PORT_STOP_END' THEN 1
          WHEN lead(flag) OVER w = 'weird_end' AND event_type = 'PORT_STOP_BEGIN' THEN 1 END AS flag2
      FROM (SELECT *, CASE WHEN event_type = 'PORT_STOP_BEGIN' AND lag(event_type) OVER v = 'PORT_GAP' THEN 'weird_begin'
              WHEN event_type = 'PORT_STOP_END' AND lead(event_type) OVER v = 'PORT_GAP' THEN 'weird_end' END AS flag
            FROM port_events WINDOW v AS {_EVENT_ORDER})
      WHERE event_type IN ('PORT_STOP_BEGIN', 'PORT_STOP_END') WINDOW w AS {_EVENT_ORDER})
    WHERE flag IS NULL AND flag2 IS NULL""", "port_events")


def joined_stops(name: str, minutes: int) -> None:
    cte(name, f"""
        SELECT * EXCLUDE (gap, next_gap) FROM (
          SELECT *, lead(gap) OVER w AS next_gap FROM (
            SELECT *, CASE WHEN event_type = 'PORT_STOP_BEGIN' AND lag(event_type) OVER v = 'PORT_STOP_END'
                AND anchorage_id = lag(anchorage_id) OVER v THEN date_sub('minute', lag(timestamp) OVER v, timestamp) END AS gap
            FROM plausible WINDOW v AS {_EVENT_ORDER}) WINDOW w AS {_EVENT_ORDER})
        WHERE coalesce(gap >= {minutes}, TRUE) AND coalesce(next_gap >= {minutes}, TRUE)""", "plausible")


joined_stops("joined_30", 30)
joined_stops("joined_720", 720)


def durations_of(name: str, joined: str) -> None:
    cte(name, f"""
        SELECT year, date, vessel_id, start_timestamp, end_timestamp, anchorage_id, timestamp AS stop_begin_time,
          stop_end_time, date_sub('minute', timestamp, stop_end_time) AS duration_min
        FROM (SELECT *, CASE WHEN lead(event_type) OVER w = 'PORT_STOP_END' THEN lead(timestamp) OVER w END AS stop_end_time
              FROM {joined} WINDOW w AS {_EVENT_ORDER})
        WHERE event_type = 'PORT_STOP_BEGIN'""", joined)


durations_of("durations_30", "joined_30")
durations_of("durations_720", "joined_720")
cte("vessel_daily", """
    SELECT DISTINCT user_id::VARCHAR AS vessel_id, (120 + user_id % 120)::VARCHAR AS ssvid, ts::DATE AS day FROM events""")
cte("stored_voyages", """
    SELECT (120 + user_id % 120)::VARCHAR AS ssvid, w + to_hours(168 + CASE WHEN user_id % 5 = 0 THEN 0 ELSE 1 END) AS trip_start,
      w + to_hours(CASE WHEN user_id % 2 = 0 THEN 0 ELSE -1 END) AS trip_end
    FROM (SELECT DISTINCT user_id, date_trunc('week', ts)::TIMESTAMP AS w FROM events)""")
cte("dock_stops", """
    SELECT DISTINCT d.* EXCLUDE (year, date), v.ssvid, t.flag, t.vessel_class, a.iso3 AS port_iso3, a.label AS port, a.at_dock
    FROM durations_720 d JOIN vessel_daily v ON d.vessel_id = v.vessel_id AND d.date = v.day
    JOIN attributes t ON v.ssvid = t.ssvid AND d.year = t.year
    JOIN anchorages a ON d.anchorage_id = a.s2id
    WHERE t.is_fishing AND a.at_dock AND duration_min IS NOT NULL
      AND (v.ssvid, d.year) IN (SELECT (ssvid, year) FROM good)""",
    "durations_720", "vessel_daily", "attributes", "anchorages", "good")

# -- port visits of the policy study -----------------------------------------------------------------

cte("study_visits", """
    SELECT o_custkey::VARCHAR AS vessel_id, o_orderdate + to_hours(o_orderkey % 24) AS start_timestamp,
      o_orderdate + to_hours(o_orderkey % 24 + 1 + o_orderkey % 40) AS end_timestamp,
      'a' || (o_orderkey % 100) AS start_anchorage_id, o_orderkey AS k
    FROM orders""")
cte("study_daily", """
    SELECT DISTINCT vessel_id, vessel_id AS ssvid, start_timestamp::DATE AS day FROM study_visits WHERE k % 13 <> 0""",
    "study_visits")
cte("study_voyages", """
    SELECT vessel_id AS ssvid, end_timestamp + to_minutes(CASE WHEN k % 7 = 0 THEN 0 ELSE 1 END) AS trip_start,
      start_timestamp + to_minutes(CASE WHEN k % 3 <> 0 THEN 0 ELSE -1 END) AS trip_end FROM study_visits""", "study_visits")
cte("study_table", f"""
    SELECT DISTINCT year(v.start_timestamp) AS year, d.ssvid, v.start_timestamp, v.end_timestamp, v.start_anchorage_id,
      a.label AS port_name, a.iso3 AS port_iso3, t.flag, {flag_group('t.flag')} AS flag_group, t.is_fishing, e.is_encountered,
      CASE WHEN t.vessel_class LIKE '%purse_seines' THEN 'purse_seine' ELSE t.vessel_class END AS vessel_class
    FROM study_visits v LEFT JOIN anchorages a ON v.start_anchorage_id = a.s2id
    LEFT JOIN study_daily d ON v.vessel_id = d.vessel_id AND v.start_timestamp::DATE = d.day
    LEFT JOIN attributes t ON d.ssvid = t.ssvid AND year(v.start_timestamp) = t.year
    LEFT JOIN (SELECT vessel_id AS ssvid, start_timestamp AS trip_end, k % 8 = 0 AS is_encountered FROM study_visits WHERE k % 4 = 0) e
      ON d.ssvid = e.ssvid AND v.start_timestamp = e.trip_end
    WHERE ((d.ssvid, v.start_timestamp) IN (SELECT (ssvid, trip_end) FROM study_voyages)
        OR (d.ssvid, v.end_timestamp) IN (SELECT (ssvid, trip_start) FROM study_voyages))
      AND year(v.start_timestamp) IN (1996, 1998)
      AND (d.ssvid, year(v.start_timestamp)) IN (SELECT (ssvid, year) FROM light_years)
      AND d.ssvid IN (SELECT ssvid FROM by_year WHERE year = 1996 INTERSECT SELECT ssvid FROM by_year WHERE year = 1998)""",
    "study_visits", "anchorages", "study_daily", "attributes", "study_voyages", "light_years", "by_year")
cte("panel_visits", """
    SELECT year(o_orderdate) AS year, o_custkey::VARCHAR AS ssvid, o_orderdate AS start_timestamp,
      'N' || lpad(((o_orderkey * o_orderkey) % 25)::VARCHAR, 2, '0') AS port_iso3, 'N' || lpad(c_nationkey::VARCHAR, 2, '0') AS flag,
      ['trawlers','purse_seine','cargo','tanker'][o_custkey % 4 + 1] AS vessel_class,
      ['group1','group2','other'][c_nationkey % 3 + 1] AS flag_group
    FROM orders JOIN customer ON o_custkey = c_custkey""")
cte("sovereigns", """
    SELECT territory, arg_max(sovereign, pos) AS sovereign FROM (
      SELECT 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS territory,
        'N' || lpad(((n_nationkey + 5 + i) % 25)::VARCHAR, 2, '0') AS sovereign, n_nationkey * 2 + i AS pos
      FROM nation, range(2) AS r(i) WHERE n_nationkey % 6 = 0 AND n_nationkey % 4 <> 3
      UNION ALL VALUES ('MAC', 'CHN', 1000000), ('HKG', 'CHN', 1000001), ('MYT', 'FRA', 1000002), ('ALA', 'FIN', 1000003))
    GROUP BY territory""")
cte("foreign_visits", """
    SELECT v.*, coalesce(f.sovereign, v.flag) AS flag_sovereign, coalesce(p.sovereign, v.port_iso3) AS port_iso3_sovereign
    FROM panel_visits v LEFT JOIN sovereigns f ON v.flag = f.territory LEFT JOIN sovereigns p ON v.port_iso3 = p.territory
    WHERE coalesce(f.sovereign, v.flag) <> coalesce(p.sovereign, v.port_iso3)""", "panel_visits", "sovereigns")
cte("entered", """
    SELECT 2015 + n_nationkey % 3 AS entry_year, 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS iso3 FROM nation
    WHERE n_nationkey % 8 <> 7 AND n_nationkey <> 4 AND n_nationkey % 5 <> 3""")
cte("panel_counts", """
    SELECT year, port_iso3, count(start_timestamp) AS n_visits FROM foreign_visits
    WHERE vessel_class IN ('trawlers', 'purse_seine') AND year IN (1996, 1998)
      AND port_iso3 NOT IN (SELECT iso3 FROM entered WHERE entry_year = 2017) GROUP BY ALL""", "foreign_visits", "entered")
cte("panel", """
    SELECT c.year, c.port_iso3, n_visits,
      CASE WHEN c.port_iso3 IN (SELECT iso3 FROM entered WHERE entry_year = 2016) THEN 1 ELSE 0 END AS policy,
      CASE WHEN c.year = 1996 THEN 0 ELSE 1 END AS after
    FROM panel_counts c
    WHERE (SELECT count(*) FROM panel_counts o WHERE o.port_iso3 = c.port_iso3) = 2""", "panel_counts", "entered")
cte("trimmed_panel", """
    SELECT * FROM panel WHERE port_iso3 NOT IN (
      SELECT port_iso3 FROM panel WHERE n_visits < (
        SELECT max(n_visits) FROM (SELECT n_visits, sum(n_visits) OVER (ORDER BY n_visits DESC, year, port_iso3
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(n_visits) OVER () AS share FROM panel) WHERE share > 0.95))""",
    "panel")

# -- effort -----------------------------------------------------------------------------------------

cte("fishing_rows", """
    SELECT user_id::VARCHAR AS ssvid, ts AS timestamp, (user_id * 13) % 150 - 75 + (event_id % 20) * 0.25::DOUBLE AS lat,
      (user_id * 29) % 350 - 175 + (event_id % 16) * 0.25::DOUBLE AS lon,
      CASE WHEN (event_id % 100) / 100.0::DOUBLE > 0.5 THEN value / 10 ELSE 0 END AS fishing_hours
    FROM events WHERE (user_id * 10 + event_id % 10) % 25 > 10 AND (user_id * 10 + event_id % 10) % 7 <> 0
      AND (user_id * 10 + event_id % 10) % 11 <> 0""")
cte("trip_risk", """
    SELECT user_id || '-' || k AS trip_id, user_id::VARCHAR AS ssvid, TIMESTAMP '2024-01-01' + to_hours(72 * k + user_id % 24) AS trip_start,
      TIMESTAMP '2024-01-01' + to_hours(72 * k + user_id % 24 + 48) AS trip_end, ((user_id + k) % 3)::INT AS risk_class
    FROM (SELECT DISTINCT user_id FROM events), range(10) AS r(k)""")
cte("fishing_in_trips", """
    SELECT f.*, trip_start, trip_end, risk_class FROM fishing_rows f JOIN trip_risk t ON f.ssvid = t.ssvid
    WHERE trip_start <= timestamp AND trip_end >= timestamp""", "fishing_rows", "trip_risk")
cte("effort", """
    SELECT round(lat) AS lat_bin, round(lon) AS lon_bin, risk_class, sum(fishing_hours) AS fishing_hours
    FROM fishing_in_trips GROUP BY ALL""", "fishing_in_trips")
cte("effort_area", """
    SELECT *, fishing_hours / km2 AS fishing_hours_km2 FROM (
      SELECT *, 6378137.0 * 6378137.0 * 1e-6 * radians(1.0) * abs(sin(radians(lat_bin + 1)) - sin(radians(lat_bin))) AS km2
      FROM effort)""", "effort")
cte("scaled_effort", """
    SELECT *, (fishing_hours_km2 - min(fishing_hours_km2) OVER w) / nullif(max(fishing_hours_km2) OVER w - min(fishing_hours_km2) OVER w, 0) AS scaled
    FROM effort_area WINDOW w AS (PARTITION BY risk_class)""", "effort_area")
cte("density", """
    SELECT risk_class, gx, gy, -180 + gx * 1.0::DOUBLE AS lon, -90 + gy * 0.5::DOUBLE AS lat, q / (total * 1.5625) AS density FROM (
      SELECT risk_class, gx, gy, sum(p * exp(-pow((-90 + gy * 0.5 - lat_bin) / 1.25, 2) / 2) / sqrt(2 * pi())) AS q
      FROM (SELECT risk_class, gx, lat_bin, sum(scaled * exp(-pow((-180 + gx - lon_bin) / 1.25, 2) / 2) / sqrt(2 * pi())) AS p
            FROM scaled_effort, range(361) AS a(gx) WHERE scaled IS NOT NULL GROUP BY ALL), range(361) AS b(gy) GROUP BY ALL)
    JOIN (SELECT risk_class, sum(scaled) AS total FROM scaled_effort GROUP BY ALL) USING (risk_class)""", "scaled_effort")

# -- durations, factors, trips --------------------------------------------------------------------------

cte("duration_rows", """
    SELECT l_returnflag || l_linestatus AS flag_group, s_nationkey::VARCHAR AS port_iso3, p_type AS vessel_class, duration_min,
      ln(duration_min / 60.0::DOUBLE) AS log_hours
    FROM (SELECT *, (30 + floor(l_extendedprice)::BIGINT % 3000) * (8 + s_nationkey % 9 + length(p_type) % 4) // 8 AS duration_min FROM lineitem
          JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)
    WHERE duration_min >= 60""")
cte("duration_cells", """
    SELECT flag_group, port_iso3, vessel_class, count(*) AS n, sum(log_hours) AS sum_y, sum(log_hours * log_hours) AS sum_y2
    FROM duration_rows GROUP BY ALL""", "duration_rows")
cte("factor_rows", """
    SELECT 't' || o_orderkey AS trip_id, o_orderkey AS k, o_orderpriority AS flag, c_mktsegment AS gear, o_orderstatus AS tas,
      o_totalprice / 100000 - 2 AS risk_score FROM orders JOIN customer ON o_custkey = c_custkey""")
cte("attributed_rows", """
    SELECT *, p1 - flag_x_gear - flag_x_tas AS m_flag, p2 - flag_x_gear - gear_x_tas AS m_gear, p3 - flag_x_tas - gear_x_tas AS m_tas FROM (
      SELECT *, (v1 - v0) / 3 + (v12 - v2) / 6 + (v13 - v3) / 6 + (v123 - v23) / 3 AS p1,
        (v2 - v0) / 3 + (v12 - v1) / 6 + (v23 - v3) / 6 + (v123 - v13) / 3 AS p2,
        (v3 - v0) / 3 + (v13 - v1) / 6 + (v23 - v2) / 6 + (v123 - v12) / 3 AS p3,
        (v12 - v1 - v2 + v0 + v123 - v13 - v23 + v3) / 4 AS flag_x_gear,
        (v13 - v1 - v3 + v0 + v123 - v12 - v23 + v2) / 4 AS flag_x_tas,
        (v23 - v2 - v3 + v0 + v123 - v12 - v13 + v1) / 4 AS gear_x_tas
      FROM (SELECT *, avg(risk_score) OVER () AS v0, avg(risk_score) OVER (PARTITION BY flag) AS v1,
          avg(risk_score) OVER (PARTITION BY gear) AS v2, avg(risk_score) OVER (PARTITION BY tas) AS v3,
          avg(risk_score) OVER (PARTITION BY flag, gear) AS v12, avg(risk_score) OVER (PARTITION BY flag, tas) AS v13,
          avg(risk_score) OVER (PARTITION BY gear, tas) AS v23, avg(risk_score) OVER (PARTITION BY flag, gear, tas) AS v123
        FROM factor_rows))""", "factor_rows")
cte("trip_rows", f"""
    SELECT 't' || o_orderkey AS trip_id, o_custkey::VARCHAR AS ssvid, o_orderdate AS trip_start,
      o_orderdate + to_days((o_orderkey % 45)::INT) AS trip_end,
      ['china','group1','group2','group3','other',''][o_custkey % 6 + 1] AS flag_group,
      ['trawlers','trollers','driftnets','purse_seine','set_gillnet','squid_jigger','pole_and_line','set_longline',
       'pots_and_traps','drifting_longline',NULL][o_orderkey % 11 + 1] AS vessel_class,
      ['less_than_1m','1_3m','3_6m','6_12m','12m_and_more'][(o_orderkey + o_custkey) % 5 + 1] AS time_at_sea,
      {', '.join(f'{_trip_vote(i)} AS iuu_{v}_to' for i, v in enumerate(_LEVELS))}
    FROM orders""")
cte("complete_trips", "SELECT * FROM trip_rows WHERE flag_group <> '' AND vessel_class <> '' AND time_at_sea <> ''", "trip_rows")
cte("observed_trips", """
    SELECT *, iuu_low_to / 3.0::DOUBLE + iuu_med_to * (2 / 3.0::DOUBLE) + iuu_high_to - iuu_no_to AS risk_score FROM complete_trips
    WHERE coalesce(iuu_no_to, 0) + coalesce(iuu_low_to, 0) + coalesce(iuu_med_to, 0) + coalesce(iuu_high_to, 0) > 0""",
    "complete_trips")
cte("predicted_trips", """
    SELECT c.*, coalesce(a.m, b.m, d.m, e.m) AS risk_score FROM complete_trips c
    LEFT JOIN (SELECT flag_group, vessel_class, time_at_sea, avg(risk_score) AS m FROM observed_trips GROUP BY ALL) a
      USING (flag_group, vessel_class, time_at_sea)
    LEFT JOIN (SELECT flag_group, vessel_class, avg(risk_score) AS m FROM observed_trips GROUP BY ALL) b USING (flag_group, vessel_class)
    LEFT JOIN (SELECT flag_group, avg(risk_score) AS m FROM observed_trips GROUP BY ALL) d USING (flag_group)
    CROSS JOIN (SELECT avg(risk_score) AS m FROM observed_trips) e
    WHERE trip_id NOT IN (SELECT trip_id FROM observed_trips) AND vessel_class IN (SELECT vessel_class FROM observed_trips)""",
    "complete_trips", "observed_trips")


def _carrier_vote(i: int) -> str:
    return (
        f"CASE WHEN l_orderkey % 4 = 0 THEN 0 WHEN l_orderkey % 23 = {i} THEN NULL"
        f" ELSE (l_orderkey // {i + 2}) % {i + 3} END"
    )


_MET_FLAGS = "['china','group1','group2','group3','other']"
_MET_GEAR = "['trawlers','purse_seine','squid_jigger','pole_and_line','set_longline',NULL]"
cte("carrier_rows", f"""
    SELECT 't' || l_orderkey AS trip_id, o_orderdate + to_hours(l_linenumber) AS event_start, l_suppkey::VARCHAR AS neighbor_ssvid,
      o_custkey::VARCHAR AS carrier_ssvid, ((l_partkey * 7) % 360 - 180)::DOUBLE AS lon_mean, ((l_suppkey * 3) % 160 - 80)::DOUBLE AS lat_mean,
      ['less_than_1m','1_3m','3_6m','6_12m','12m_and_more'][l_orderkey % 5 + 1] AS time_at_sea,
      {_MET_FLAGS}[o_custkey % 5 + 1] AS carrier_flag_group, {_MET_FLAGS}[(l_suppkey // 3) % 5 + 1] AS neighbor_flag_group,
      {_MET_GEAR}[l_partkey % 6 + 1] AS neighbor_vessel_class,
      {', '.join(f'{_carrier_vote(i)} AS to_{r}_{v}' for r in ('iuu', 'la') for i, v in enumerate(_LEVELS))}
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
cte("carrier_loitering", """
    SELECT 't' || l_orderkey AS trip_id, CASE WHEN l_orderkey % 3 <> 0 THEN l_suppkey::VARCHAR END AS ssvid, ((l_partkey * 5) % 360 - 180)::DOUBLE AS lon_mean,
      ((l_suppkey * 7) % 160 - 80)::DOUBLE AS lat_mean FROM lineitem""")
