"""Voyages rebuilt from port-to-port legs, and their ports and risk votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import classes
from tidemark.functions.clock import hex_millis, hours_between, null_after, null_before
from tidemark.operators.sequences import merge_runs, ordered_scan
from tidemark.operators.skew import SLICE, slice_groups
from tidemark.operators.spatial import radius_join
from tidemark.params import VoyageParams
from tidemark.session import cut_lineage
from tidemark.sources.tables import write_bucketed

KEY = ["ssvid"]
# Total order of the legs of a vessel; the last columns only break ties.
ORDER = ["trip_start", "trip_end", "trip_start_anchorage_id", "trip_end_anchorage_id"]
ANCHORAGE_COLUMNS = ("lat", "lon", "label", "iso3")
VOTES = ("iuu_low", "iuu_med", "iuu_high", "iuu_no", "la_low", "la_med", "la_high", "la_no")


def clean_legs(legs: DataFrame, params: VoyageParams = VoyageParams()) -> DataFrame:
    """Legs that touch the study window and avoid the noise anchorage.

    Sentinel times turn NULL only after the window test, so a leg that is still
    open (an end in 2100) stays, with a NULL end.
    """
    return legs.where(
        (F.col("trip_start") <= F.lit(params.maximum).cast("timestamp"))
        & (F.col("trip_end") >= F.lit(params.minimum).cast("timestamp"))
        & (F.col("trip_start_anchorage_id") != params.noise_anchorage)
        & (F.col("trip_end_anchorage_id") != params.noise_anchorage)
    ).select(
        "ssvid",
        null_before(F.col("trip_start"), params.earliest_time).alias("trip_start"),
        null_after(F.col("trip_end"), params.latest_time).alias("trip_end"),
        "trip_start_anchorage_id",
        "trip_end_anchorage_id",
    )


def with_end_anchorages(
    trips: DataFrame, anchorages: DataFrame, columns: Sequence[str] = ANCHORAGE_COLUMNS
) -> DataFrame:
    """Join the anchorage table twice, as ``start_anchorage_*`` and ``end_anchorage_*``."""
    for side in ("start", "end"):
        role = anchorages.select(
            F.col("s2id").alias(f"trip_{side}_anchorage_id"),
            *[F.col(c).alias(f"{side}_anchorage_{c}") for c in columns],
        )
        trips = trips.join(role, f"trip_{side}_anchorage_id", "left")
    return trips


def enrich_legs(legs: DataFrame, anchorages: DataFrame) -> DataFrame:
    """Port states of both ends and the duration of each distinct leg."""
    return (
        with_end_anchorages(legs, anchorages, ("iso3",))
        .withColumn("trip_duration_hr", hours_between(F.col("trip_start"), F.col("trip_end")))
        .select(
            "ssvid", "trip_start", "trip_end",
            "trip_start_anchorage_id", "start_anchorage_iso3",
            "trip_end_anchorage_id", "end_anchorage_iso3", "trip_duration_hr",
        )
        .distinct()
    )


def flag_canal_ends(
    legs: DataFrame, anchorages: DataFrame, params: VoyageParams = VoyageParams()
) -> DataFrame:
    """Add ``ends_in_canal``: is the end anchorage one of the canal's?"""
    canal = (
        anchorages.where(F.col("sublabel") == params.canal)
        .select(F.col("s2id").alias("trip_end_anchorage_id"), F.lit(True).alias("ends_in_canal"))
        .distinct()
    )
    return legs.join(canal, "trip_end_anchorage_id", "left").fillna(False, ["ends_in_canal"])


def distinct_legs(legs: DataFrame) -> DataFrame:
    """Each leg once; a repeated leg would pass for the leg after itself.

    Dealt by vessel first, so that the scans that follow need no further exchange.
    """
    return legs.repartition(*KEY).dropDuplicates()


def merge_canal_transits(legs: DataFrame) -> DataFrame:
    """Glue legs that end in the canal to the next leg of the vessel.

    The end port of the merged trip is that of the latest known end.
    """
    return merge_runs(
        legs, KEY, ORDER,
        start="trip_start", end="trip_end", glued="ends_in_canal",
        first=["trip_start_anchorage_id"],
        last=["trip_end_anchorage_id"],
        last_by=["trip_end", "trip_start", "trip_start_anchorage_id", "trip_end_anchorage_id"],
    )


def with_port_stops(trips: DataFrame) -> DataFrame:
    """Hours in port until the vessel's next trip starts; NULL for its last trip."""
    return (
        ordered_scan(trips, KEY, ORDER, following={"_next_start": "trip_start"})
        .withColumn("port_stop_duration_hr", hours_between(F.col("trip_end"), F.col("_next_start")))
        .drop("_next_start")
    )


def merge_short_stops(
    trips: DataFrame, params: VoyageParams = VoyageParams()
) -> DataFrame:
    """Glue trips whose port stop is shorter than ``min_port_stop_hr`` to the next.

    With the default of 0 only overlapping trips merge. The end port and the stop
    are those of the run's last trip by start time.
    """
    short = F.coalesce(F.col("port_stop_duration_hr") < params.min_port_stop_hr, F.lit(False))
    return merge_runs(
        trips.withColumn("_short", short), KEY, ORDER,
        start="trip_start", end="trip_end", glued="_short",
        first=["trip_start_anchorage_id"],
        last=["trip_end_anchorage_id", "port_stop_duration_hr"],
        last_by=ORDER,
    )


def label_voyages(voyages: DataFrame, anchorages: DataFrame) -> DataFrame:
    """Position, label and port state of both ends, and the duration in hours."""
    return with_end_anchorages(voyages, anchorages).withColumn(
        "trip_duration_hr", hours_between(F.col("trip_start"), F.col("trip_end"))
    )


def final_trips(voyages: DataFrame, params: VoyageParams = VoyageParams()) -> DataFrame:
    """Trips inside the window that last long enough, are open, or lack a start; with id."""
    # The year-1 instant stands for "unknown start" in trip ids.
    unknown_start = F.lit("0001-02-03 00:00:00").cast("timestamp")
    no_start = F.col("trip_start_anchorage_id") == "NO_PREVIOUS_DATA"
    kept = voyages.where(
        (
            (F.col("trip_end") >= F.lit(params.minimum).cast("timestamp"))
            | F.col("trip_end").isNull()
        )
        & (
            (F.col("trip_end_anchorage_id") == "ACTIVE_VOYAGE")
            | (F.col("trip_duration_hr") > params.min_trip_duration_hr)
            | no_start
        )
        & (
            (F.col("trip_start") <= F.lit(params.maximum).cast("timestamp"))
            | F.col("trip_start").isNull()
        )
    )
    stamp = hex_millis(F.when(no_start, unknown_start).otherwise(F.col("trip_start")))
    return kept.withColumn("trip_id", F.concat("ssvid", F.lit("-"), stamp))


def disambiguate_labels(trips: DataFrame) -> DataFrame:
    """Rename the two homonym ports, each end by its own anchorage."""
    return trips.withColumns(
        {
            f"{side}_anchorage_label": classes.relabel(
                F.col(f"{side}_anchorage_label"),
                F.col(f"trip_{side}_anchorage_id"),
                classes.HOMONYM_ANCHORAGES,
            )
            for side in ("start", "end")
        }
    )


def voyages_from_legs(
    legs: DataFrame, anchorages: DataFrame, params: VoyageParams = VoyageParams()
) -> DataFrame:
    """The voyage core: legs -> merged, labelled voyages with trip ids.

    One exchange by vessel serves the removal of duplicate legs and both merges.
    """
    flagged = flag_canal_ends(clean_legs(legs, params), anchorages, params)
    transits = merge_canal_transits(slice_groups(distinct_legs(flagged), KEY, ORDER, counted=legs))
    voyages = merge_short_stops(with_port_stops(transits), params)
    return final_trips(label_voyages(voyages.drop(SLICE), anchorages), params)


def store_voyages(voyages: DataFrame, name: str, path: str, buckets: int | None = None) -> DataFrame:
    """Voyages as a table in buckets by vessel, sorted by vessel and time.

    Joins and aggregates by vessel, or by vessel and more, read it without an exchange
    (:func:`tidemark.session.configure` lets Spark use the vessel alone). ``buckets`` is
    the number of shuffle partitions unless given.
    """
    return write_bucketed(voyages, name, path, KEY, [*KEY, "trip_start"], buckets)


# -- ports -----------------------------------------------------------------------


def match_ports(
    anchorages: DataFrame,
    ports: DataFrame,
    *,
    radius_m: float = 3000.0,
    exclude_ports: Sequence[str] = (),
) -> DataFrame:
    """Survey ports and their anchorages, one anchorage per port.

    Each anchorage takes the nearest port within the radius, then each port the
    nearest of those anchorages; ties go to the smaller id. Both sides are first
    reduced to one row per position, so copies do not multiply the distance tests.
    """
    wanted = ports.where(~F.col("port_id").isin(list(exclude_ports))) if exclude_ports else ports
    port_places = (
        wanted.groupBy("lat", "lon")
        .agg(F.min("port_id").alias("port_id"))
        .select("port_id", F.col("lat").alias("port_lat"), F.col("lon").alias("port_lon"))
    )
    places = anchorages.select("lat", "lon").distinct()
    near = radius_join(
        places, port_places, point=("lat", "lon"), site=("port_lat", "port_lon"), radius_m=radius_m
    )
    nearest_port = near.groupBy("lat", "lon").agg(
        F.min(F.struct("distance_m", "port_id")).alias("_best")
    )
    by_anchorage = (
        anchorages.select("s2id", "label", "iso3", "lat", "lon")
        .join(nearest_port, ["lat", "lon"])
        .select(
            "s2id", "label", "iso3",
            F.col("_best.port_id").alias("port_id"),
            (F.col("_best.distance_m") / 1000).alias("distance_km"),
        )
    )
    best = by_anchorage.groupBy("port_id").agg(
        F.min(F.struct("distance_km", "s2id", "label", "iso3")).alias("_best")
    )
    return best.select("port_id", "_best.*")


def relabel_ports(matched: DataFrame) -> DataFrame:
    """Rename the two homonym ports on the survey side."""
    return matched.withColumn(
        "label", classes.relabel(F.col("label"), F.col("port_id"), classes.HOMONYM_PORTS)
    )


def attach_ports(
    trips: DataFrame, matched: DataFrame, on: Sequence[str] = ("label", "iso3")
) -> DataFrame:
    """Port ids of both ends, by label and port state, or by label alone.

    By label alone, a label used in two countries yields several rows per trip.
    """
    for side, name in (("start", "from_port_id"), ("end", "to_port_id")):
        role = matched.select(
            F.col("port_id").alias(name), *[F.col(c).alias(f"{side}_anchorage_{c}") for c in on]
        )
        trips = trips.join(role, [f"{side}_anchorage_{c}" for c in on], "left")
    return trips


def attach_votes(trips: DataFrame, port_risk: DataFrame, *, carrier_style: bool = False) -> DataFrame:
    """Risk votes of the arrival and departure port.

    Columns are named ``iuu_low_to`` and so on; ``carrier_style`` names them
    ``to_iuu_low`` and adds port and country names.
    """
    for role in ("to", "from"):
        trips = trips.join(_votes(port_risk, role, carrier_style), f"{role}_port_id", "left")
    return trips


def _votes(port_risk: DataFrame, role: str, carrier_style: bool) -> DataFrame:
    return port_risk.select(
        F.col("port_id").alias(f"{role}_port_id"),
        *[
            F.col("not_associated" if v.endswith("_no") else v).alias(
                f"{role}_{v}" if carrier_style else f"{v}_{role}"
            )
            for v in VOTES
        ],
        *([F.col(n).alias(f"{role}_{n}") for n in ("port", "country")] if carrier_style else []),
    )


def fan_out_ports(
    trips: DataFrame,
    matched: DataFrame,
    on: Sequence[str] = ("label",),
    port_risk: DataFrame | None = None,
    *,
    carrier_style: bool = False,
) -> DataFrame:
    """:func:`attach_ports`, and with ``port_risk`` :func:`attach_votes`, where keys have many ports.

    Votes are joined to the ports, ports are gathered per key, and a trip meets the list of
    each end before both lists are unrolled, so nothing is looked up per row of the result.
    The exchange before that fixes the columns of a trip; generated code would else work
    them out again per port, and it spreads the trips evenly.
    """
    spread = int(trips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = trips.repartition(spread, *[F.col(f"`{c}`") for c in trips.columns])
    for side, role in (("start", "from"), ("end", "to")):
        keys = [f"{side}_anchorage_{c}" for c in on]
        ports = matched.select(
            F.col("port_id").alias(f"{role}_port_id"), *[F.col(c).alias(k) for c, k in zip(on, keys)]
        )
        if port_risk is not None:
            ports = ports.join(_votes(port_risk, role, carrier_style), f"{role}_port_id", "left")
        found = [c for c in ports.columns if c not in keys]
        # A list of plain values is unrolled faster than one of rows.
        values = F.struct(*found) if len(found) > 1 else F.col(found[0])
        # One row per key, known small before the trips are.
        listed = cut_lineage(ports.groupBy(*keys).agg(F.collect_list(values).alias(f"_{role}")))
        out = out.join(listed, keys, "left")
    for role in ("from", "to"):
        rest = [F.col(f"`{c}`") for c in out.columns if c != f"_{role}"]
        unrolled = F.inline_outer(f"_{role}") if port_risk is not None else F.explode_outer(f"_{role}").alias(f"{role}_port_id")
        out = out.select(*rest, unrolled)
    return out


# -- fishing trips -----------------------------------------------------------------


def restrict_to_vessels(
    trips: DataFrame, good: DataFrame, params: VoyageParams = VoyageParams()
) -> DataFrame:
    """Trips of good vessels (any year) that start on a study day; adds ``start_year``."""
    day = F.to_date("trip_start")
    return (
        trips.where(
            (day >= F.lit(params.minimum).cast("date")) & (day <= F.lit(params.maximum).cast("date"))
        )
        .join(good.select("ssvid").distinct(), "ssvid", "left_semi")
        .withColumn("start_year", F.year("trip_start"))
    )


def fishing_trip_features(
    legs: DataFrame,
    anchorages: DataFrame,
    port_risk: DataFrame,
    good: DataFrame,
    attributes: DataFrame,
    params: VoyageParams = VoyageParams(),
    exclude_ports: Sequence[str] = classes.DUPLICATE_PORTS,
    match_anchorages: DataFrame | None = None,
) -> DataFrame:
    """One row per fishing trip: ports, flag group, gear, time at sea and risk votes.

    See :func:`fishing_features_of`.
    """
    return fishing_features_of(
        voyages_from_legs(legs, anchorages, params), anchorages, port_risk, good, attributes, params, exclude_ports,
        match_anchorages,
    )


def fishing_features_of(
    voyages: DataFrame,
    anchorages: DataFrame,
    port_risk: DataFrame,
    good: DataFrame,
    attributes: DataFrame,
    params: VoyageParams = VoyageParams(),
    exclude_ports: Sequence[str] = classes.DUPLICATE_PORTS,
    match_anchorages: DataFrame | None = None,
) -> DataFrame:
    """Fishing trip features of voyages, which may be stored ones (:func:`store_voyages`).

    ``good`` lists the good vessels and ``attributes`` the vessel attributes by year
    (:mod:`tidemark.plans.vessels`).
    """
    trips = disambiguate_labels(voyages)
    trips = restrict_to_vessels(trips, good, params)
    fishing = attributes.where(F.col("is_fishing").eqNullSafe(True))
    trips = trips.join(
        fishing.withColumnRenamed("year", "start_year"), ["ssvid", "start_year"], "inner"
    )
    sites = anchorages if match_anchorages is None else match_anchorages
    # One row per port at most, read at both ends of a trip.
    matched = cut_lineage(relabel_ports(match_ports(sites, port_risk, exclude_ports=exclude_ports)))
    trips = attach_ports(trips, matched)
    summary = trips.select(
        "trip_id", "trip_start_anchorage_id", "start_anchorage_label",
        "trip_end_anchorage_id", "end_anchorage_label",
        "ssvid", "trip_start", "trip_end", "from_port_id", "to_port_id",
        classes.flag_group(F.col("flag")).alias("flag_group"),
        "flag",
        classes.time_at_sea(F.col("trip_duration_hr")).alias("time_at_sea"),
        classes.gear_class(F.col("vessel_class")).alias("vessel_class"),
    )
    return attach_votes(summary, port_risk)


def add_country_name(trips: DataFrame, country_codes: DataFrame, flag: str, name: str) -> DataFrame:
    """Country name of a flag column."""
    names = country_codes.select(
        F.col("iso3").alias(flag), F.col("country_name").alias(name)
    ).distinct()
    return trips.join(names, flag, "left")
