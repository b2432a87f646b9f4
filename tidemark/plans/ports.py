"""Port stops from port event sequences, and port visits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import classes
from tidemark.functions.clock import whole_minutes
from tidemark.operators.sequences import ordered_scan
from tidemark.operators.skew import slice_groups
from tidemark.params import PortStopParams
from tidemark.plans.vessels import (
    resolve_identity,
    restrict_to_vessel_years,
    vessels_in_every_year,
)
from tidemark.sources.tables import in_shards

# A visit is named by its vessel and both its bounds.
VISIT = ["vessel_id", "start_timestamp", "end_timestamp"]
# Time order of the events of a visit; the rest only breaks ties.
ORDER = ["timestamp", "anchorage_id", "event_type"]
BEGIN, END, GAP = "PORT_STOP_BEGIN", "PORT_STOP_END", "PORT_GAP"


def explode_events(port_visits: DataFrame, params: PortStopParams = PortStopParams()) -> DataFrame:
    """One row per event of the nested ``events`` array, with the visit's date and year.

    The shard range of ``params`` reaches the scan as a filter on its partitions.
    """
    return in_shards(port_visits, params.first_shard, params.last_shard).select(*VISIT, F.inline("events")).select(
        *VISIT,
        F.to_date("start_timestamp").alias("date"),
        F.year("start_timestamp").alias("year"),
        "timestamp", "anchorage_id", "event_type",
    )


def drop_implausible(events: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Stop begins and ends without implausible brackets.

    A begin right after a gap and an end right before one are implausible; so is
    the end right after such a begin and the begin right before such an end, among
    begins and ends alone.
    """
    kind = F.col("event_type")
    near = ordered_scan(
        events, VISIT, order, previous={"_before": "event_type"}, following={"_after": "event_type"}
    )
    flagged = near.withColumn(
        "_flag",
        F.when((kind == BEGIN) & (F.col("_before") == GAP), "begin").when(
            (kind == END) & (F.col("_after") == GAP), "end"
        ),
    ).where(kind.isin(BEGIN, END))
    partners = ordered_scan(
        flagged, VISIT, order, previous={"_before": "_flag"}, following={"_after": "_flag"}
    )
    orphan = ((F.col("_before") == "begin") & (kind == END)) | (
        (F.col("_after") == "end") & (kind == BEGIN)
    )
    return partners.where(F.col("_flag").isNull() & ~F.coalesce(orphan, F.lit(False))).drop(
        "_flag", "_before", "_after"
    )


def join_close_stops(
    stops: DataFrame,
    params: PortStopParams = PortStopParams(),
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Remove the end and the begin around a short pause at one anchorage of a visit."""
    near = ordered_scan(
        stops, VISIT, order,
        previous={"_kind": "event_type", "_place": "anchorage_id", "_time": "timestamp"},
    )
    pause = F.when(
        (F.col("event_type") == BEGIN) & (F.col("_kind") == END) & (F.col("anchorage_id") == F.col("_place")),
        whole_minutes(F.col("_time"), F.col("timestamp")),
    )
    short = near.withColumn("_short", F.coalesce(pause < params.short_gap_min, F.lit(False)))
    both = ordered_scan(short, VISIT, order, following={"_short_next": "_short"})
    return both.where(~F.col("_short") & ~F.coalesce("_short_next", F.lit(False))).drop(
        "_kind", "_place", "_time", "_short", "_short_next"
    )


def stop_durations(stops: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """One row per begin, with the end right after it and the whole minutes between."""
    near = ordered_scan(
        stops, VISIT, order, following={"_kind": "event_type", "_time": "timestamp"}
    )
    finish = F.when(F.col("_kind") == END, F.col("_time"))
    return near.where(F.col("event_type") == BEGIN).select(
        "year", "date", *VISIT, "anchorage_id",
        F.col("timestamp").alias("stop_begin_time"),
        finish.alias("stop_end_time"),
        whole_minutes(F.col("timestamp"), finish).alias("duration_min"),
    )


def port_stops(
    port_visits: DataFrame,
    params: PortStopParams = PortStopParams(),
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Port visits with nested events -> cleaned stops with duration.

    All four scans share one exchange by visit; large visits are sliced once.
    """
    visits = in_shards(port_visits, params.first_shard, params.last_shard)
    events = slice_groups(
        explode_events(visits), VISIT, order, counted=visits, weight=F.greatest(F.size("events"), F.lit(0))
    )
    return stop_durations(join_close_stops(drop_implausible(events, order), params, order), order)


def dock_stops(stops: DataFrame, anchorages: DataFrame) -> DataFrame:
    """Finished stops at a dock with the port's label and state."""
    docks = anchorages.where(F.col("at_dock")).select(
        F.col("s2id").alias("anchorage_id"),
        F.col("iso3").alias("port_iso3"), F.col("label").alias("port"), "at_dock",
    )
    return stops.where(F.col("duration_min").isNotNull()).join(docks, "anchorage_id").distinct()


def touching_voyages(visits: DataFrame, voyages: DataFrame) -> DataFrame:
    """Visits that start where a voyage of the vessel ends, or end where one starts.

    The voyage bounds are made distinct, so no visit is repeated; the two tests are
    typed (ssvid, time) joins.
    """
    ends = voyages.select("ssvid", F.col("trip_end").alias("start_timestamp")).distinct()
    starts = voyages.select("ssvid", F.col("trip_start").alias("end_timestamp")).distinct()
    return (
        visits.join(ends.withColumn("_arrives", F.lit(True)), ["ssvid", "start_timestamp"], "left")
        .join(starts.withColumn("_departs", F.lit(True)), ["ssvid", "end_timestamp"], "left")
        .where("_arrives or _departs")
        .drop("_arrives", "_departs")
    )


def port_stop_table(
    port_visits: DataFrame,
    vessel_daily: DataFrame,
    good: DataFrame,
    attributes: DataFrame,
    anchorages: DataFrame,
    voyages: DataFrame,
    params: PortStopParams = PortStopParams(),
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Dock stops of good fishing vessels with flag, gear and port, tied to voyages.

    The shard range holds for the visits and for the identities.
    """
    daily = in_shards(vessel_daily, params.first_shard, params.last_shard)
    stops = resolve_identity(port_stops(port_visits, params, order), daily, "date")
    known = restrict_to_vessel_years(stops, good).join(
        attributes.where(F.col("is_fishing").eqNullSafe(True)).drop("is_fishing"),
        ["ssvid", "year"],
    )
    docked = dock_stops(known.drop("year", "date"), anchorages)
    named = docked.withColumns(
        {
            "port": classes.relabel(F.col("port"), F.col("anchorage_id"), classes.HOMONYM_ANCHORAGES),
            "vessel_class": classes.gear_class(F.col("vessel_class")),
        }
    ).where("vessel_class is not null and flag is not null")
    return touching_voyages(named, voyages)


def port_visit_table(
    port_visits: DataFrame,
    anchorages: DataFrame,
    vessel_daily: DataFrame,
    voyages: DataFrame,
    attributes: DataFrame,
    voyages_encountered: DataFrame,
    good: DataFrame,
    by_year: DataFrame,
    years: Sequence[int] = (2015, 2017),
    shards: tuple[str | None, str | None] = (None, None),
) -> DataFrame:
    """Port visits of the two study years by good vessels present in both.

    ``shards`` is the range of day shards read of visits and identities. The study years and the vessel filters drop rows only, so they run first; the
    attribute and encounter joins keep every visit.
    """
    places = anchorages.select(
        F.col("s2id").alias("start_anchorage_id"),
        F.col("label").alias("port_name"), F.col("iso3").alias("port_iso3"),
    )
    visits = in_shards(port_visits, *shards).select(
        "vessel_id", "start_timestamp", "end_timestamp", "start_anchorage_id",
        F.to_date("start_timestamp").alias("date"),
        F.year("start_timestamp").alias("year"),
    ).where(F.col("year").isin(list(years)))
    identified = resolve_identity(visits, in_shards(vessel_daily, *shards), "date").drop("vessel_id", "date")
    kept = restrict_to_vessel_years(identified, good).join(
        vessels_in_every_year(by_year, years), "ssvid", "left_semi"
    )
    encountered = voyages_encountered.select(
        "ssvid", F.col("trip_end").alias("start_timestamp"), "is_encountered"
    )
    return (
        touching_voyages(kept, voyages)
        .join(places, "start_anchorage_id", "left")
        .join(attributes, ["ssvid", "year"], "left")
        .join(encountered, ["ssvid", "start_timestamp"], "left")
        .select(
            "year", "ssvid", "start_timestamp", "end_timestamp", "start_anchorage_id",
            "port_name", "port_iso3", "flag", classes.flag_group(F.col("flag")).alias("flag_group"),
            "is_fishing", "is_encountered",
            classes.gear_class(F.col("vessel_class"), keep_unknown=True).alias("vessel_class"),
        )
        .distinct()
    )
