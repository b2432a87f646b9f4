"""Vessel identity: quality filters and attributes by year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import classes


def gear_buoys(vessel_info: DataFrame) -> DataFrame:
    """Vessel ids whose usual ship name looks like a gear buoy."""
    name = F.col("ais_identity.shipname_mostcommon.value")
    return vessel_info.where(classes.is_gear_name(name)).select("ssvid")


def frequent_names(names: Column, min_reports: int = 10) -> Column:
    """How many distinct names reach ``min_reports`` reports in ``array<(value, count)>``.

    The array is sorted by name and read once, adding up runs of one name, so the
    rule needs no shuffle and stays near-linear in the array.
    """
    known = F.array_sort(
        F.transform(
            F.filter(names, lambda x: x["value"].isNotNull()),
            lambda x: F.struct(x["value"].alias("value"), x["count"].cast("long").alias("count")),
        )
    )

    def closed(state: Column) -> Column:
        return state["n"] + F.when(state["total"] >= min_reports, 1).otherwise(0)

    def step(state: Column, x: Column) -> Column:
        same = state["name"].eqNullSafe(x["value"])
        count = F.coalesce(x["count"], F.lit(0).cast("long"))
        return F.struct(
            x["value"].alias("name"),
            F.when(same, state["total"] + count).otherwise(count).alias("total"),
            F.when(same, state["n"]).otherwise(closed(state)).alias("n"),
        )

    start = F.struct(
        F.lit(None).cast("string").alias("name"),
        F.lit(0).cast("long").alias("total"),
        F.lit(0).alias("n"),
    )
    total = F.aggregate(known, start, step, closed)
    return F.coalesce(total, F.lit(0))


def _no_overlap(df: DataFrame) -> DataFrame:
    names = F.col("activity.overlap_hours_multinames")
    return df.where((names == 0) | names.isNull())


# Rule name -> filter on the vessel-year table. Fixed thresholds.
RULES = {
    "on_list": lambda df: df.where(F.col("on_fishing_list_best")),
    "one_name_at_a_time": _no_overlap,
    "overlap_below_3_days": lambda df: df.where(F.col("activity.overlap_hours") < 72),
    "not_offsetting": lambda df: df.where(F.col("activity.offsetting").eqNullSafe(False)),
    "few_names": lambda df: df.where(frequent_names(F.col("ais_identity.n_shipname")) <= 5),
    "class_inferred": lambda df: df.where(F.col("inferred.inferred_vessel_class_byyear").isNotNull()),
    "fished_over_24_h": lambda df: df.where(F.col("activity.fishing_hours") > 24),
    "active_over_120_h": lambda df: df.where(F.col("activity.active_hours") > 120),
}
LIGHT_RULES = ("one_name_at_a_time", "overlap_below_3_days", "not_offsetting", "few_names")


def quality_vessel_years(
    by_year: DataFrame,
    bad_vessels: DataFrame,
    gear: DataFrame | None = None,
    rules: Sequence[str] = tuple(RULES),
) -> DataFrame:
    """Vessel-years that pass the rules, are no gear and not on the manual list.

    ``bad_vessels`` holds arrays of ids. The light form passes ``rules=LIGHT_RULES``
    and no ``gear``.
    """
    kept = by_year
    for rule in rules:
        kept = RULES[rule](kept)
    kept = kept.select(
        "ssvid", "year", F.col("best.best_vessel_class").alias("geartype"),
        F.col("best.best_flag").alias("flag"),
    )
    if gear is not None:
        kept = kept.join(gear.where(F.col("ssvid").isNotNull()), "ssvid", "left_anti")
    listed = bad_vessels.select(F.explode("ssvid").alias("_bad")).where("_bad is not null")
    return kept.join(listed, F.col("ssvid").cast("long") == F.col("_bad"), "left_anti")


def offset_vessels(segments: DataFrame) -> DataFrame:
    """Vessels whose positions lie far from where satellites saw them."""
    return (
        segments.where((F.col("dist_avg_pos_sat_vessel_km") > 3000) & (F.col("sat_positions_known") > 5))
        .groupBy("ssvid")
        .agg(F.sum("positions").alias("positions"))
    )


def good_vessels(vessel_years: DataFrame, offset: DataFrame) -> DataFrame:
    """Quality vessel-years without the offsetting vessels."""
    listed = offset.select("ssvid").where(F.col("ssvid").isNotNull())
    return vessel_years.join(listed, "ssvid", "left_anti")


def restrict_to_vessel_years(df: DataFrame, good: DataFrame) -> DataFrame:
    """Rows whose (ssvid, year) is a good vessel-year."""
    return df.join(good.select("ssvid", "year").distinct(), ["ssvid", "year"], "left_semi")


def attributes_by_year(by_year: DataFrame, *, squid_rows: str = "any") -> DataFrame:
    """Flag, class and fishing flag per vessel-year.

    A pole-and-line vessel registered as squid jigger counts as squid jigger.
    ``squid_rows="any"`` tests whether any registry class says so and gives one row;
    ``"each"`` tests every registry class by itself, so a vessel with several
    classes can get two rows.
    """
    pole = F.col("inferred.inferred_vessel_class_ag") == "pole_and_line"
    registered = F.col("registry_info.best_known_vessel_class")
    if squid_rows == "each":
        rows = by_year.withColumn("_registered", F.explode_outer(registered))
        squid = pole & (F.col("_registered") == "squid_jigger")
    elif squid_rows == "any":
        rows = by_year
        squid = pole & F.exists(registered, lambda x: x == "squid_jigger")
    else:
        raise ValueError(f"squid_rows must be 'any' or 'each', not {squid_rows!r}")
    # Dealt first: copies meet in a partition, so no reading task keeps all its distinct rows.
    return rows.select(
        "ssvid", "year",
        classes.resolved_flag(F.col("best.best_flag"), F.col("ais_identity.flag_mmsi")).alias("flag"),
        F.when(squid, "squid_jigger").otherwise(F.col("best.best_vessel_class")).alias("vessel_class"),
        F.col("on_fishing_list_best").alias("is_fishing"),
    ).repartition("ssvid", "year").distinct()


def vessels_in_every_year(by_year: DataFrame, years: Sequence[int]) -> DataFrame:
    """Vessels present in all of ``years``."""
    present = [by_year.where(F.col("year") == y).select("ssvid") for y in years]
    kept = present[0].distinct() if len(present) == 1 else present[0]
    for other in present[1:]:
        kept = kept.intersect(other)
    return kept


def resolve_identity(
    df: DataFrame, vessel_daily: DataFrame, day: str, how: str = "inner", more: Sequence[str] = ()
) -> DataFrame:
    """Add ``ssvid`` (and ``more``) by (vessel_id, day). Repeated identity rows are collapsed first.

    They are dealt by (vessel_id, day), which serves that and the join.
    """
    identity = vessel_daily.select("vessel_id", F.col("day").alias(day), "ssvid", *more)
    identity = identity.repartition("vessel_id", day).distinct()
    return df.join(identity, ["vessel_id", day], how)
