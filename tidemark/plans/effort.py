"""Fishing effort by cell and risk class, and its density map."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.geo import cell_area_km2, degree_bin
from tidemark.operators.intervals import contained_in
from tidemark.operators.ranking import exact_quantiles
from tidemark.session import cut_lineage


def good_segments(segments: DataFrame) -> DataFrame:
    """Segments of good quality with more than 10 positions."""
    return segments.where(
        F.col("good_seg") & (F.col("positions") > 10) & ~F.col("overlapping_and_short")
    ).select("seg_id")


def fishing_positions(positions: DataFrame, segments: DataFrame) -> DataFrame:
    """Positions on good segments; hours count only where the score says fishing."""
    hours = F.when(F.col("nnet_score2") > 0.5, F.col("hours")).otherwise(F.lit(0.0))
    return positions.join(good_segments(segments), "seg_id", "left_semi").select(
        "ssvid", "timestamp", "lat", "lon", hours.alias("fishing_hours")
    )


def positions_in_trips(fishing: DataFrame, trip_risk: DataFrame) -> DataFrame:
    """Positions inside a scored trip of the vessel, bounds included."""
    trips = trip_risk.select(
        F.col("ssvid").cast("string").alias("ssvid"), "trip_start", "trip_end", "risk_class"
    )
    return contained_in(
        fishing, trips, ["ssvid"], at="timestamp", start="trip_start", end="trip_end", bucket="day"
    )


def effort_grid(positions: DataFrame, segments: DataFrame, trip_risk: DataFrame) -> DataFrame:
    """Fishing hours per one-degree cell and risk class."""
    inside = positions_in_trips(fishing_positions(positions, segments), trip_risk)
    return inside.groupBy(
        degree_bin(F.col("lat")).alias("lat_bin"), degree_bin(F.col("lon")).alias("lon_bin"), "risk_class"
    ).agg(F.sum("fishing_hours").alias("fishing_hours"))


def with_area(effort: DataFrame, size: float = 1.0) -> DataFrame:
    """Cell area and hours per square kilometre."""
    return effort.withColumn("km2", cell_area_km2(F.col("lat_bin"), size)).withColumn(
        "fishing_hours_km2", F.try_divide("fishing_hours", "km2")
    )


def scaled_effort(effort: DataFrame) -> DataFrame:
    """Hours per km2 scaled to 0..1 within each risk class (NULL where all are equal)."""
    # A class has at most one row per cell of the world, so the window is bounded.
    cls = Window.partitionBy("risk_class")
    value = F.col("fishing_hours_km2")
    low, high = F.min(value).over(cls), F.max(value).over(cls)
    return effort.withColumn("scaled", F.try_divide(value - low, high - low))


def _kernel(offset: Column, width: float) -> Column:
    x = offset / width
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def density_map(
    cells: DataFrame,
    *,
    weight: str = "scaled",
    bandwidth: float = 5.0,
    points: int = 361,
    lon_range: tuple[float, float] = (-180.0, 180.0),
    lat_range: tuple[float, float] = (-90.0, 90.0),
) -> DataFrame:
    """Weighted Gaussian density per risk class on a ``points`` x ``points`` grid.

    The kernel is a product, so the sum runs over longitudes first, to one value
    per (grid longitude, cell latitude), and over latitudes second. Work is bounded
    by cells x points, not cells x points^2. The grid index is generated per row.
    """
    width = bandwidth / 4
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))

    def at(index: str, bounds: tuple[float, float]) -> Column:
        return F.lit(bounds[0]) + F.col(index) * ((bounds[1] - bounds[0]) / (points - 1))

    # One row per cell position and class, whatever the input repeats.
    merged = (
        cells.where(F.col(weight).isNotNull())
        .groupBy("risk_class", "lat_bin", "lon_bin")
        .agg(F.sum(weight).alias("_w"))
    )
    # Weights become shares of their class here, where a class has at most one row
    # per cell of the world; the map is then one lineage over the cells.
    cls = Window.partitionBy("risk_class")
    shared = merged.withColumn("_w", F.try_divide("_w", F.sum("_w").over(cls)))
    # Each row grows ``points``-fold after its exchange, so the number of partitions
    # is set rather than derived from the few bytes before it. Both sums then run
    # without a further exchange, as their keys contain the partitioning columns.
    spread = cells.sparkSession.sparkContext.defaultParallelism
    by_lon = (
        shared.repartition(spread, "risk_class", "lat_bin")
        .withColumn("gx", grid)
        .withColumn("_p", F.col("_w") * _kernel(at("gx", lon_range) - F.col("lon_bin"), width))
        .groupBy("risk_class", "gx", "lat_bin")
        .agg(F.sum("_p").alias("_p"))
    )
    by_both = (
        by_lon.repartition(spread, "risk_class", "gx")
        .withColumn("gy", grid)
        .withColumn("_q", F.col("_p") * _kernel(at("gy", lat_range) - F.col("lat_bin"), width))
        .groupBy("risk_class", "gx", "gy")
        .agg(F.sum("_q").alias("_q"))
    )
    return by_both.select(
        "risk_class", "gx", "gy",
        at("gx", lon_range).alias("lon"), at("gy", lat_range).alias("lat"),
        (F.col("_q") / (width * width)).alias("density"),
    )


def dense_region(density: DataFrame, share: float = 0.95) -> DataFrame:
    """Grid points whose density exceeds the class's quantile (linear interpolation)."""
    density = cut_lineage(density)
    cut = exact_quantiles(density, "density", [share], ["risk_class"]).select(
        "risk_class", F.col("quantiles")[0].alias("threshold")
    )
    return density.join(cut, "risk_class").where(F.col("density") > F.col("threshold")).select(*density.columns, "threshold")
