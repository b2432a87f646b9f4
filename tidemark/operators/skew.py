"""Cutting groups too large for one task into slices.

Window functions send a whole group to one task. A chain of scans therefore asks once
which groups are large and cuts those into slices by their order; the scans in
:mod:`tidemark.operators.sequences` work on slices where there are any. Joins and
aggregates need no such step: aggregates combine map-side, and adaptive execution
splits a skewed join partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, rows_per_group, rows_per_slice

# Number of the slice a row belongs to; -1 in groups that are not cut.
SLICE = "_slice"


def large_groups(
    df: DataFrame, key: Sequence[str], limit: int | None = None, weight: Column | None = None
) -> DataFrame:
    """The keys with more than ``limit`` rows and their counts (``_rows``).

    ``weight`` is the number of rows a row of ``df`` stands for.
    """
    limit = limit or rows_per_group(df.sparkSession)
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*key).agg(rows.alias("_rows")).where(F.col("_rows") > limit)


def slice_groups(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    limit: int | None = None,
    slice_rows: int | None = None,
    counted: DataFrame | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """``df`` with column ``_slice`` if any group by ``key`` has more than ``limit`` rows.

    Slices have about ``slice_rows`` rows, half the limit by default.

    The groups are counted in ``counted`` if given: a table that ``df`` was worked out
    from, with the same keys and, by ``weight``, at least as many rows per group. So the
    chain behind ``df`` is not evaluated for the count, only a scan of the keys.

    The large keys stay a table: rows find theirs by a join, and only the number of
    slices reaches the driver. Rows of large groups are range-partitioned once by (key,
    order); the checkpoint fixes which row is in which slice, also after a
    recomputation. Scans that follow keep the slices.
    """
    limit = limit or rows_per_group(df.sparkSession)
    large = large_groups(df if counted is None else counted, key, limit, weight)
    rows = large.agg(F.sum("_rows")).first()[0]
    if not rows:
        return df
    large = cut_lineage(large)
    slices = max(2, -(-rows // (slice_rows or rows_per_slice(df.sparkSession, limit))))
    named = large.select(*[F.col(k).alias(f"_large_{k}") for k in key], F.lit(True).alias("_large"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_large_{k}")) for k in key))
    tagged = df.join(named, same, "left")
    plain = tagged.where(F.col("_large").isNull()).select(*df.columns, F.lit(-1).alias(SLICE))
    cut = (
        tagged.where(F.col("_large"))
        .select(*df.columns)
        .repartitionByRange(slices, *key, *order)
        .withColumn(SLICE, F.spark_partition_id())
    )
    return plain.unionByName(cut_lineage(cut))
