"""Ordered per-group scans: neighbours, fills and run merging.

``ordered_scan`` is the single place where rows of a group are looked at in order.
Ordinary groups use window functions over one exchange. Groups that
:func:`tidemark.operators.skew.slice_groups` has cut are scanned slice by slice, and a
small table with one row per slice carries values across the seams.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.skew import SLICE
from tidemark.session import cut_lineage


def ordered_scan(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    *,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    fill_forward: Mapping[str, str] | None = None,
    fill_backward: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add columns that look along the rows of each group.

    The mappings are ``{new column: input column}``:

    * ``previous`` / ``following``: value of the neighbouring row, NULL at the ends;
    * ``fill_forward``: last non-NULL value up to and including this row;
    * ``fill_backward``: first non-NULL value from this row on.

    ``order`` lists columns, ascending with NULLs first; end it with enough columns
    to make the order total. A new column may replace an input column.
    """
    wanted = (previous or {}, following or {}, fill_forward or {}, fill_backward or {})
    if SLICE not in df.columns:
        return _scan_in_windows(df, list(key), list(order), wanted)
    plain = _scan_in_windows(df.where(F.col(SLICE) < 0), list(key), list(order), wanted)
    sliced = _scan_in_slices(df.where(F.col(SLICE) >= 0), list(key), list(order), wanted)
    return plain.unionByName(sliced)


def _windows(group: list[str], order: list[str]):
    ascending = Window.partitionBy(*group).orderBy(*order)
    # A backward fill over (current row, unbounded following) costs n^2 per group;
    # over the reversed order it is one running pass.
    reversed_ = Window.partitionBy(*group).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return ascending, reversed_


def _scan_in_windows(df, key, order, wanted) -> DataFrame:
    previous, following, forward, backward = wanted
    ascending, reversed_ = _windows(key, order)
    so_far = ascending.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far_reversed = reversed_.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new: dict[str, Column] = {}
    new.update({o: F.lag(c, 1).over(ascending) for o, c in previous.items()})
    new.update({o: F.lead(c, 1).over(ascending) for o, c in following.items()})
    new.update({o: F.last(c, ignorenulls=True).over(so_far) for o, c in forward.items()})
    new.update({o: F.last(c, ignorenulls=True).over(so_far_reversed) for o, c in backward.items()})
    return df.withColumns(new)


def _scan_in_slices(df, key, order, wanted) -> DataFrame:
    previous, following, forward, backward = wanted
    # Read twice below, for the seams and for the rows.
    rows = cut_lineage(df)
    position = F.struct(*order)
    edges = rows.groupBy(*key, SLICE).agg(
        F.lit(True).alias("_edge"),
        *[F.max_by(F.struct(c), position).alias(f"_p_{o}") for o, c in previous.items()],
        *[F.min_by(F.struct(c), position).alias(f"_n_{o}") for o, c in following.items()],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_f_{o}") for o, c in forward.items()],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_b_{o}") for o, c in backward.items()],
    )
    # One row per slice (two where a key starts inside one): a bounded group.
    along = Window.partitionBy(*key).orderBy(SLICE)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    after = along.rowsBetween(1, Window.unboundedFollowing)
    carry = edges.select(
        *[F.col(k).alias(f"_k_{k}") for k in key],
        F.col(SLICE).alias("_k_slice"),
        *[F.lag(f"_p_{o}").over(along)[c].alias(f"_p_{o}") for o, c in previous.items()],
        *[F.lead(f"_n_{o}").over(along)[c].alias(f"_n_{o}") for o, c in following.items()],
        *[F.last(f"_f_{o}", ignorenulls=True).over(before).alias(f"_f_{o}") for o in forward],
        *[F.first(f"_b_{o}", ignorenulls=True).over(after).alias(f"_b_{o}") for o in backward],
    )
    local = [*key, SLICE]
    ascending, reversed_ = _windows(local, order)
    so_far = ascending.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far_reversed = reversed_.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = rows.withColumns(
        {
            "_at_start": F.row_number().over(ascending) == 1,
            "_at_end": F.row_number().over(reversed_) == 1,
            **{f"_lp_{o}": F.lag(c, 1).over(ascending) for o, c in previous.items()},
            **{f"_ln_{o}": F.lead(c, 1).over(ascending) for o, c in following.items()},
            **{f"_lf_{o}": F.last(c, ignorenulls=True).over(so_far) for o, c in forward.items()},
            **{f"_lb_{o}": F.last(c, ignorenulls=True).over(so_far_reversed) for o, c in backward.items()},
        }
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]
    joined = scanned.join(carry, [*same, F.col(SLICE) == F.col("_k_slice")], "left")
    new: dict[str, Column] = {}
    for o in previous:
        new[o] = F.when(F.col("_at_start"), F.col(f"_p_{o}")).otherwise(F.col(f"_lp_{o}"))
    for o in following:
        new[o] = F.when(F.col("_at_end"), F.col(f"_n_{o}")).otherwise(F.col(f"_ln_{o}"))
    for o in forward:
        new[o] = F.coalesce(f"_lf_{o}", f"_f_{o}")
    for o in backward:
        new[o] = F.coalesce(f"_lb_{o}", f"_b_{o}")
    out = [c for c in df.columns if c not in new] + list(new)
    return joined.withColumns(new).select(*out)


def merge_runs(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    *,
    start: str,
    end: str,
    glued: str,
    first: Sequence[str],
    last: Sequence[str],
    last_by: Sequence[str],
) -> DataFrame:
    """Glue each row with ``glued`` true to the row after it, one row per run.

    A run starts where the previous row was not glued and ends at the first row
    that is not glued; a missing bound is taken from the nearest row that has one,
    backwards for starts and forwards for ends, and stays NULL if none has. Columns
    ``first`` come from the earliest row of the run by ``order``, columns ``last``
    from the latest row by ``last_by``.
    """
    flagged = ordered_scan(df, key, order, previous={"_glued_before": glued})
    bounded = flagged.withColumns(
        {
            "_from": F.when(F.col("_glued_before"), F.lit(None)).otherwise(F.col(start)),
            "_to": F.when(F.col(glued), F.lit(None)).otherwise(F.col(end)),
        }
    )
    filled = ordered_scan(
        bounded, key, order, fill_forward={"_from": "_from"}, fill_backward={"_to": "_to"}
    )
    runs = filled.groupBy(*key, "_from", "_to").agg(
        F.min_by(F.struct(*first), F.struct(*order)).alias("_first"),
        F.max_by(F.struct(*last), F.struct(*last_by)).alias("_last"),
        # A run that spans slices belongs to the slice of its first row.
        *[F.min(SLICE).alias(SLICE) for _ in [SLICE] if SLICE in df.columns],
    )
    return runs.select(
        *key, F.col("_from").alias(start), F.col("_to").alias(end), "_first.*", "_last.*",
        *[c for c in [SLICE] if c in df.columns],
    )
