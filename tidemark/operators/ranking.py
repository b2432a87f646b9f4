"""Running sums and exact quantiles without gathering a column in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import cut_lineage

# Values of one interval that may be sorted together.
MOST = 10_000
# Points of the sketch an interval is narrowed by, and its accuracy.
_GRID, _ACCURACY = 100, 2_000
# Open ranks that every task may hold; the values then stay where they are.
_HELD = 10_000


def running_sums(df: DataFrame, key: str, value: Column, *, descending: bool = False) -> tuple[DataFrame, object]:
    """``key, rows, step, running`` per distinct key, and the sum over all.

    ``step`` is the sum of ``value`` over the key's rows and ``running`` the sum up to and
    with the key, so equal keys share it. Distinct keys are dealt into ranges by their
    order, each range is summed alone, and the ranges before it are added; only one sum per
    range reaches the driver. NULL keys and values are left out of the sums; a NULL key has
    no row.
    """
    steps = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(value), F.lit(0)).alias("step")
    )
    order = F.col(key).desc() if descending else F.col(key).asc()
    # The borders of the ranges are sampled, so they are fixed before anything is added up.
    ranged = cut_lineage(steps.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    sums = {r[0]: r[1] for r in ranged.groupBy("_range").agg(F.sum("step")).collect()}
    before, total = [], 0
    for number in sorted(sums):
        before.append((number, total))
        total += sums[number]
    if not before:
        return ranged.select(key, "rows", "step", F.col("step").alias("running")), total
    kind = ranged.agg(F.sum("step").alias("s")).schema["s"].dataType.simpleString()
    # 0 + Decimal stays a Decimal; the first offset takes the type of the rest.
    start = type(total)(0)
    offsets = df.sparkSession.createDataFrame([(n, t if t else start) for n, t in before], f"_range int, _before {kind}")
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_inside", F.sum("step").over(inside)).join(offsets, "_range")
    return placed.select(key, "rows", "step", (F.col("_before") + F.col("_inside")).alias("running")), total


def exact_quantiles(
    df: DataFrame, column: str, probabilities: Sequence[float], by: Sequence[str] = (), *, most: int = MOST
) -> DataFrame:
    """``by..., n, quantiles`` per group: exact quantiles, interpolated between neighbours.

    Selection by narrowing: every wanted rank has an open interval of values that holds it.
    A sketch of the values inside proposes two of them as tighter borders; exact counts
    below and at the borders then tell on which side the rank lies, or that a border is the
    answer. So a wrong sketch costs a round and never a wrong result, and values that repeat
    leave the interval. Intervals with at most ``most`` values are sorted. No task holds
    more than that or a sketch; nothing but a number of open ranks reaches the driver.

    NULL and NaN are left out; a group without values has no row.
    """
    if not probabilities or not all(0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities must lie between 0 and 1")
    keys = [f"_g{i}" for i in range(len(by))] or ["_g0"]
    groups = [F.col(c).alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias("_g0")]
    v = F.col(column).cast("double")
    # The rounds read this narrow table, not what it was worked out from.
    values = cut_lineage(df.select(*groups, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")))
    counts = cut_lineage(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in probabilities]
    low = [F.floor(a) for a in at]
    high = [F.least(a + 1, F.col("n") - 1) for a in low]
    nothing = F.lit(None).cast("double")
    ranks = cut_lineage(
        counts.select(*keys, "n", F.explode(F.array_distinct(F.array(*low, *high))).alias("k")).select(
            *keys, "k", nothing.alias("lo"), nothing.alias("hi"), F.lit(0).cast("long").alias("below"),
            F.col("n").alias("inside"), nothing.alias("answer"),
        )
    )
    while left := ranks.where("answer is null").count():
        ranks = cut_lineage(_narrowed(values, ranks, keys, most, left <= _HELD))
    found = ranks.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "answer"))).alias("_at"))
    joined = counts.alias("c").join(found.alias("f"), _same("c", "f", keys))
    parts = []
    for a, l, h in zip(at, low, high):
        first, second = F.element_at("_at", l), F.element_at("_at", h)
        parts.append(first + (second - first) * (a - l))
    return joined.select(
        *[F.col(f"c.{k}").alias(c) for k, c in zip(keys, by)], "n", F.array(*parts).alias("quantiles")
    )


def _same(a: str, b: str, columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _narrowed(values: DataFrame, ranks: DataFrame, keys: list[str], most: int, held: bool = False) -> DataFrame:
    """One round: ranks with an answer, or a smaller interval.

    With ``held`` the open ranks go to every task: a few groups would else be dealt to as
    many tasks, each sorting all values of its group for the join.
    """
    given = F.broadcast if held else lambda df: df
    done, open_ = ranks.where("answer is not null"), ranks.where("answer is null")
    interval = [*keys, "lo", "hi"]
    within = (F.col("i.lo").isNull() | (F.col("_v") > F.col("i.lo"))) & (F.col("i.hi").isNull() | (F.col("_v") < F.col("i.hi")))
    intervals = open_.select(*interval, "inside").distinct()
    rows = values.alias("v").join(given(intervals).alias("i"), _same("v", "i", keys) & within).select(
        *[F.col(f"i.{c}") for c in interval], "inside", "_v"
    )
    few = F.col("inside") <= most
    grid = [i / _GRID for i in range(_GRID + 1)]
    sketched = rows.groupBy(*interval).agg(
        F.sort_array(F.collect_list(F.when(few, F.col("_v")))).alias("sorted"),
        F.percentile_approx(F.when(~few, F.col("_v")), grid, _ACCURACY).alias("points"),
    )
    told = open_.alias("o").join(sketched.alias("s"), _same("o", "s", interval)).select("o.*", "sorted", "points")
    place = F.col("k") - F.col("below")
    at = F.floor(place / F.col("inside") * _GRID).cast("int")
    told = told.withColumns(
        {
            "answer": F.when(F.size("sorted") > 0, F.try_element_at("sorted", (place + 1).cast("int"))),
            "a": F.try_element_at("points", F.greatest(at, F.lit(1))),
            "b": F.try_element_at("points", F.least(at + 3, F.lit(_GRID + 1))),
        }
    )
    sorted_ = told.where("answer is not null").select(*ranks.columns)
    big = cut_lineage(told.where("answer is null").drop("sorted", "points", "answer"))
    counted = (
        values.alias("v").join(given(big).alias("i"), _same("v", "i", keys) & within)
        .groupBy(*[F.col(f"i.{c}") for c in big.columns])
        .agg(
            *(F.count(F.when(test, 1)).alias(name) for name, test in (
                ("under_a", F.col("_v") < F.col("a")), ("upto_a", F.col("_v") <= F.col("a")),
                ("under_b", F.col("_v") < F.col("b")), ("upto_b", F.col("_v") <= F.col("b")),
            ))
        )
    )
    left = place < F.col("under_a")
    is_a = ~left & (place < F.col("upto_a"))
    middle = ~left & ~is_a & (place < F.col("under_b"))
    is_b = ~left & ~is_a & ~middle & (place < F.col("upto_b"))
    moved = counted.select(
        *keys, "k",
        F.when(left, F.col("lo")).when(middle, F.col("a")).otherwise(F.col("b")).alias("lo"),
        F.when(left, F.col("a")).when(middle, F.col("b")).otherwise(F.col("hi")).alias("hi"),
        (F.col("below") + F.when(left, 0).when(middle, F.col("upto_a")).otherwise(F.col("upto_b"))).alias("below"),
        F.when(left, F.col("under_a")).when(middle, F.col("under_b") - F.col("upto_a"))
        .otherwise(F.col("inside") - F.col("upto_b")).alias("inside"),
        F.when(is_a, F.col("a")).when(is_b, F.col("b")).alias("answer"),
    )
    return done.unionByName(sorted_).unionByName(moved)
