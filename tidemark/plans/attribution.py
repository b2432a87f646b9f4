"""Attribution of a score to categorical factors, with pairwise interactions.

The value of a set of factors for a row is the mean score of all rows that agree
with it on those factors. Main effects and interactions are the Shapley values and
Shapley interaction indices of that game. Every row of one combination of
categories (a *cell*) has the same terms, so all work is on cells with row counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def factor_cells(rows: DataFrame, factors: Sequence[str], score: str) -> DataFrame:
    """Distinct combinations of the factors with row count ``n`` and ``total`` score."""
    return rows.groupBy(*factors).agg(F.count(score).alias("n"), F.sum(score).alias("total"))


def _subset_key(mask: Column, factors: Sequence[str]) -> Column:
    """The factor values of the chosen subset; a struct, so NULL values compare equal."""
    chosen = [
        F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.col(f)).alias(f) for i, f in enumerate(factors)
    ]
    return F.struct(mask.alias("mask"), *chosen)


def subset_means(cells: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Add ``v``: map from subset mask (bit i = factor i) to the mean over agreeing rows."""
    masks = F.explode(F.sequence(F.lit(0), F.lit((1 << len(factors)) - 1)))
    keyed = cells.withColumn("_mask", masks).withColumn("_key", _subset_key(F.col("_mask"), factors))
    means = keyed.groupBy("_key").agg((F.sum("total") / F.sum("n")).alias("_v"))
    return (
        keyed.join(means, "_key")
        .groupBy(*factors)
        .agg(
            F.first("n").alias("n"),
            F.first("total").alias("total"),
            F.map_from_entries(F.collect_list(F.struct("_mask", "_v"))).alias("v"),
        )
    )


def term_name(a: str, b: str | None = None) -> str:
    return a if b is None or a == b else f"{a} x {b}"


def attribution_terms(cells: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Cells with one column per term: each factor, and each pair as ``a x b``.

    A pair term is half the interaction index, as it appears on either side of the
    diagonal. Mains plus twice the pair terms equal the cell mean minus ``base``.
    """
    k = len(factors)
    with_means = subset_means(cells, factors)

    def v(mask: int) -> Column:
        return F.col("v")[F.lit(mask)]

    def subsets(rest: Sequence[int]):
        for size in range(len(rest) + 1):
            for chosen in combinations(rest, size):
                yield size, sum(1 << i for i in chosen)

    def total(parts) -> Column:
        parts = list(parts)
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    pairs: dict[tuple[int, int], Column] = {}
    for i, j in combinations(range(k), 2):
        rest = [x for x in range(k) if x not in (i, j)]
        a, b = 1 << i, 1 << j
        pairs[i, j] = total(
            (v(s | a | b) - v(s | a) - v(s | b) + v(s))
            * (factorial(size) * factorial(k - size - 2) / factorial(k - 1) / 2)
            for size, s in subsets(rest)
        )
    shapley = {
        i: total(
            (v(s | (1 << i)) - v(s)) * (factorial(size) * factorial(k - size - 1) / factorial(k))
            for size, s in subsets([x for x in range(k) if x != i])
        )
        for i in range(k)
    }
    named = with_means.select(
        *factors, "n", v(0).alias("base"), v((1 << k) - 1).alias("cell_mean"),
        *[col.alias(f"_phi_{i}") for i, col in shapley.items()],
        *[col.alias(term_name(factors[i], factors[j])) for (i, j), col in pairs.items()],
    )
    # A main effect carries the factor's own name, so the factor moves to "<factor>_value".
    mains = []
    for i, f in enumerate(factors):
        shared = [F.col(f"`{term_name(factors[x], factors[y])}`") for x, y in pairs if i in (x, y)]
        mains.append((F.col(f"_phi_{i}") - total(shared) if shared else F.col(f"_phi_{i}")).alias(f))
    return named.select(
        *[F.col(f).alias(f"{f}_value") for f in factors], "n", "base", "cell_mean",
        *mains,
        *[F.col(f"`{term_name(factors[i], factors[j])}`") for i, j in pairs],
    )


def _long(terms: DataFrame, factors: Sequence[str]) -> DataFrame:
    names = [*factors, *[term_name(a, b) for a, b in combinations(factors, 2)]]
    return terms.select(
        "n",
        F.explode(
            F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"`{t}`").alias("value")) for t in names])
        ).alias("_t"),
    ).select("n", "_t.*")


def _summary(value: str, ddof: int) -> list[Column]:
    """Weighted mean, sd, standard error and quantiles over rows counted by ``n``."""
    rows = F.sum("n")
    mean = F.sum(F.col(value) * F.col("n")) / rows
    squares = F.sum(F.col(value) * F.col(value) * F.col("n")) - rows * mean * mean
    spread = F.greatest(squares, F.lit(0.0))
    quantiles = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)), F.col("n"))
    return [
        rows.alias("rows"),
        mean.alias("mean"),
        F.sqrt(F.try_divide(spread, rows - ddof)).alias("sd"),
        F.sqrt(F.try_divide(F.try_divide(spread, rows - 1), rows)).alias("se"),
        quantiles[0].alias("lower"),
        quantiles[1].alias("upper"),
    ]


def importance(terms: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Mean size of each term over all rows, with sd (n-1), standard error and quantiles."""
    sized = _long(terms, factors).withColumn("_abs", F.abs("value"))
    return sized.groupBy("term").agg(*_summary("_abs", 1)).drop("rows")


def _effects(present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summary per category; a category of a single row is dropped. sd over n."""
    return (
        present.groupBy(*keys)
        .agg(*_summary("_value", 0), F.first("base").alias("_base"))
        .where("rows > 1")
        .withColumns({c: F.col(c) + F.col("_base") for c in ("mean", "lower", "upper")})
        .drop("_base")
    )


def _categories(value: Column, split: str | None) -> Column:
    """The categories present in a factor value; signatures hold several."""
    if split is None:
        return F.array(value)
    return F.split(value, f"[{split}]")


def solo_effects(
    terms: DataFrame, factors: Sequence[str], *, signatures: Sequence[str] = ()
) -> DataFrame:
    """Effect of each category where present: its factor's main term plus the base.

    ``signatures`` names factors whose values join several categories with ``+``.
    """

    def entries(f: str) -> Column:
        present = _categories(F.col(f"{f}_value"), "+" if f in signatures else None)
        return F.transform(
            present,
            lambda c: F.struct(F.lit(f).alias("factor"), c.alias("category"), F.col(f).alias("_value")),
        )

    present = [entries(f) for f in factors]
    rows = terms.select("n", "base", F.explode(F.concat(*present)).alias("_p")).select("n", "base", "_p.*")
    return _effects(rows.where(F.col("category").isNotNull()), ["factor", "category"])


def combination_effects(
    terms: DataFrame, factors: Sequence[str], *, signatures: Sequence[str] = ()
) -> DataFrame:
    """Joint effect of two categories of different factors, where both are present.

    Both main terms and twice their pair term, plus the base.
    """

    def entries(a: str, b: str) -> Column:
        value = F.col(a) + F.col(b) + 2 * F.col(f"`{term_name(a, b)}`")
        left = _categories(F.col(f"{a}_value"), "+" if a in signatures else None)
        right = _categories(F.col(f"{b}_value"), "+" if b in signatures else None)

        def with_right(x: Column) -> Column:
            return F.transform(
                right,
                lambda y: F.struct(
                    F.lit(a).alias("factor1"), x.alias("category1"),
                    F.lit(b).alias("factor2"), y.alias("category2"),
                    value.alias("_value"),
                ),
            )

        return F.flatten(F.transform(left, with_right))

    sets = [entries(a, b) for a, b in combinations(factors, 2)]
    rows = terms.select("n", "base", F.explode(F.concat(*sets)).alias("_p")).select("n", "base", "_p.*")
    known = rows.where(F.col("category1").isNotNull() & F.col("category2").isNotNull())
    return _effects(known, ["factor1", "category1", "factor2", "category2"])
