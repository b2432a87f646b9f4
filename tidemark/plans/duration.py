"""Port-stop duration by flag group or gear, with random port and gear levels.

The model is a mean per category of one factor plus independent random levels of others,
for the log of the hours. Everything runs on sufficient statistics: stops are reduced to
one row per combination of factors, and those to sums per level and counts per pair of
levels. The numbers of levels (states, gear classes, flag groups) are bounded, so these
tables fit the driver, which sets up the small system of equations once; replicates of the
bootstrap are rows on Spark and are refitted in its tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import classes
from tidemark.plans import policy
from tidemark.session import cut_lineage, ship_package

# More levels than this are no longer categories.
MAX_LEVELS = 5_000
# Their sums are small, so tasks for the replicates' refits are not left to their size.
_REFIT_TASKS = 64


def log_hours(stops: DataFrame, min_minutes: int = 60) -> DataFrame:
    """Stops of at least ``min_minutes`` with the log of their hours."""
    return stops.where(F.col("duration_min") >= min_minutes).withColumn(
        "log_hours", F.log(F.col("duration_min") / F.lit(60.0))
    )


def duration_cells(stops: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Sufficient statistics per combination of factors: n, sum and sum of squares."""
    y = F.col("log_hours")
    return stops.groupBy(*factors).agg(
        F.count(y).alias("n"), F.sum(y).alias("sum_y"), F.sum(y * y).alias("sum_y2")
    )


def _solved(system: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution, the shortest one where it is not unique."""
    try:
        return np.linalg.solve(system, right)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(system, right, rcond=None)[0]


@dataclass(frozen=True)
class Fit:
    """Residual variance, one variance per random factor, and every level's estimate."""

    residual: float
    variances: list[float]
    estimates: list[np.ndarray]


@dataclass(frozen=True)
class CrossedModel:
    """Means of the first factor and random levels of the others, from counts of level pairs.

    ``counts[a][b]`` holds the stops per pair of levels of factors a and b (a <= b).
    """

    factors: list[str]
    levels: list[list]
    counts: list[list[np.ndarray]]
    cells: int

    def sizes(self, factor: int) -> np.ndarray:
        return np.diag(self.counts[factor][factor])

    def pair(self, a: int, b: int) -> np.ndarray:
        return self.counts[a][b] if a <= b else self.counts[b][a].T

    @cached_property
    def moments(self) -> np.ndarray:
        """Expected quadratic forms of the residuals about the fixed means, per unit variance.

        Row 0 is their sum of squares, row k the squares of the level sums of factor k over
        their sizes; column 0 belongs to the residual variance, column k to that of factor k.
        Variances of the fixed means drop out, as the residuals do not contain them.
        """
        fixed, k = self.sizes(0), len(self.factors)
        system = np.zeros((k, k))
        system[0, 0] = fixed.sum() - len(fixed)
        for a in range(1, k):
            own = self.pair(0, a)
            left = self.sizes(a) - (own**2 / fixed[:, None]).sum(axis=0)
            system[0, a] = left.sum()
            system[a, 0] = (left / self.sizes(a)).sum()
            for b in range(1, k):
                other = self.pair(0, b)
                shared = self.pair(a, b) - (own / fixed[:, None]).T @ other
                system[a, b] = (shared**2 / self.sizes(a)[:, None]).sum()
        return system

    def quadratic_forms(self, sums: list[np.ndarray], squares: float) -> np.ndarray:
        means = sums[0] / self.sizes(0)
        forms = [squares - float(sums[0] @ means)]
        for a in range(1, len(self.factors)):
            left = sums[a] - self.pair(0, a).T @ means
            forms.append(float((left**2 / self.sizes(a)).sum()))
        return np.array(forms)

    def fit(self, sums: list[np.ndarray], squares: float) -> Fit:
        """Variances by moments, none below 0, then the mixed-model equations solved for all levels."""
        found = _solved(self.moments, self.quadratic_forms(sums, squares))
        residual, *variances = np.maximum(found, 0.0).tolist()
        used = [0, *(a for a, v in enumerate(variances, 1) if v > 0)]
        rows = []
        for a in used:
            blocks = [self.pair(a, b) for b in used]
            if a:
                at = used.index(a)
                blocks[at] = blocks[at] + np.eye(len(self.levels[a])) * (residual / variances[a - 1])
            rows.append(np.concatenate(blocks, axis=1))
        answer = _solved(np.concatenate(rows), np.concatenate([sums[a] for a in used]))
        estimates, at = [np.zeros(len(names)) for names in self.levels], 0
        for a in used:
            estimates[a] = answer[at:at + len(self.levels[a])]
            at += len(self.levels[a])
        return Fit(residual, variances, estimates)


@dataclass(frozen=True)
class Observed:
    """Sums per level of every factor, and the sum of squares."""

    sums: list[np.ndarray]
    squares: float

def crossed_model(cells: DataFrame, fixed: str, random: Sequence[str]) -> tuple[CrossedModel, Observed, DataFrame]:
    """The model of the cells, what was observed, and the cells themselves, stored."""
    factors = [fixed, *random]
    # Cells with the same levels are one; an empty or incomplete cell is none.
    stored = cut_lineage(
        cells.where("n > 0").na.drop(subset=factors).groupBy(*factors)
        .agg(*(F.sum(c).alias(c) for c in ("n", "sum_y", "sum_y2")))
    )
    n_cells, squares, *known = stored.agg(
        F.count(F.lit(1)), F.sum("sum_y2"), *[F.count_distinct(f) for f in factors]
    ).first()
    if not n_cells:
        raise ValueError("no stops to fit")
    for f, n in zip(factors, known):
        if n > MAX_LEVELS:
            raise ValueError(f"{f} has more than {MAX_LEVELS} levels")
    k = len(factors)
    sets = [(a,) for a in range(k)] + [(a, b) for a in range(k) for b in range(a + 1, k)]
    totals = stored.groupingSets([[F.col(factors[a]) for a in s] for s in sets], *[F.col(f) for f in factors]).agg(
        F.grouping_id().alias("_set"), F.sum("n").alias("_n"), F.sum("sum_y").alias("_s")
    ).collect()
    # The bits of grouping_id() name the columns that were summed over.
    rows: dict[tuple, list] = {s: [] for s in sets}
    number = {(1 << k) - 1 - sum(1 << (k - 1 - a) for a in s): s for s in sets}
    for r in totals:
        own = number[r._set]
        rows[own].append(([r[factors[a]] for a in own], r._n, r._s))
    levels = [sorted(key[0] for key, _, _ in rows[a,]) for a in range(k)]
    places = [{v: i for i, v in enumerate(names)} for names in levels]
    sums = [np.zeros(len(names)) for names in levels]
    square = [[None] * k for _ in range(k)]
    for own in sets:
        pair = np.zeros((len(levels[own[0]]), len(levels[own[-1]])))
        for key, n, s in rows[own]:
            at = [places[a][v] for a, v in zip(own, key)]
            pair[at[0], at[-1]] = n
            if len(own) == 1:
                sums[own[0]][at[0]] = s
        square[own[0]][own[-1]] = pair
    model = CrossedModel(factors, levels, square, n_cells)
    return model, Observed(sums, float(squares)), stored


def adjusted_levels(cells: DataFrame, fixed: str, random: Sequence[str]) -> DataFrame:
    """Mean per category of ``fixed``, adjusted for random levels of ``random``.

    A random level is shrunk by ``n / (n + ratio)``, the ratio being the residual variance
    over the level's, both estimated. Returns ``factor, category, n, estimate`` for all
    factors.
    """
    model, seen, stored = crossed_model(cells, fixed, random)
    fit = model.fit(seen.sums, seen.squares)
    rows = [
        (f, None if v is None else str(v), int(n), float(e))
        for a, f in enumerate(model.factors)
        for v, n, e in zip(model.levels[a], model.sizes(a), fit.estimates[a])
    ]
    return stored.sparkSession.createDataFrame(rows, "factor string, category string, n long, estimate double")


def variance_components(cells: DataFrame, fixed: str, random: Sequence[str]) -> DataFrame:
    """``factor, variance, ratio`` per random factor, and ``residual``.

    Moments: the quadratic forms of :attr:`CrossedModel.moments` are set equal to
    their expectations; a variance below 0 is 0 and has no ratio.
    """
    model, seen, stored = crossed_model(cells, fixed, random)
    fit = model.fit(seen.sums, seen.squares)
    rows = [("residual", fit.residual, 1.0)]
    rows += [(f, v, fit.residual / v if v > 0 else None) for f, v in zip(model.factors[1:], fit.variances)]
    return stored.sparkSession.createDataFrame(rows, "factor string, variance double, ratio double")


def standard_normal(*parts: Column) -> Column:
    """A standard normal number drawn from a hash of the parts; the same on every run."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))

    def uniform(first: int) -> Column:
        return (F.conv(F.substring(digest, first, 8), 16, 10).cast("double") + 1) / F.lit(4294967296.0)

    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(F.lit(2 * np.pi) * uniform(9))


def chi_square(df: int, normal: np.ndarray) -> np.ndarray:
    """Chi-square numbers from normal ones, by the cube that is close to normal."""
    if df <= 0:
        return np.zeros_like(normal)
    return df * np.maximum(1 - 2 / (9 * df) + normal * np.sqrt(2 / (9 * df)), 0) ** 3


def _normals(seed: int, replicate: int, factor: str, names: list) -> np.ndarray:
    """:func:`standard_normal` of (seed, replicate, factor, name) for every name."""
    digests = [md5(f"{seed}|{replicate}|{factor}|{name}".encode()).hexdigest() for name in names]
    u, v = (np.array([int(d[i:i + 8], 16) + 1 for d in digests]) / 4294967296.0 for i in (0, 8))
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)


def _simulated(
    model: CrossedModel, fit: Fit, noise: list[np.ndarray], noise_squares: float, seed: int, replicate: int
) -> tuple[list[np.ndarray], float]:
    """Sums per level and the sum of squares of one replicate, from its cells' residual sums."""
    sigma = np.sqrt(fit.residual)
    effects = [fit.estimates[0]] + [
        np.sqrt(v) * _normals(seed, replicate, f, names)
        for f, v, names in zip(model.factors[1:], fit.variances, model.levels[1:])
    ]
    k = range(len(model.factors))
    plain = [sum(model.pair(a, b) @ effects[b] for b in k) for a in k]
    inside = fit.residual * chi_square(
        int(model.sizes(0).sum()) - model.cells, _normals(seed, replicate, "within", ["cells"])
    )[0]
    squares = sum(
        effects[a] @ plain[a] + 2 * sigma * (effects[a] @ noise[a]) for a in k
    ) + fit.residual * noise_squares + inside
    return [plain[a] + sigma * noise[a] for a in k], float(squares)


def _replicates(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of one replicate after the other, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for first, last in zip(cuts, cuts[1:]):
            if held and first < last and held[0].column(0)[0].as_py() != at[first]:
                yield held
                held = []
            if first < last:
                held.append(batch.slice(first, last - first))
    if held:
        yield held


def bootstrap_intervals(
    cells: DataFrame,
    fixed: str,
    random: Sequence[str],
    *,
    replicates: int = 1000,
    level: float = 0.95,
    seed: int = 0,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Interval of each category's adjusted mean, by data simulated from the fitted model.

    Every replicate draws new random levels and residuals for all cells, and variances and
    means are fitted again; the bounds are percentiles of its means. Cells times replicates
    are rows; their residuals are added up per replicate and level, and each replicate is
    refitted in a task from those sums. ``drop`` leaves categories out of the report only.
    """
    model, seen, stored = crossed_model(cells, fixed, random)
    fit = model.fit(seen.sums, seen.squares)
    spark, factors = stored.sparkSession, model.factors
    ship_package(spark)
    rep = F.col("_replicate")
    # Residual of a cell's sum and its square over the size, in units of the residual deviation.
    names = [F.concat_ws("=", F.lit(f), F.col(f).cast("string")) for f in factors]
    drawn = standard_normal(F.lit(seed), rep, *names)
    noisy = stored.select(
        *factors, "n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_replicate")
    ).withColumn("_z", drawn)
    sets = [["_replicate", f] for f in factors]
    noise = (
        noisy.groupingSets([[F.col(c) for c in s] for s in sets], rep, *[F.col(f) for f in factors])
        .agg(
            F.grouping_id().alias("_set"),
            F.sum(F.sqrt("n") * F.col("_z")).alias("_noise"),
            F.sum(F.col("_z") * F.col("_z")).alias("_squares"),
        )
    )
    # The bits of grouping_id() name the columns that were summed over.
    k = len(factors)
    number = {(1 << k) - 1 - (1 << (k - 1 - a)): a for a in range(k)}
    places = [{v: i for i, v in enumerate(names)} for names in model.levels]

    def refit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for own in _replicates(batches):
            kind = own[0].schema.field(2).type if kind is None else kind
            noise_sums, replicate, noise_squares = [np.zeros(len(names)) for names in model.levels], None, 0.0
            for batch in own:
                columns = [c.to_pylist() for c in batch.columns]
                for replicate, grouped, *keys, value, square in zip(*columns):
                    a = number[grouped]
                    noise_sums[a][places[a][keys[a]]] = value
                    noise_squares += square if a == 0 else 0.0
            again = model.fit(*_simulated(model, fit, noise_sums, noise_squares, seed, replicate))
            yield pa.record_batch(
                [pa.array(model.levels[0], kind), pa.array(again.estimates[0])], names=["category", "mean"]
            )

    kind = stored.schema[fixed].dataType.simpleString()
    means = (
        noise.repartition(min(replicates, _REFIT_TASKS), "_replicate").sortWithinPartitions("_replicate")
        .select("_replicate", "_set", *factors, "_noise", "_squares")
        .mapInArrow(refit, f"category {kind}, mean double")
    )
    tail = (1 - level) / 2
    bounds = means.groupBy("category").agg(
        F.percentile("mean", F.array(F.lit(tail), F.lit(1 - tail))).alias("_q")
    )
    centre = spark.createDataFrame(
        list(zip(model.levels[0], map(float, fit.estimates[0]))), f"category {kind}, mean double"
    )
    report = centre.join(bounds, "category").select(
        "category", "mean", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper")
    )
    return report.where(~F.col("category").isin(list(drop))) if drop else report


@dataclass(frozen=True)
class PortStopStudy:
    """Tables of the study: levels, variances and intervals by flag group and by gear."""

    cells: DataFrame
    by_flag: DataFrame
    by_gear: DataFrame
    flag_variances: DataFrame
    gear_variances: DataFrame
    flag_intervals: DataFrame
    gear_intervals: DataFrame


def foreign_stops(stops: DataFrame, pairs: DataFrame) -> DataFrame:
    """Complete stops in ports of another sovereign, with the flag's group."""
    foreign = policy.foreign_visits(stops, pairs)
    return foreign.withColumn("flag_group", classes.flag_group(F.col("flag")))


def port_stop_study(
    stops: DataFrame,
    pairs: DataFrame,
    *,
    min_minutes: int = 60,
    replicates: int = 1000,
    drop_gear: Sequence[str] = ("driftnets",),
) -> PortStopStudy:
    """From the port-stop table to the adjusted durations and their intervals.

    ``pairs`` maps territories to sovereigns. Flag groups are adjusted for port states and
    gear classes, gear classes for port states; ``drop_gear`` is left out of the report.
    """
    names = ("flag_group", "port_iso3", "vessel_class")
    cells = cut_lineage(duration_cells(log_hours(foreign_stops(stops, pairs), min_minutes), names))
    flag, gear = (names[0], [names[1], names[2]]), (names[2], [names[1]])
    return PortStopStudy(
        cells,
        adjusted_levels(cells, *flag),
        adjusted_levels(cells, *gear),
        variance_components(cells, *flag),
        variance_components(cells, *gear),
        bootstrap_intervals(cells, *flag, replicates=replicates),
        bootstrap_intervals(cells, *gear, replicates=replicates, drop=drop_gear),
    )
