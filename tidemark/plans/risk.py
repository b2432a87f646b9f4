"""Port risk scores of trips: observed, imputed, classified."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import classes
from tidemark.plans import boosting
from tidemark.session import stored

FACTORS = ("flag_group", "vessel_class", "time_at_sea")
CATEGORIES: dict[str, Sequence[str]] = {
    "flag_group": classes.FLAG_GROUP_NAMES,
    "vessel_class": classes.GEAR_CLASS_NAMES,
    "time_at_sea": classes.TIME_AT_SEA_NAMES,
}
CARRIER_FACTORS = ("carrier_flag_group", "neighbor_flag_group", "time_at_sea", "neighbor_vessel_class")


def vote_columns(risk: str, carrier_style: bool = False) -> list[str]:
    """Arrival vote columns in the order none, low, medium, high."""
    if risk not in ("iuu", "la"):
        raise ValueError(f"risk must be 'iuu' or 'la', not {risk!r}")
    levels = ("no", "low", "med", "high")
    return [f"to_{risk}_{v}" if carrier_style else f"{risk}_{v}_to" for v in levels]


def complete_trips(trips: DataFrame, columns: Sequence[str] = FACTORS) -> DataFrame:
    """Trips with a value, neither NULL nor empty, in every column."""
    for c in columns:
        trips = trips.where(F.col(c).isNotNull() & (F.col(c) != ""))
    return trips


def has_votes(risk: str = "iuu", *, null_votes: str = "zero", carrier_style: bool = False) -> Column:
    """Did the arrival port get votes? Never NULL.

    ``null_votes="zero"`` counts a missing vote as none; with ``"propagate"`` a trip
    with any missing vote has none.
    """
    votes = [F.col(c) for c in vote_columns(risk, carrier_style)]
    if null_votes == "zero":
        total = sum((F.coalesce(v, F.lit(0)) for v in votes), F.lit(0))
    elif null_votes == "propagate":
        total = sum(votes, F.lit(0))
    else:
        raise ValueError(f"null_votes must be 'zero' or 'propagate', not {null_votes!r}")
    return F.coalesce(total > 0, F.lit(False))


def observed_trips(
    trips: DataFrame, risk: str = "iuu", *, null_votes: str = "zero", carrier_style: bool = False
) -> DataFrame:
    """Trips whose arrival port got votes, with ``risk_score``."""
    votes = [F.col(c) for c in vote_columns(risk, carrier_style)]
    kept = trips.where(has_votes(risk, null_votes=null_votes, carrier_style=carrier_style))
    return kept.withColumn("risk_score", classes.risk_score(*votes))


def one_hot(df: DataFrame, categories: Mapping[str, Sequence[str]] = CATEGORIES) -> DataFrame:
    """Indicator columns ``<column>_<category>`` for fixed category lists."""
    return df.withColumns(
        {
            f"{c}_{v}": F.coalesce((F.col(c) == v).cast("int"), F.lit(0))
            for c, values in categories.items()
            for v in values
        }
    )


def carrier_design(encounters: DataFrame, loitering: DataFrame) -> DataFrame:
    """One row per carrier trip: own classes, everyone met, loitering, votes.

    ``encounters`` is the carrier-trip feature table; rows lacking a class are left
    out. A trip's own values come from its earliest encounter, first value that is
    not NULL per column. ``with_*`` tells whether any encounter had that class.
    """
    rows = complete_trips(encounters, CARRIER_FACTORS)
    position = F.struct("event_start", "event_end", "neighbor_ssvid", "lon_mean", "lat_mean")
    votes = [c for r in ("iuu", "la") for c in vote_columns(r, True)]

    def first(c: str):
        return F.min_by(c, F.when(F.col(c).isNotNull(), position)).alias(c)

    def met(c: str, v: str):
        return F.max((F.col(c) == v).cast("int")).alias(f"with_{v}")

    trips = rows.groupBy("trip_id").agg(
        *[first(c) for c in ("time_at_sea", "carrier_flag_group", *votes)],
        *[met("neighbor_flag_group", v) for v in classes.FLAG_GROUP_NAMES],
        *[met("neighbor_vessel_class", v) for v in classes.GEAR_CLASS_NAMES],
    )
    loitered = loitering.where(F.col("ssvid").isNotNull()).select("trip_id").distinct()
    return (
        one_hot(
            trips,
            {"time_at_sea": classes.TIME_AT_SEA_NAMES, "carrier_flag_group": classes.FLAG_GROUP_NAMES},
        )
        .join(loitered.withColumn("loitering", F.lit(1)), "trip_id", "left")
        .fillna(0, ["loitering"])
        .withColumn("no_loitering", 1 - F.col("loitering"))
    )


def carrier_factors(design: DataFrame) -> DataFrame:
    """Carrier trips with five categorical factors, and the 0/1 columns behind them.

    The classes met are joined into one signature per kind, e.g. ``china+group1``.
    """

    def signature(names: Sequence[str]):
        present = F.array_compact(
            F.array(*[F.when(F.col(f"with_{v}") == 1, F.lit(v)) for v in names])
        )
        return F.array_join(present, "+")

    return design.select(
        "trip_id",
        F.col("time_at_sea").alias("is_tas"),
        F.col("carrier_flag_group").alias("is_flag"),
        signature(classes.FLAG_GROUP_NAMES).alias("with_flag"),
        signature(classes.GEAR_CLASS_NAMES).alias("with_gear"),
        F.when(F.col("loitering") == 1, "loitering").otherwise("no_loitering").alias("loitering"),
        F.col("loitering").alias("any_loitering"),
        *[c for c in CARRIER_COLUMNS if c != "any_loitering"],
        *[c for r in ("iuu", "la") for c in vote_columns(r, True)],
    )


# 0/1 columns of a carrier trip: own time at sea and flag, classes met, loitering.
CARRIER_COLUMNS = (
    *(f"time_at_sea_{v}" for v in classes.TIME_AT_SEA_NAMES),
    *(f"carrier_flag_group_{v}" for v in classes.FLAG_GROUP_NAMES),
    *(f"with_{v}" for v in (*classes.FLAG_GROUP_NAMES, *classes.GEAR_CLASS_NAMES)),
    "any_loitering", "no_loitering",
)
CARRIER_DESIGN = ("is_tas", "is_flag", "with_flag", "with_gear", "loitering")


def carrier_scores(
    encounters: DataFrame, loitering: DataFrame, risk: str = "iuu", impute=None
) -> DataFrame:
    """Carrier trips with observed or imputed scores and their class.

    A trip is observed if its arrival port has every vote and some vote. ``impute``
    takes (rest, observed) and returns the rest with ``risk_score``; by default the
    mean of the observed trips most alike.
    """
    # Read by every level of the imputation and by both parts of the result. Columns of few
    # values take little room by column.
    other = vote_columns("la" if risk == "iuu" else "iuu", True)
    trips = stored(carrier_factors(carrier_design(encounters, loitering)).drop(*other))
    voted = has_votes(risk, null_votes="propagate", carrier_style=True)
    observed = observed_trips(trips, risk, null_votes="propagate", carrier_style=True)
    if impute is None:
        predicted = impute_cell_mean(trips.where(~voted), observed, CARRIER_DESIGN)
    else:
        predicted = impute(trips.where(~voted), observed)
    return scored_trips(observed, predicted, ("trip_id", "risk_score"))


def unobserved(trips: DataFrame, observed: DataFrame, key: Sequence[str] = ("trip_id",)) -> DataFrame:
    """Trips that are not in the observed set."""
    return trips.join(observed.select(*key).distinct(), list(key), "left_anti")


def seen_classes(trips: DataFrame, observed: DataFrame, column: str = "vessel_class") -> DataFrame:
    """Trips whose class occurs in the observed set."""
    return trips.join(observed.select(column).distinct(), column, "left_semi")


def impute_cell_mean(
    trips: DataFrame, observed: DataFrame, factors: Sequence[str] = FACTORS, score: str = "risk_score"
) -> DataFrame:
    """Score each trip by the mean of the observed trips most like it.

    The mean over all factors if such trips were observed, else over all but the
    last factor, and so on to the overall mean. One rollup of partial sums yields
    every level.
    """
    factors = list(factors)
    levels = observed.rollup(*factors).agg(
        F.avg(score).alias("_mean"), F.grouping_id().alias("_level")
    )
    out = trips
    for depth in range(len(factors), 0, -1):
        names = factors[:depth]
        # Bounded by the category counts.
        at_level = levels.where(F.col("_level") == (1 << (len(factors) - depth)) - 1).select(
            *names, F.col("_mean").alias(f"_m{depth}")
        )
        out = out.join(at_level, names, "left")
    overall = levels.where(F.col("_level") == (1 << len(factors)) - 1).select("_mean").scalar()
    means = [f"_m{d}" for d in range(len(factors), 0, -1)]
    return out.withColumn(score, F.coalesce(*means, overall)).drop(*means)


def impute_boosted(
    trips: DataFrame,
    observed: DataFrame,
    factors: Sequence[str] = FACTORS,
    score: str = "risk_score",
    *,
    columns: Sequence[str] = (),
    rate: float = 0.05,
    trees: int = 100,
    depth: int = 10,
    column_share: float = 0.6,
    penalty: float = 1.0,
    seed: int = 0,
) -> DataFrame:
    """Score trips by boosted regression trees.

    The trees split on one 0/1 column per observed category of ``factors`` and on the 0/1
    ``columns``; a trip with a category or a combination never observed is scored by the
    rest of its columns. Each tree draws its share of the columns. Carrier trips are scored
    with ``factors=(), columns=CARRIER_COLUMNS, rate=0.01, trees=300``.
    """
    flags = [F.col(c) == 1 for c in columns]
    for f in factors:
        # Bounded by the categories of the factor.
        seen = observed.where(F.col(f).isNotNull()).select(f).distinct().orderBy(f).limit(boosting.MAX_COLUMNS + 1)
        flags += [F.col(f) == r[0] for r in seen.collect()]
    params = boosting.BoostParams(rate, trees, depth, column_share, penalty, seed=seed)
    forest = boosting.fit(observed, flags, score, params)
    return trips.withColumn(score, boosting.predicted(forest, flags))


def imputation_tables(
    trips: DataFrame, risk: str = "iuu", impute=impute_boosted, key: Sequence[str] = ("trip_id", "ssvid", "trip_start", "trip_end")
) -> dict[str, DataFrame]:
    """Observed, in-sample and predicted-only tables of the imputed risk, with classes.

    ``observed`` holds what was seen, ``in_sample`` what the model says of the same trips,
    ``predicted`` the trips without votes, ``error`` one row: trips, root mean squared error
    and share of trips put in their own class, all in-sample.
    """
    complete = complete_trips(trips)
    observed = observed_trips(complete, risk)
    rest = seen_classes(complete.where(~has_votes(risk)), observed)
    shown = [*key, "risk_score"]
    scored = observed.where(F.col("risk_score").isNotNull())
    known = scored.withColumn("_truth", F.col("risk_score"))
    again = with_class(impute(known, scored))
    return {
        "observed": with_class(observed.select(*shown)),
        "in_sample": again.select(*shown, "risk_class"),
        "predicted": with_class(impute(rest, scored).select(*shown)),
        "error": imputation_error(again.select(F.col("_truth").alias("truth"), F.col("risk_score").alias("guess"))),
    }


def imputation_error(pairs: DataFrame) -> DataFrame:
    """n, rmse and class_share of pairs (truth, guess)."""
    off = F.col("truth") - F.col("guess")
    same = (classes.risk_class(F.col("truth")) == classes.risk_class(F.col("guess"))).cast("double")
    return pairs.agg(F.count(off).alias("n"), F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(same).alias("class_share"))


def scored_trips(
    observed: DataFrame,
    predicted: DataFrame,
    columns: Sequence[str] = ("trip_id", "ssvid", "trip_start", "trip_end", "risk_score"),
) -> DataFrame:
    """Observed and predicted trips in one table with ``type`` and ``risk_class``."""
    both = predicted.select(*columns).withColumn("type", F.lit("pred")).unionByName(
        observed.select(*columns).withColumn("type", F.lit("obs"))
    )
    return with_class(both)


def with_class(df: DataFrame, score: str = "risk_score") -> DataFrame:
    return df.withColumn("risk_class", classes.risk_class(F.col(score)))


def risk_table(trips: DataFrame, risk: str = "iuu", impute=impute_cell_mean) -> DataFrame:
    """Fishing trips with observed or imputed scores and their class.

    Scores are imputed for trips whose gear class was observed.
    """
    complete = complete_trips(trips)
    observed = observed_trips(complete, risk)
    # A trip tells by itself whether it was observed, so no join sets the rest apart.
    rest = seen_classes(complete.where(~has_votes(risk)), observed)
    return scored_trips(observed, impute(rest, observed))


def map_points(encounters: DataFrame, loitering: DataFrame, scores: DataFrame) -> DataFrame:
    """Encounter and loitering points with the risk of their trip."""
    known = scores.select("trip_id", "risk_score").where(F.col("risk_score").isNotNull())
    points = encounters.select("trip_id", "lon_mean", "lat_mean").unionByName(
        loitering.select("trip_id", "lon_mean", "lat_mean")
    )
    return with_class(points.join(known, "trip_id").drop("trip_id"))
