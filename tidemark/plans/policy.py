"""Before/after study of port visits under a port-state policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import classes
from tidemark.operators.ranking import running_sums

# Gear classes of the study, in the spelling of the port-visit table.
FISHING_GEAR = (
    "trollers", "trawlers", "squid_jigger", "set_longlines", "set_gillnets",
    "purse_seine", "pots_and_traps", "pole_and_line", "driftnets", "drifting_longlines",
)
OTHER_CLASSES = ("bunker", "cargo", "specialized_reefer", "tanker")

# Corrections of the party lists, (added, removed) per year of entry.
COHORT_CORRECTIONS = {2016: (["DNK"], []), 2017: (["GRL", "FRO"], ["DNK"])}

# Territories missing from the zone table; the shorter list has the first two.
TERRITORY_ADDITIONS = (("MAC", "CHN"), ("HKG", "CHN"), ("MYT", "FRA"), ("ALA", "FIN"))


def policy_parties(countries: DataFrame) -> DataFrame:
    """Party states with their day of entry; blank, aggregate and undated rows go."""
    return (
        countries.na.drop("all")
        .where((F.col("country") != "European Union") & F.col("entry_date").isNotNull())
        .select("iso3", F.to_date("entry_date").alias("entry_date"))
    )


def policy_cohort(
    parties: DataFrame,
    year: int,
    corrections: tuple[Sequence[str], Sequence[str]] | None = None,
) -> DataFrame:
    """States whose entry falls in ``year``, with the manual corrections."""
    added, removed = COHORT_CORRECTIONS.get(year, ([], [])) if corrections is None else corrections
    entered = parties.where(
        (F.col("entry_date") >= F.make_date(F.lit(year), F.lit(1), F.lit(1)))
        & (F.col("entry_date") < F.make_date(F.lit(year + 1), F.lit(1), F.lit(1)))
        & ~F.col("iso3").isin(list(removed))
    ).select("iso3")
    if added:
        more = parties.sparkSession.createDataFrame([(x,) for x in added], "iso3 string")
        entered = entered.unionByName(more)
    return entered.distinct()


def sovereign_pairs(
    zones: DataFrame, additions: Sequence[tuple[str, str]] = TERRITORY_ADDITIONS, position: str | None = None
) -> DataFrame:
    """Territory -> sovereign. Of several sovereigns the last one counts, additions last.

    ``position`` orders the rows of the zone table; without it the order is by name.
    """
    place = F.col(position).cast("long") if position else F.lit(0).cast("long")
    known = (
        zones.where(
            (F.col("eez_type") == "200NM") & (F.col("territory1_iso3") != F.col("sovereign1_iso3"))
        )
        .groupBy("territory1_iso3", "sovereign1_iso3")
        .agg(F.min(place).alias("_position"))
    )
    more = zones.sparkSession.createDataFrame(
        [(t, s, (1 << 62) + i) for i, (t, s) in enumerate(additions)],
        "territory1_iso3 string, sovereign1_iso3 string, _position long",
    )
    return (
        known.unionByName(more)
        .groupBy(F.col("territory1_iso3").alias("territory"))
        .agg(F.max_by("sovereign1_iso3", F.struct("_position", "sovereign1_iso3")).alias("sovereign"))
    )


def with_sovereigns(
    visits: DataFrame, pairs: DataFrame, columns: Sequence[str] = ("flag", "port_iso3")
) -> DataFrame:
    """Add ``<column>_sovereign``: the sovereign of a territory, else the state itself."""
    for c in columns:
        role = pairs.select(F.col("territory").alias(c), F.col("sovereign").alias("_sovereign"))
        visits = (
            visits.join(role, c, "left")
            .withColumn(f"{c}_sovereign", F.coalesce("_sovereign", c))
            .drop("_sovereign")
        )
    return visits


def foreign_visits(visits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Visits by vessels whose sovereign is not that of the port; NULL states drop out."""
    complete = visits.where("flag is not null and port_iso3 is not null and vessel_class is not null")
    return with_sovereigns(complete, pairs).where(
        F.col("port_iso3_sovereign") != F.col("flag_sovereign")
    )


def without_ports(visits: DataFrame, states: DataFrame) -> DataFrame:
    """Visits but those to ports of ``states`` (iso3), before any mapping to sovereigns."""
    return visits.join(states.select(F.col("iso3").alias("port_iso3")), "port_iso3", "left_anti")


def select_cohort(visits: DataFrame, name: str) -> DataFrame:
    """Visits of one vessel class, of all fishing gear, or of one flag group."""
    if name in FISHING_GEAR or name in OTHER_CLASSES:
        return visits.where(F.col("vessel_class") == name)
    fishing = visits.where(F.col("vessel_class").isin(list(FISHING_GEAR)))
    if name == "fishing_gear":
        return fishing
    if name in classes.FLAG_GROUP_NAMES:
        return fishing.where(F.col("flag_group") == name)
    raise ValueError(f"unknown cohort {name!r}")


def visit_panel(
    visits: DataFrame, treated: DataFrame, before: int = 2015, after: int = 2017
) -> DataFrame:
    """Visits per (year, port state) with policy and period flags, ports in both years."""
    # Both counts of a port are taken in one pass, so the visits are read once.
    def count(year: int):
        return F.count(F.when(F.col("year") == year, F.col("start_timestamp")))

    def seen(year: int):
        return F.max(F.col("year") == year)

    ports = (
        visits.where(F.col("year").isin(before, after))
        .groupBy("port_iso3")
        .agg(
            *[count(y).alias(f"_n{i}") for i, y in enumerate((before, after))],
            *[seen(y).alias(f"_s{i}") for i, y in enumerate((before, after))],
        )
        .where("_s0 and _s1")
    )
    flags = treated.select(F.col("iso3").alias("port_iso3"), F.lit(1).alias("policy")).distinct()
    periods = F.array(
        *[
            F.struct(F.lit(y).alias("year"), F.col(f"_n{i}").alias("n_visits"), F.lit(i).alias("after"))
            for i, y in enumerate((before, after))
        ]
    )
    return (
        ports.join(flags, "port_iso3", "left")
        .fillna(0, ["policy"])
        .select("port_iso3", "policy", F.inline(periods))
        .select("year", "port_iso3", "n_visits", "policy", "after")
    )


def trim_small_ports(panel: DataFrame, share: float = 0.95) -> DataFrame:
    """Drop every port with a count below the cut of the cumulative share.

    Counts are added up from the largest; the cut is the first count whose running
    share passes ``share``, and equal counts share a step.
    """
    running, total = running_sums(panel, "n_visits", F.col("n_visits"), descending=True)
    past = running.where(F.col("running") > F.lit(share) * F.lit(total))
    cut = past.agg(F.max("n_visits")).first()[0]
    if cut is None:
        return panel
    small = panel.where(F.col("n_visits") < F.lit(cut)).select("port_iso3").distinct()
    return panel.join(small, "port_iso3", "left_anti").select(*panel.columns)


def policy_effect(panel: DataFrame) -> DataFrame:
    """Coefficients of ``1 + policy * after`` for log visits, with random port levels.

    On a balanced panel the port levels cancel in each port's own difference, so
    the effect is the difference of mean differences and its standard error comes
    from the differences of the ports.
    """
    # Scaling by the largest count only shifts the intercept, so it is applied there.
    y = F.log(F.col("n_visits"))
    ports = panel.groupBy("port_iso3", "policy").agg(
        F.max(F.when(F.col("after") == 0, y)).alias("_y0"),
        F.max(F.when(F.col("after") == 1, y)).alias("_y1"),
    ).withColumn("_d", F.col("_y1") - F.col("_y0"))
    arms = ports.groupBy("policy").agg(
        F.count("_d").alias("n"), F.avg("_y0").alias("y0"), F.avg("_d").alias("d"),
        F.var_samp("_y0").alias("v0"), F.var_samp("_d").alias("vd"),
        F.max(F.greatest("_y0", "_y1")).alias("top"),
    )

    def arm(c: str, policy: int):
        return F.max(F.when(F.col("policy") == policy, F.col(c)))

    wide = arms.agg(
        F.max("top").alias("top"),
        *[arm(c, p).alias(f"{c}_{p}") for c in ("n", "y0", "d", "v0", "vd") for p in (0, 1)],
    )

    def se(v: str, *policies: int):
        return F.sqrt(sum((F.col(f"{v}_{p}") / F.col(f"n_{p}") for p in policies), F.lit(0.0)))

    terms = [
        ("intercept", F.col("y0_0") - F.col("top"), se("v0", 0)),
        ("policy", F.col("y0_1") - F.col("y0_0"), se("v0", 0, 1)),
        ("after", F.col("d_0"), se("vd", 0)),
        ("policy:after", F.col("d_1") - F.col("d_0"), se("vd", 0, 1)),
    ]
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(t).alias("term"), e.alias("estimate"), s.alias("std_error"))
                    for t, e, s in terms
                ]
            )
        )
    )


def policy_study(
    visits: DataFrame,
    parties: DataFrame,
    pairs: DataFrame,
    cohort: str = "fishing_gear",
    years: tuple[int, int] = (2015, 2017),
    treated_year: int = 2016,
    excluded_year: int = 2017,
) -> DataFrame:
    """The study from port visits to the trimmed panel.

    States that joined in ``treated_year`` are the treated ones; those that joined in
    ``excluded_year`` are neither treated nor controls and leave the data first.
    """
    kept = without_ports(visits, policy_cohort(parties, excluded_year))
    chosen = select_cohort(foreign_visits(kept, pairs), cohort)
    return trim_small_ports(visit_panel(chosen, policy_cohort(parties, treated_year), *years))
