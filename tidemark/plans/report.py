"""Readable tables from attribution results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Category -> name in reports, per class of factor.
FLAG_LABELS = {
    "china": "China",
    "group1": "Flag group 1",
    "group2": "Flag group 2",
    "group3": "Flag group 3",
    "other": "Other",
}
GEAR_LABELS = {
    "set_longline": "Set longline",
    "drifting_longline": "Drifting longline",
    "purse_seine": "Purse seine",
    "squid_jigger": "Squid jigger",
    "pole_and_line": "Pole and line",
    "trawlers": "Trawler",
    "trollers": "Troller",
    "pots_and_traps": "Pots and traps",
    "set_gillnet": "Set gillnet",
    "driftnets": "Driftnet",
}
TIME_LABELS = {
    "less_than_1m": "< 1 month",
    "1_3m": "1-3 months",
    "3_6m": "3-6 months",
    "6_12m": "6-12 months",
    "12m_and_more": "> 12 months",
}
# Factor -> name in reports; other factors are only capitalised.
FACTOR_LABELS = {"tas": "Time at sea", "gear": "Gear type"}


def _lookup(value: Column, labels: dict[str, str]) -> Column:
    branch = F
    for raw, name in labels.items():
        branch = branch.when(value == raw, name)
    return branch


def category_label(category: Column) -> Column:
    """Readable name of a flag group, gear class or time bucket, else the text itself."""
    plain = F.replace(category, F.lit("_"), F.lit(" "))
    return F.coalesce(_lookup(category, {**FLAG_LABELS, **GEAR_LABELS, **TIME_LABELS}), plain)


def term_label(term: Column) -> Column:
    """``flag x gear`` -> ``Flag × Gear type``; also accepts ``('flag', 'gear')``."""
    bare = F.regexp_replace(term, r"[()']", "")
    parts = F.array_distinct(F.transform(F.split(bare, r"\s*,\s*|\s+x\s+"), lambda x: F.trim(x)))

    def name(x: Column) -> Column:
        capital = F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))
        return F.coalesce(_lookup(x, FACTOR_LABELS), capital)

    return F.array_join(F.transform(parts, name), " × ")


def importance_report(importance: DataFrame) -> DataFrame:
    """Importance with readable terms, smallest mean first."""
    return importance.withColumn("var_name", term_label(F.col("term"))).orderBy("mean", "var_name")


def _class_of(label: Column) -> Column:
    return F.when(label.isin(list(GEAR_LABELS.values())), "gear").when(
        label.isin(list(FLAG_LABELS.values())), "flag"
    )


def solo_report(solo: DataFrame) -> DataFrame:
    """Flag and gear effects with readable names, gear first, by mean."""
    named = solo.withColumn("var1", category_label(F.col("category")))
    return (
        named.withColumn("class", _class_of(F.col("var1")))
        .where(F.col("class").isNotNull())
        .select("var1", "class", "mean", "sd", "se", "lower", "upper")
        .orderBy(F.desc("class"), "mean", "var1")
    )


def combination_report(combinations: DataFrame, solo: DataFrame) -> DataFrame:
    """Gear x flag effects, gear first, followed by the flags alone."""
    first, second = category_label(F.col("category1")), category_label(F.col("category2"))
    named = combinations.withColumns({"_a": first, "_b": second})
    flags = list(FLAG_LABELS.values())
    swapped = F.col("_a").isin(flags)
    oriented = named.withColumns(
        {
            "var1": F.when(swapped, F.col("_b")).otherwise(F.col("_a")),
            "var2": F.when(swapped, F.col("_a")).otherwise(F.col("_b")),
        }
    )
    pairs = oriented.where(F.col("var2").isin(flags)).withColumn("class", _class_of(F.col("var1")))
    alone = solo_report(solo).where(F.col("class") == "flag").withColumn("var2", F.lit(None).cast("string"))
    columns = ["var1", "var2", "class", "mean", "sd", "se", "lower", "upper"]
    return (
        pairs.where(F.col("class").isNotNull())
        .select(*columns)
        .unionByName(alone.select(*columns))
        .orderBy("class", "mean", "var1", "var2")
    )
