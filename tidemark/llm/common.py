"""Column expressions and table helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path, ship_package

# Characters that separate words: space and the controls 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def whole_text(text: Column) -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def text_key(*columns: Column) -> Column:
    """128-bit key of the columns' values; null and empty differ."""
    marked = [
        F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in columns
    ]
    return F.unhex(F.md5(F.concat(*marked)))


def packed(df: DataFrame, *extra: Column) -> DataFrame:
    """Every row as one struct ``row``, so that no further column can clash with its own."""
    return df.select(F.struct("*").alias("row"), *extra)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; from here on Python workers have this package."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
