"""Table and CSV readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD = "dt"


def read_table(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: str | None = None
) -> DataFrame:
    """A parquet table, optionally with a declared schema and a choice of columns."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    return df if columns is None else df.select(*columns)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Materialise a result as parquet and return the stored table."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_bucketed(
    df: DataFrame, name: str, path: str, by: Sequence[str], order: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Store ``df`` under ``path`` as table ``name`` in buckets of ``by``, each bucket one sorted file."""
    spark = df.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt like the buckets, so that a bucket is written by one task.
    dealt = df.repartition(count, *by)
    dealt.write.mode("errorifexists").option("path", path).bucketBy(count, *by).sortBy(*(order or by)).saveAsTable(name)
    return spark.table(name)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: texts and nested values by their length, others by their width."""
    total = F.lit(0).cast("long")
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = F.octet_length(c)
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            size = F.octet_length(F.to_json(F.struct(c)))
        else:
            size = F.lit(8)
        total = total + F.coalesce(size, F.lit(0))
    return total


def write_sharded(
    df: DataFrame, path: str, time: str, files: int | None = None, file_bytes: int = 128 << 20
) -> None:
    """Write one partition ``dt=YYYYMMDD`` per day of a timestamp column.

    A day goes to at most ``files`` tasks, and so has at most that many files; without
    ``files`` to as many as its own bytes fill at ``file_bytes`` each (:func:`row_bytes`,
    before encoding), so a large day never lands in one task.
    """
    sharded = df.withColumn(SHARD, F.date_format(time, "yyyyMMdd"))
    # Maps have no hash of their own.
    values = [F.col(f"`{f.name}`") for f in df.schema.fields]
    spread = F.xxhash64(
        *[F.to_json(F.struct(c)) if isinstance(f.dataType, T.MapType) else c for f, c in zip(df.schema.fields, values)]
    )
    if files is None:
        sizes = sharded.groupBy(SHARD).agg(F.ceil(F.sum(row_bytes(df)) / F.lit(file_bytes)).alias("_files"))
        # One row per day.
        sharded = sharded.join(sizes.withColumnRenamed(SHARD, "_day"), F.col(SHARD).eqNullSafe(F.col("_day")), "left")
        part = F.pmod(spread, F.greatest("_files", F.lit(1)))
    else:
        part = F.pmod(spread, F.lit(files))
    dealt = sharded.repartition(SHARD, part).select(*df.columns, SHARD)
    dealt.write.mode("errorifexists").partitionBy(SHARD).parquet(path)


def in_shards(df: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """The rows of shards ``first`` to ``last`` (``YYYYMMDD``, inclusive); all without bounds."""
    if first is None and last is None:
        return df
    if SHARD not in df.columns:
        raise ValueError(f"a shard range needs a table with the column {SHARD!r}")
    if first is not None:
        df = df.where(F.col(SHARD) >= first)
    if last is not None:
        df = df.where(F.col(SHARD) <= last)
    return df


def read_sharded(
    spark: SparkSession,
    path: str,
    first: str | None = None,
    last: str | None = None,
    schema: str | None = None,
) -> DataFrame:
    """A date-sharded table, from shard ``first`` to ``last`` (``YYYYMMDD``, inclusive).

    The range is a filter on the partition column, so other shards are not listed
    or read. A missing bound leaves that side open.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    # Shard names are strings, as they compare; read as numbers, each test of one would be a cast.
    named = [T.StructField(f.name, T.StringType()) if f.name == SHARD else f for f in df.schema]
    return in_shards(spark.read.schema(T.StructType(named)).parquet(path), first, last)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str,
    *,
    trim: bool = True,
    numbers: Sequence[str] = (),
    blank_is_null: bool = True,
) -> DataFrame:
    """A CSV with header and declared columns.

    Columns are taken by position, so a byte-order mark in the header does no harm.
    Quoted empty strings and missing values are told apart unless ``blank_is_null``.
    ``numbers`` are cast to double and may be in scientific notation.
    """
    declared = T.StructType.fromDDL(schema)
    df = (
        spark.read.schema(declared)
        .option("header", True)
        .option("enforceSchema", True)
        .option("emptyValue", "")
        .option("nullValue", None)
        .csv(path)
    )
    for field in declared.fields:
        if isinstance(field.dataType, T.StringType):
            value = F.trim(field.name) if trim else F.col(field.name)
            df = df.withColumn(field.name, F.nullif(value, F.lit("")) if blank_is_null else value)
    return df.withColumns({c: F.col(c).cast("double") for c in numbers})


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with header; times in ISO form, empty strings quoted."""
    df.write.mode("errorifexists").option("header", True).option("emptyValue", '""').option(
        "nullValue", ""
    ).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)


def drop_blank_rows(df: DataFrame, *, required: Sequence[str] = ()) -> DataFrame:
    """Rows with at least one value, and a value (not blank) in every required column."""
    kept = df.na.drop("all")
    for c in required:
        kept = kept.where(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    return kept


def append_rows(df: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    """Add literal rows, in the column order of ``df``, to a lookup table."""
    if not rows:
        return df
    return df.unionByName(df.sparkSession.createDataFrame(list(rows), df.schema))
