"""Exact deduplication by content hash with a byte comparison inside the groups.

Method: group by a 128-bit hash of the normalised text, keep the smallest id, compare
bytes inside each group. The comparison is part of the grouping: the text itself is a
grouping key beside its hash, so two texts with one hash stay two classes. Copies are
combined in every map task before they are shuffled, so a class that holds a third of
all rows sends one row per task. Rows then find their class by hash and SHA-256; this
join moves no texts.

Defined results: a null text counts as empty; a null id is larger than every id, and a
class without any id keeps one row under a null id; of rows that repeat both id and
text one is kept; an empty table gives an empty table; further columns, also with
names used here, pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import packed, whole_text

# Blank runs that are not yet a single space.
UNEVEN_BLANKS = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"


def normalised(text: Column) -> Column:
    """Every run of blanks as one space; null as the empty text."""
    return F.regexp_replace(whole_text(text), UNEVEN_BLANKS, " ")


def md5_128(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def _hashed(df: DataFrame, content_hash: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn("hash", content_hash(F.col("norm"))).withColumn(
        "sha", F.unhex(F.sha2("norm", 256))
    )


def content_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """One row per distinct normalised text: hash, sha, keep_id, group_size."""
    keyed = _hashed(
        docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")),
        content_hash,
    )
    return (
        keyed.groupBy("hash", "sha", "norm")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .drop("norm")
    )


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    classes = content_classes(docs, id_col, text_col, content_hash)
    rows = (
        _hashed(
            docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")),
            content_hash,
        )
        .groupBy("id", "hash", "sha")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    return (
        rows.join(classes, ["hash", "sha"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged."""
    classes = content_classes(docs, id_col, text_col).select("hash", "sha", "keep_id")
    rows = _hashed(
        packed(
            docs, F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")
        ),
        md5_128,
    ).drop("norm")
    first = Window.partitionBy("hash", "sha").orderBy("id")
    return (
        rows.join(classes, ["hash", "sha"])
        .where(F.col("id").eqNullSafe(F.col("keep_id")))
        .withColumn("nth", F.row_number().over(first))
        .where(F.col("nth") == 1)
        .select("row.*")
    )
