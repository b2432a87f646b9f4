"""Shuffle files of stored steps go."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from tidemark.session import stored


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_stored_rows_leave_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    rows = stored(spark.range(50_000).withColumn("x", F.col("id") % 7).repartition(5, "x"))
    for _ in range(60):
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.25)
    assert not left
    assert rows.agg(F.sum("id")).first()[0] == 50_000 * 49_999 // 2
