"""Session helpers: runtime settings the plans rely on, and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# A group with more rows than this is processed in slices instead of one task.
ROWS_PER_GROUP = "tidemark.rowsPerGroup"
ROWS_PER_GROUP_DEFAULT = 2_000_000
# Rows of a slice; half of the above unless set.
ROWS_PER_SLICE = "tidemark.rowsPerSlice"


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the plans assume (all may be changed in a live session)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Rows of few distinct values shrink tenfold and more in a shuffle; joining partitions up to
    # the usual 64 MB makes tasks of some GB that spill.
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
    # A hot join key is split even where that costs one more exchange downstream.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # Rows dealt by vessel are not dealt again for a join by vessel and something else.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def rows_per_group(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_GROUP, str(ROWS_PER_GROUP_DEFAULT)))


def rows_per_slice(spark: SparkSession, limit: int) -> int:
    return int(spark.conf.get(ROWS_PER_SLICE, str(max(1, limit // 2))))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    A folder of this machine is used only by a local session that names none.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="tidemark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps.

    Spark removes them once the driver has collected the plans that made them, which may be long
    after the rows are stored elsewhere. A small job comes first, since Spark holds on to its last.
    """
    spark.range(0, 1, 1, 1).collect()
    spark.sparkContext._jvm.System.gc()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: fixes the rows and survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` worked out once, as a table by columns in the shared folder."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)
