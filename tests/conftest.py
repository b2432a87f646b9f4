import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_groups(spark):
    """Treat every group of more than 3 rows as too large for one task."""
    from tidemark.session import ROWS_PER_GROUP, ROWS_PER_SLICE

    spark.conf.set(ROWS_PER_GROUP, "3")
    spark.conf.set(ROWS_PER_SLICE, "100")
    yield
    spark.conf.unset(ROWS_PER_GROUP)
    spark.conf.unset(ROWS_PER_SLICE)
