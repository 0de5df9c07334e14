from __future__ import annotations

import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridpulse.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        configure(SparkSession.builder.master("local[4]").appName("tests"))
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def regular(spark):
    """Build rows (timestamp, machine_id, cpu_usage, memory_usage) at given 5-minute bins."""

    def build(points):
        rows = [
            (START + dt.timedelta(minutes=5 * at), machine, cpu, memory)
            for machine, at, cpu, memory in points
        ]
        return spark.createDataFrame(
            rows,
            "timestamp timestamp_ntz, machine_id string, cpu_usage double, memory_usage double",
        )

    return build
