import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("spanlake-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
               # Keep range partitions apart so that split scans really cross chunk borders.
               .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
               .config("spark.driver.memory", "4g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def spans(spark):
    """Build a span table from {(run, episode): [(start, end[, label]), ...]}."""
    def build(table):
        rows = [(run, ep, i, float(s[0]), float(s[1]), s[2] if len(s) > 2 else "x")
                for (run, ep), items in table.items() for i, s in enumerate(items)]
        return spark.createDataFrame(rows, "run string, episode_id string, idx long, start_s double, end_s double, label string")
    return build
