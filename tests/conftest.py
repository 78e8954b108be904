import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# Columns can only be made while a session is active, also at the top of a test module.
SESSION = (
    SparkSession.builder.master("local[4]")
    .appName("inkscore-tests")
    .config("spark.sql.shuffle.partitions", "4")
    .config("spark.driver.memory", "8g")
    .config("spark.ui.enabled", "false")
    .config("spark.ui.showConsoleProgress", "false")
    .config("spark.sql.session.timeZone", "UTC")
    .getOrCreate()
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one column over one row of named values."""

    def run(column, **row):
        types = {str: "string", int: "bigint", float: "double", list: "array<string>"}
        schema = ", ".join(f"{k} {types[type(v)]}" for k, v in row.items()) or "dummy int"
        return spark.createDataFrame([tuple(row.values()) or (0,)], schema).select(column.alias("v")).first()["v"]

    return run
