import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from atril.session import ship_package

    s = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column function over rows of plain values."""

    def run(fn, rows, schema):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
        cols = [F.col(c) for c in df.columns[1:]]
        return [r[0] for r in df.orderBy("i").select(fn(*cols).alias("x")).collect()]

    return run
