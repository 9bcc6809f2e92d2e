import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.log.level", "ERROR")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Values of a column function over a list of rows."""

    def run(function, rows, schema="a string"):
        frame = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
        out = function(*[F.col(c) for c in frame.columns])
        return [r[0] for r in frame.coalesce(1).select(out.alias("out")).collect()]

    return run
