"""DataFrames to files and tables."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions.text import file_slug
from tallyweave.runtime import delete_path, folder_names


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, replacing what is there."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Columnar files, replacing what is there."""
    df.write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, name: str, table_format: str = "parquet") -> None:
    """Managed table, replacing one of that name. Delta needs its own jar."""
    df.write.format(table_format).mode("overwrite").saveAsTable(name)


def write_json(df: DataFrame, path: str) -> None:
    """All records as JSON lines, NULL fields written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json_per_person(df: DataFrame, path: str, person: str) -> None:
    """One folder of JSON records per person, named by slug.

    The rebalance gathers a person's records into few files, and splits a person
    who has very many over several.
    """
    slugged = df.withColumn("slug", file_slug(F.col(person)))
    (
        slugged.hint("rebalance", "slug")
        .write.mode("overwrite")
        .option("ignoreNullFields", False)
        .partitionBy("slug")
        .json(path)
    )


def run_stamp(now: datetime | None = None) -> str:
    return (now or datetime.now()).strftime("%Y%m%d_%H%M%S")


# The log of a table's runs lies beside them; scans of the table pass it by.
RUN_LOG = "_runs"
RUN_LOG_SCHEMA = "run_id string, committed_at timestamp, columns string"


def write_run(df: DataFrame, path: str, run_id: str | None = None) -> str:
    """A new run beside earlier ones, so a job may read the table it replaces.

    The run is committed by an entry in the log, written once all its rows are; a
    run whose job fails, or still writes, has none and is not read.
    """
    run = run_id or run_stamp()
    df.write.mode("errorifexists").parquet(f"{path}/run_id={run}")
    spark = df.sparkSession
    entry = spark.range(1).select(
        F.lit(run).alias("run_id"),
        F.current_timestamp().alias("committed_at"),
        F.lit(df.schema.json()).alias("columns"),
    )
    entry.write.mode("append").json(f"{path}/{RUN_LOG}")
    return run


def committed_runs(spark: SparkSession, path: str) -> DataFrame:
    """``run_id``, ``committed_at`` and ``columns`` (their types as JSON) of the finished runs."""
    if RUN_LOG not in folder_names(spark, path):
        return spark.createDataFrame([], RUN_LOG_SCHEMA)
    return spark.read.schema(RUN_LOG_SCHEMA).json(f"{path}/{RUN_LOG}")


def read_latest_run(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished run under ``path``, with the columns it was written with.

    Only that run's folder is read; an error if there is none.
    """
    newest = committed_runs(spark, path).orderBy(F.desc("run_id")).first()
    if newest is None:
        raise ValueError(f"no finished run under {path}")
    columns = T.StructType.fromJson(json.loads(newest.columns))
    return spark.read.schema(columns).parquet(f"{path}/run_id={newest.run_id}")


def drop_unfinished_runs(spark: SparkSession, path: str) -> list[str]:
    """Delete the runs older than the newest finished one that never finished; their names.

    Newer ones may still be writing and stay.
    """
    finished = {row.run_id for row in committed_runs(spark, path).select("run_id").collect()}
    newest = max(finished, default="")
    names = (n.removeprefix("run_id=") for n in folder_names(spark, path) if n.startswith("run_id="))
    dropped = [name for name in names if name not in finished and name < newest]
    for name in dropped:
        delete_path(spark, f"{path}/run_id={name}")
    return dropped
