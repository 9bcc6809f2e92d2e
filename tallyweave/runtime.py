"""Where intermediate tables go, how lineage is cut, and how the tables are released."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

# Paths handed out in the shared folder, by application, until they are released.
_written: dict[str, list[str]] = {}
# Path of each table that a step has written.
_tables: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a folder beside its warehouse. A
    cluster session is refused without it, or with a folder of one machine
    (``file:``), which would be lost with that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not is_local(spark) and (not named or named.startswith("file:")):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not named:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        named = f"{warehouse}/_scratch-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, deleted by ``release``."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table.

    Later stages then neither recompute what went before nor lose it with an
    executor, and Spark knows the true size when it chooses a join. The table
    stays until ``release`` or ``discard``, since results are read from it lazily.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _tables[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` returned. Nothing that reads them may still be to run."""
    for table in tables:
        spark, path = table.sparkSession, _tables.pop(table)
        _written[spark.sparkContext.applicationId].remove(path)
        delete_path(spark, path)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables this application has written; how many there were.

    To be called once the results that were read from them are stored.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete_path(spark, path)
    return len(paths)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    place, files = _file_system(spark, path)
    files.delete(place, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right under ``path``, on whatever storage it lies."""
    place, files = _file_system(spark, path)
    return sorted(found.getPath().getName() for found in files.listStatus(place) if found.isDirectory())


def folder_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Whole paths of the folders right under the folders that ``pattern`` names."""
    place, files = _file_system(spark, pattern)
    roots = [root.getPath() for root in files.globStatus(place) or [] if root.isDirectory()]
    found = [child for root in roots for child in files.listStatus(root) if child.isDirectory()]
    return sorted(child.getPath().toString() for child in found)
