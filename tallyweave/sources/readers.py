"""Files, folders and catalog tables as DataFrames."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.runtime import folder_paths

CORRUPT = "_corrupt_record"
# Why a file gives no rows.
NO_COLUMNS, UNREADABLE = "no columns", "unreadable"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV files with a header each, as the columns of a stated schema.

    A column is found by its name in the header of its file, whatever its place and
    letter case; a name that a header repeats is not found. What a file lacks is NULL,
    what the schema lacks is left out. Bad lines keep their text in ``_corrupt_record``
    if the schema has it. A file without a header has no rows. Headers are read by
    one job, and by one more for each distinct one.
    """
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    groups, _ = _csv_groups(spark, path)
    parts = [_by_header(spark, paths, names, wanted) for paths, names in groups]
    if not parts:
        return spark.createDataFrame([], wanted)
    return reduce(DataFrame.unionByName, parts)


def _by_header(
    spark: SparkSession, paths: list[str], names: list[str], wanted: T.StructType
) -> DataFrame:
    """Files of one header, with the columns of ``wanted`` found by name."""
    fields = {field.name.lower(): field for field in wanted if field.name != CORRUPT}
    shape = T.StructType()
    for place, name in enumerate(names):
        # a field found is used up; other columns are read as text and left out
        field = fields.pop(name.lower(), None)
        shape.add(field.name if field else f"_unused_{place}", field.dataType if field else "string")
    if CORRUPT in wanted.names:
        shape.add(wanted[CORRUPT])
    rows = (
        spark.read.schema(shape)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(paths)
    )
    absent = {field.name: F.lit(None).cast(field.dataType) for field in fields.values()}
    return rows.withColumns(absent).select(*(_quoted(name) for name in wanted.names))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def csv_headers(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """``path``, ``header`` and ``reason`` of every CSV file with a byte, by one job; one of the two is NULL.

    The header is the first line that is not blank. Each executor looks at the lines
    of its own blocks; only the one at the start of a file gives a header.
    """
    line = F.when(F.trim("value") != "", F.col("value"))
    first = (
        spark.read.option("pathGlobFilter", f"*{suffix}")
        .option("ignoreCorruptFiles", True)
        .text(path)
        .where(F.col("_metadata.file_block_start") == 0)
        .groupBy(F.col("_metadata.file_path").alias("path"))
        .agg(F.first(line, ignorenulls=True).alias("header"))
    )
    files = _files(spark, path, suffix).select(F.col("_metadata.file_path").alias("path"))
    # a file that cannot be read gives no line at all
    read = F.when(F.col("read"), NO_COLUMNS).otherwise(UNREADABLE)
    return files.join(first.withColumn("read", F.lit(True)), "path", "left").select(
        "path", "header", F.when(F.col("header").isNull(), read).alias("reason")
    )


def _csv_groups(
    spark: SparkSession, path: str, suffix: str = ""
) -> tuple[list[tuple[list[str], list[str]]], list[tuple[str, str]]]:
    """(paths, column names) for each distinct header, and (path, reason) of the rest."""
    alike: dict[str, list[str]] = {}
    empty, rejects = set(list_files(spark, path, suffix)), []
    for found, header, reason in csv_headers(spark, path, suffix).orderBy("path").collect():
        empty.discard(_plain(found))
        if header is None:
            rejects.append((_plain(found), reason))
        else:
            alike.setdefault(header, []).append(_plain(found))
    rejects += [(found, NO_COLUMNS) for found in sorted(empty)]
    # Spark's own names, so that empty and repeated ones are told apart as it does
    return [
        (paths, read_files(spark, paths[:1], "csv").schema.names) for paths in alike.values()
    ], rejects


def with_corrupt_column(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the text of the bad ones."""
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, df.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_json(
    spark: SparkSession, path: str, schema: T.StructType | str, lines: bool = True
) -> DataFrame:
    """One row per object: one a line, or with ``lines=False`` files of one object or an array.

    A file that is not read by lines is read by one task, however large it is.
    """
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def with_source_file(df: DataFrame) -> DataFrame:
    """Adds the name of the file each row came from."""
    return df.withColumn("Source_File", F.col("_metadata.file_name"))


def _files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """The files in a folder whose name ends in ``suffix``; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)


def list_files(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Paths in a folder that end in ``suffix``, empty files among them."""
    return sorted(map(_plain, _files(spark, folder, suffix).inputFiles()))


def _plain(path: str) -> str:
    """A path as Spark gives it, without escapes and without an empty authority."""
    return unquote(path).replace(":///", ":/", 1)


def read_files(
    spark: SparkSession, paths: list[str], file_format: str, schema: T.StructType | None = None
) -> DataFrame:
    """Files of one shape as one scan. CSV columns are all text."""
    reader = spark.read.format(file_format)
    if file_format == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(paths)


def file_schema(spark: SparkSession, path: str, file_format: str) -> T.StructType | str:
    """The columns of one file from its header or footer, or why it has none."""
    try:
        schema = read_files(spark, [path], file_format).schema
    except (PySparkException, Py4JJavaError) as error:
        return f"{UNREADABLE}: {type(error).__name__}"
    return schema if schema.fields else NO_COLUMNS


class FileGroup(NamedTuple):
    """Files with the same columns, or one table of several files, and their rows with ``Source_File``."""

    paths: list[str]
    rows: DataFrame


def read_folder(
    spark: SparkSession, folder: str, suffix: str, file_format: str
) -> tuple[list[FileGroup], list[tuple[str, str]]]:
    """The files of a folder, one scan per distinct set of columns, and (path, reason) of the rest.

    A folder in it whose name ends in ``suffix`` is one table, written as several
    files: its name is their ``Source_File``. Of CSV its files are grouped by header.
    Headers of CSV files are read by the executors, in one job for all files and
    one for each distinct header. Footers of columnar files are read one by one,
    several at a time.
    """
    tables = table_folders(spark, folder, suffix)
    if file_format == "csv":
        headers, rejects = _csv_groups(spark, folder, suffix)
        groups = [
            FileGroup(paths, with_source_file(read_files(spark, paths, "csv", _all_text(names))))
            for paths, names in headers
        ]
        for table in tables:
            headers, left_out = _csv_groups(spark, table)
            groups += [
                _of_table(table, paths, read_files(spark, paths, "csv", _all_text(names)))
                for paths, names in headers
            ]
            rejects += left_out
        return groups, rejects
    paths = list_files(spark, folder, suffix) + tables
    with ThreadPoolExecutor(max_workers=8) as pool:
        schemas = list(pool.map(lambda path: file_schema(spark, path, file_format), paths))
    rejects = [(path, found) for path, found in zip(paths, schemas) if isinstance(found, str)]
    alike: dict[str, tuple[T.StructType, list[str]]] = {}
    for path, found in zip(paths, schemas):
        if not isinstance(found, str) and path not in tables:
            alike.setdefault(found.json(), (found, []))[1].append(path)
    groups = [
        FileGroup(members, with_source_file(read_files(spark, members, file_format, schema)))
        for schema, members in alike.values()
    ]
    groups += [
        _of_table(path, [path], read_files(spark, [path], file_format, found))
        for path, found in zip(paths, schemas)
        if path in tables and not isinstance(found, str)
    ]
    return groups, rejects


def table_folders(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Paths of the folders right in ``folder`` whose name ends in ``suffix``: tables of several files."""
    found = folder_paths(spark, folder) if suffix else []
    return [path for path in found if path.endswith(suffix) and _file_name(path)[0] not in "._"]


def _file_name(path: str) -> str:
    return path.rpartition("/")[2]


def _of_table(table: str, paths: list[str], rows: DataFrame) -> FileGroup:
    return FileGroup(paths, rows.withColumn("Source_File", F.lit(_file_name(table))))


def _all_text(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def find_tables(spark: SparkSession, pattern: str, database: str | None = None) -> list[str]:
    """Names of the tables of a database that contain ``pattern``."""
    names = {t.name for t in spark.catalog.listTables(database)}
    return sorted(name for name in names if pattern in name)


def read_table(spark: SparkSession, name: str, database: str | None = None) -> DataFrame:
    return spark.table(f"{database}.{name}" if database else name)


def rejects_frame(spark: SparkSession, rejects: list[tuple[str, str]]) -> DataFrame:
    """Sources that were skipped, and why."""
    return spark.createDataFrame(rejects, "source string, reason string")
