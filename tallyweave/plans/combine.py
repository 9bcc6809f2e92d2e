"""Gather yearly tables whose columns drift into one."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave import columns as C
from tallyweave.functions.text import fiscal_year_of_file, fiscal_year_of_table
from tallyweave.operators.schema import align_by_name, stack
from tallyweave.sources.readers import find_tables, read_folder, read_table, rejects_frame


NO_NAME = "no name column"


class Combined(NamedTuple):
    """Aligned rows (None if no source was usable) and the sources left out."""

    rows: DataFrame | None
    rejects: DataFrame


def combine_frames(
    spark: SparkSession,
    frames: Mapping[str, DataFrame],
    targets: Iterable[str] = C.NAME_ENRICHMENT,
) -> Combined:
    """Align every named table and stack them, with the fiscal year taken from the name.

    Tables without a name column are reported.
    """
    targets = tuple(targets)
    aligned, rejects = [], []
    for name, frame in frames.items():
        part = align_by_name(frame, fiscal_year_of_table(F.lit(name)), targets)
        if part is None:
            rejects.append((name, NO_NAME))
        else:
            aligned.append(part)
    return Combined(stack(aligned), rejects_frame(spark, rejects))


def combine_sources(
    spark: SparkSession,
    folder: str,
    suffix: str = ".csv",
    file_format: str = "csv",
    targets: Iterable[str] = C.NAME_ENRICHMENT,
) -> Combined:
    """The yearly files of a folder, with the fiscal year taken from the file name."""
    targets = tuple(targets)
    groups, rejects = read_folder(spark, folder, suffix, file_format)
    aligned = []
    for paths, rows in groups:
        year = fiscal_year_of_file(F.col("Source_File"))
        part = align_by_name(rows, year, targets, ["Source_File"])
        if part is None:
            rejects.extend((path, NO_NAME) for path in paths)
        else:
            aligned.append(part)
    return Combined(stack(aligned), rejects_frame(spark, rejects))


def combine_tables(
    spark: SparkSession,
    pattern: str,
    database: str | None = None,
    targets: Iterable[str] = C.NAME_ENRICHMENT,
) -> Combined:
    """The yearly catalog tables whose name contains ``pattern``."""
    names = find_tables(spark, pattern, database)
    return combine_frames(spark, {n: read_table(spark, n, database) for n in names}, targets)


def stack_folder(
    spark: SparkSession, folder: str, suffix: str = ".csv", file_format: str = "csv"
) -> Combined:
    """All columns of all files of a folder, with the file each row came from."""
    groups, rejects = read_folder(spark, folder, suffix, file_format)
    return Combined(stack([group.rows for group in groups]), rejects_frame(spark, rejects))
