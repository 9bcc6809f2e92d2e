"""What a table looks like."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.schema import stack


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, rows of the table, NULLs, and about how many values.

    All columns are measured in one pass. ``distinct_about`` comes from a sketch per
    column (5 % off at one standard deviation); it is NULL for maps and variants, which
    have no order to hash by.
    """
    measured, described = [F.count(F.lit(1)).alias("row_count")], []
    for i, (name, kind) in enumerate(df.dtypes, start=1):
        column = F.col("`" + name.replace("`", "``") + "`")
        measured.append(F.count(column).alias(f"filled_{i}"))
        distinct = F.lit(None).cast("bigint")
        if "map<" not in kind and "variant" not in kind:
            measured.append(F.approx_count_distinct(column).alias(f"distinct_{i}"))
            distinct = F.col(f"distinct_{i}")
        described.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("column_name"),
                F.lit(kind).alias("data_type"),
                (F.col("row_count") - F.col(f"filled_{i}")).alias("null_count"),
                distinct.alias("distinct_about"),
            )
        )
    return df.agg(*measured).select(F.inline(F.array(*described)), "row_count")


def sample_values(
    tables: Mapping[str, tuple[DataFrame, Sequence[str]]], n: int = 5
) -> DataFrame | None:
    """The first ``n`` rows of each table in the order of its columns named, a row per value as text.

    Each task keeps ``n`` rows of its own, so no table is sorted. None for no tables.
    """
    return stack([_first_values(name, df, order, n) for name, (df, order) in tables.items()])


def _first_values(name: str, df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    columns = ["`" + c.replace("`", "``") + "`" for c in df.columns]
    value = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(df.columns[i - 1]).alias("column_name"),
                F.col(c).cast("string").alias("value"),
            )
            for i, c in enumerate(columns, start=1)
        ]
    )
    # at most n rows are left, which one task numbers
    first = df.orderBy(*order).limit(n).withColumn("row_no", F.row_number().over(Window.orderBy(*order)))
    return first.select(F.lit(name).alias("table_name"), "row_no", F.inline(value))


def profile_tables(tables: Mapping[str, DataFrame]) -> DataFrame | None:
    """One row per table: number of rows and of columns. None for no tables."""
    return stack(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"),
                "row_count",
                F.lit(len(df.columns)).alias("column_count"),
            )
            for name, df in tables.items()
        ]
    )


def sample_where(df: DataFrame, condition, order, n: int = 5) -> DataFrame:
    """The first ``n`` rows in ``order`` that meet a condition."""
    return df.where(condition).orderBy(*order).limit(n)
