"""Duplicate rows and duplicate keys, with a stated survivor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    The filter on the row number lets each map task drop all but its own first
    row, so a key held by very many rows still sends few of them.
    """
    return top_per_key(df, keys, order, 1)


def top_per_key(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int
) -> DataFrame:
    """The first ``n`` rows per key in ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def digest(text: Column) -> Column:
    """SHA-256 of a text: stands for it where only equality counts, NULL for NULL."""
    return F.sha2(text, 256)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and how many are repeats of another row.

    Texts are shuffled by their digest only.
    """
    short = [
        digest(F.col(f"`{name}`")).alias(name) if kind == "string" else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ]
    groups = df.groupBy(*short).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
    ).withColumn("duplicates", F.col("rows") - F.col("distinct_rows"))


def without_duplicates(df: DataFrame) -> DataFrame:
    """Whole-row deduplication, texts compared and shuffled as keys by their digest."""
    texts = [name for name, kind in df.dtypes if kind == "string"]
    keyed = df.withColumns({f"_digest_{i}": digest(_named(n)) for i, n in enumerate(texts)})
    keys = [c for c in keyed.columns if c not in texts]
    return keyed.dropDuplicates(keys).select(*map(_named, df.columns))


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
