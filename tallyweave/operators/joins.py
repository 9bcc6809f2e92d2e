"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_to_single(left: DataFrame, single: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join with a table that holds each key once; a NULL in a key never matches.

    ``how`` is ``left``, ``left_semi`` or ``left_anti``. Adaptive execution splits
    a hot key of the left side only where both sides come straight from a shuffle.
    A table just made single by a grouping or window does not, so the join is on
    the keys as one struct, for which Spark shuffles it once more.
    """
    known = single
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    other = known.withColumn("_right", F.struct(*keys)).drop(*keys)
    joined = left.withColumn("_left", F.struct(*keys)).join(
        other, F.col("_left") == F.col("_right"), how
    )
    return joined.drop("_left", "_right")


def left_join_many(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left equi-join that keeps fan-out and adds a boolean ``matched``.

    Written as an inner join plus the rows without partner: adaptive execution
    splits a hot key on either side of an inner join, but never on the right of
    an outer one. The second branch reads only the distinct keys.
    """
    found = left.join(right, key, "inner").withColumn("matched", F.lit(True))
    absent = join_to_single(left, right.select(key).distinct(), [key], "left_anti")
    return found.unionByName(
        absent.withColumn("matched", F.lit(False)), allowMissingColumns=True
    )
