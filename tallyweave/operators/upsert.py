"""Keyed update of a table: rows with a match change, all others stay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.dedupe import first_per_key
from tallyweave.operators.joins import join_to_single


def update_matched(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    latest_first: Sequence[Column],
) -> DataFrame:
    """``target`` with ``columns`` taken from the update of the same key.

    A key that occurs several times among the updates counts with the first in
    ``latest_first``. Keys match by plain equality, so a NULL never matches, and
    nothing is inserted or removed. Updates hold each key once by then, so a key
    the target repeats very often can be split by adaptive execution.
    """
    single = first_per_key(updates, keys, latest_first).select(
        *keys, F.struct(*columns).alias("_new")
    )
    changed = F.col("_new").isNotNull()
    kinds = dict(target.dtypes)
    return (
        join_to_single(target, single, keys, "left")
        .withColumns(
            {
                c: F.when(changed, F.col("_new")[c].cast(kinds[c])).otherwise(F.col(c))
                for c in columns
            }
        )
        .select(*target.columns)
    )
