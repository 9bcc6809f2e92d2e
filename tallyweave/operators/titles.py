"""Matching by normalised title: which grant belongs to which title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import TITLE_KEYS, usable_keys
from tallyweave.operators.dedupe import digest, first_per_key
from tallyweave.operators.joins import join_to_single


def with_title_key(df: DataFrame, title: str, form: str = "loose") -> DataFrame:
    """Adds ``title_key``; NULL where the title is NULL or has nothing left."""
    keys = usable_keys(TITLE_KEYS[form](F.col(title)))
    return df.withColumn("title_key", F.explode_outer(keys))


def with_usable_key(df: DataFrame, title: str, form: str = "loose") -> DataFrame:
    """Adds ``title_key`` and leaves out rows that have none."""
    return df.withColumn("title_key", F.explode(usable_keys(TITLE_KEYS[form](F.col(title)))))


def one_per_title(grants: DataFrame, title: str) -> DataFrame:
    """One grant per raw title: the smallest id."""
    return first_per_key(grants, [digest(F.col(title))], [F.col("grant_id")])


def exact_winners(grants: DataFrame, key: str = "title_key") -> DataFrame:
    """One grant per key. Where raw titles share a key the last one wins."""
    return first_per_key(grants, [key], [F.desc("grant_id")])


def title_keys(outcomes: DataFrame) -> DataFrame:
    """Distinct keys of outcomes."""
    return outcomes.where(F.col("title_key").isNotNull()).select("title_key").distinct()


def unmatched_keys(keys: DataFrame, grants: DataFrame) -> DataFrame:
    """Keys of outcomes that no grant has."""
    return keys.join(grants.select("title_key").distinct(), "title_key", "left_anti")


def stage_counts(df: DataFrame) -> DataFrame:
    """Rows matched exactly, by distance, and not at all."""
    return df.groupBy("match_stage").agg(F.count(F.lit(1)).alias("rows"))


def keep_known(df: DataFrame, original: DataFrame, identity: Column) -> DataFrame:
    """Rows whose identity, a text, occurs in the original table."""
    known = original.select(digest(identity).alias("_id")).distinct()
    named = df.withColumn("_id", digest(identity))
    return join_to_single(named, known, ["_id"], "left_semi").drop("_id")
