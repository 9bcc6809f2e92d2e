"""Enrichment by name and lookup of names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave import columns as C
from tallyweave.functions.text import usable
from tallyweave.operators.dedupe import top_per_key
from tallyweave.operators.joins import join_to_single, left_join_many


def fill_not_found(df: DataFrame, targets: Iterable[str] = C.NAME_ENRICHMENT) -> DataFrame:
    """``Not Found`` in place of NULL in the targets the table has."""
    present = [t for t in targets if t in df.columns]
    return df.withColumns({t: F.coalesce(F.col(t), F.lit(C.NOT_FOUND)) for t in present})


def join_by_name(gold: DataFrame, silver: DataFrame) -> DataFrame:
    """Recipients with every grant row of the same ``clean_name``, gaps filled."""
    return fill_not_found(left_join_many(gold, silver, "clean_name"))


def match_rate(df: DataFrame, enriched_if) -> DataFrame:
    """Total, enriched and percentage of rows, in one pass; 0 % of an empty table."""
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(enriched_if).alias("enriched")
    ).withColumn("rate", _percent("enriched", "total"))


def column_match_rates(df: DataFrame, targets: Iterable[str] = C.NAME_ENRICHMENT) -> DataFrame:
    """One row per target column: rows that are not ``Not Found``, and their share."""
    present = [t for t in targets if t in df.columns]
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(t) != C.NOT_FOUND).alias(t) for t in present],
    )
    return counts.unpivot("total", present, "column_name", "matched").select(
        "column_name", "matched", "total", _percent("matched", "total").alias("rate")
    )


def _percent(part: str, whole: str):
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole) * 100).otherwise(F.lit(0.0))


def lookup_names(people: DataFrame, grants: DataFrame, keep: int = 3) -> DataFrame:
    """Per ``name_key`` of ``people``: how many grants carry it and the first titles.

    ``grants`` has ``name_key``, ``grant_id`` and ``title``. Titles come in grant
    order. Only the kept titles are ever gathered, whatever the number of grants.
    """
    wanted = people.where(usable(F.col("name_key"))).select("name_key").distinct()
    theirs = join_to_single(grants, wanted, ["name_key"], "left_semi")
    counts = theirs.groupBy("name_key").agg(F.count(F.lit(1)).alias("grant_count"))
    first = (
        top_per_key(theirs, ["name_key"], [F.col("grant_id")], keep)
        .groupBy("name_key")
        .agg(F.sort_array(F.collect_list(F.struct("grant_id", "title"))).alias("_first"))
        .select("name_key", F.transform("_first", lambda g: g["title"]).alias("first_titles"))
    )
    return counts.join(first, "name_key")
