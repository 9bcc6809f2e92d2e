"""Nested outcome documents as flat rows, one per listed item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.levels import LEVEL_LISTS, level_items, parsed

# What stands where an item has no name or type.
DEFAULT_NAMES = {
    1: "Untitled",
    2: "Unnamed",
    3: "Unknown Company",
    4: "Unknown Company",
    5: "Unnamed",
}
DEFAULT_TYPE = "IP"

# Which field of an item serves which flat column, per level.
ITEM_FIELDS = {
    "item_name": {
        1: "title",
        2: "company_name",
        3: "company_name",
        4: "company_name",
        5: "company_name",
    },
    "item_type": {1: "type", 2: "industry", 3: "product_name", 4: "funding_round", 5: "exit_type"},
    "item_year": {
        1: "filing_year",
        2: "founding_year",
        3: "funding_year",
        4: "funding_year",
        5: "exit_year",
    },
    "item_party": {1: "assignee", 4: "product_name", 5: "acquirer"},
    "item_detail": {
        1: "description",
        2: "connection",
        3: "funding_amount",
        4: "funding_amount",
        5: "value",
    },
    "clinical_stage": {4: "clinical_stage"},
    "clinical_trial_year": {3: "clinical_trial_year", 4: "clinical_trial_year"},
}
YEAR_FIELDS = ("item_year", "clinical_trial_year")


def _field(column: str, levels: Sequence[int]) -> Column:
    kind = "int" if column in YEAR_FIELDS else "string"
    rule = F.lit(None).cast(kind)
    for level, field in ITEM_FIELDS[column].items():
        if level in levels:
            value = F.try_variant_get("item", f"$.{field}", kind)
            rule = F.when(F.col("level") == level, value).otherwise(rule)
    return rule


def outcome_items(
    df: DataFrame, keys: Sequence[str], document: str, levels: Sequence[int] = (1, 2, 5)
) -> DataFrame:
    """One row per item of the given levels, numbered from 1 within its list.

    The document is parsed once per row and nothing is shuffled. The acquirer
    is given only for an exit that is an acquisition.
    """
    lists = F.array(
        *[
            F.struct(F.lit(level).alias("level"), level_items(F.col("_doc"), level).alias("items"))
            for level in levels
            if level in LEVEL_LISTS
        ]
    )
    items = (
        df.select(*keys, parsed(F.col(document)).alias("_doc"))
        .select(*keys, F.explode(lists).alias("_list"))
        .select(
            *keys,
            F.col("_list.level").alias("level"),
            F.posexplode("_list.items").alias("_at", "item"),
        )
    )
    flat = items.select(
        *keys,
        "level",
        (F.col("_at") + 1).alias("item_no"),
        *[_field(column, levels).alias(column) for column in ITEM_FIELDS],
    )
    default_name = F.create_map(*[F.lit(x) for pair in DEFAULT_NAMES.items() for x in pair])
    bought = F.coalesce(F.col("item_type") == "acquisition", F.lit(False))
    return flat.withColumns(
        {
            "item_name": F.coalesce("item_name", default_name[F.col("level")]),
            "item_type": F.when(
                F.col("level") == 1, F.coalesce("item_type", F.lit(DEFAULT_TYPE))
            ).otherwise(F.col("item_type")),
            "item_party": F.when((F.col("level") != 5) | bought, F.col("item_party")),
        }
    )
