"""Outcome and funding documents: their shape, level counts and level rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of the two kinds of document.
OUTCOME_TYPE = (
    "struct<primary_institute:string,"
    "level1_ip:array<struct<title:string,type:string,filing_year:int,"
    "assignee:string,description:string>>,"
    "level2_companies:array<struct<company_name:string,founding_year:int,"
    "industry:string,connection:string>>,"
    "level5_exits:array<struct<company_name:string,exit_type:string,exit_year:int,"
    "value:string,acquirer:string>>>"
)
FUNDING_TYPE = (
    "struct<level3_series_a:array<struct<company_name:string,funding_year:int,"
    "funding_amount:string,product_name:string,clinical_trial_year:int>>,"
    "level4_series_bc:array<struct<company_name:string,funding_round:string,"
    "funding_year:int,funding_amount:string,product_name:string,"
    "clinical_stage:string,clinical_trial_year:int>>>"
)
LEVEL_LISTS = {
    1: "level1_ip",
    2: "level2_companies",
    3: "level3_series_a",
    4: "level4_series_bc",
    5: "level5_exits",
}
LEVEL_DESCRIPTIONS = {
    1: "Patents, copyright, trademarks",
    2: "Companies opened",
    3: "Series A funding round occurred; product in clinical stage I",
    4: "Series B and C funding rounds occurred; product in clinical stage II, and III",
    5: "Companies acquired/publicly listed (exit strategies for companies)",
}


def parsed(document: Column) -> Column:
    """JSON text as a VARIANT, read once per row; NULL where it is not JSON."""
    return F.try_parse_json(document)


def level_items(doc: Column, level: int) -> Column:
    """The list of one level, NULL when it is absent or not a list."""
    return F.try_variant_get(doc, f"$.{LEVEL_LISTS[level]}", "array<variant>")


def level_count(doc: Column, level: int) -> Column:
    """Number of entries of one level; 0 for anything that is not a list."""
    return F.coalesce(F.size(level_items(doc, level)), F.lit(0))


def typed_count(items: Column) -> Column:
    """Number of entries of a typed array column, 0 for NULL."""
    return F.coalesce(F.size(items), F.lit(0))


def highest_of(levels: dict[int, Column]) -> Column:
    """Highest level with at least one entry, else 0."""
    rule = None
    for level in sorted(levels, reverse=True):
        reached = levels[level] > 0
        rule = F.when(reached, level) if rule is None else rule.when(reached, level)
    return rule.otherwise(0)


def final_level(first: Column, second: Column) -> Column:
    """The higher of two highest levels, a missing one counting as 0."""
    return F.greatest(F.coalesce(first, F.lit(0)), F.coalesce(second, F.lit(0)))


def company_list(doc: Column) -> Column:
    """Names of the level-2 companies that have one, joined by comma and blank."""
    names = F.transform(
        level_items(doc, 2), lambda c: F.try_variant_get(c, "$.company_name", "string")
    )
    return F.array_join(names, ", ")


def level_descriptions() -> Column:
    """Map from level number, as text, to what the level means."""
    pairs = [F.lit(x) for k, v in LEVEL_DESCRIPTIONS.items() for x in (str(k), v)]
    return F.create_map(*pairs)


def has_payload(document: Column) -> Column:
    """The stored text holds something: not NULL, ``null`` or ``{}``."""
    return document.isNotNull() & (document != "null") & (document != "{}")
