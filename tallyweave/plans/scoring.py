"""Levels 1 to 5 from outcome and funding documents, and their storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave import columns as C
from tallyweave.functions import levels as L
from tallyweave.functions.text import grant_date
from tallyweave.operators.items import outcome_items
from tallyweave.operators.schema import require_columns
from tallyweave.operators.upsert import update_matched


# What a funding document is looked up by.
FUNDING_KEY = ("researcher", "project", "grant_date")


def _scores(df: DataFrame, document: str, levels: tuple[int, ...]) -> DataFrame:
    """Adds a struct ``scores``; the document is parsed once per row."""
    counts = {n: F.col("_counts")[f"level{n}"] for n in levels}
    total: Column = F.lit(0)
    for count in counts.values():
        total = total + count
    doc = df.withColumn("_doc", L.parsed(F.col(document)))
    counted = doc.withColumn(
        "_counts", F.struct(*[L.level_count(F.col("_doc"), n).alias(f"level{n}") for n in levels])
    )
    scores = F.struct(
        *[c.alias(f"level{n}") for n, c in counts.items()],
        total.alias("total"),
        L.highest_of(counts).alias("highest_level"),
    )
    return counted.withColumn("scores", scores).drop("_counts")


def score_outcomes(
    grants: DataFrame, document: str = "outcome_data", keep: Sequence[str] = ()
) -> DataFrame:
    """Records of levels 1, 2 and 5 from grants with their outcome document as JSON text."""
    require_columns(grants, [*C.SCORE_KEY, document, *keep])
    return _scores(grants, document, (1, 2, 5)).select(
        F.col("Name").alias("researcher"),
        F.col("Project_Title").alias("project"),
        F.col("Competition_CD").alias("grant_code"),
        grant_date(F.col("Competition_CD")).alias("grant_date"),
        F.try_variant_get("_doc", "$.primary_institute", "string").alias("primary_institute"),
        L.company_list(F.col("_doc")).alias("companies_analyzed"),
        F.col(document).alias("data"),
        "scores",
        *keep,
    )


def with_companies(records: DataFrame) -> DataFrame:
    """Records that list a company; only these can have funding."""
    return records.where(F.col("scores.level2") > 0)


def score_funding(
    records: DataFrame, funding: DataFrame, document: str = "funding_data"
) -> DataFrame:
    """Records of levels 3 and 4 for the records that list a company.

    ``funding`` holds the funding document of a (researcher, project, grant_date);
    NULLs in the key equal each other. All columns of a record are kept, with its
    ``scores`` as ``outcome_scores``, so that nothing has to be joined again: one
    row per record and funding document.
    """
    require_columns(funding, [*FUNDING_KEY, document])
    asked = with_companies(records).withColumnRenamed("scores", "outcome_scores").drop("data")
    theirs = funding.select(
        F.struct(*FUNDING_KEY).alias("_of"), F.col(document).alias("_funding_document")
    )
    answered = asked.join(theirs, F.struct(*FUNDING_KEY) == F.col("_of"))
    scored = _scores(answered.drop("_of"), "_funding_document", (3, 4))
    return scored.drop("_doc").withColumnRenamed("_funding_document", "data")


def combine_levels(funding: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Levels 1 to 5 of what ``score_funding`` returned: records with both kinds of result."""
    zero = F.lit(0)
    sides = funding.withColumnsRenamed({"outcome_scores": "_outcome", "scores": "_funding"})
    level = lambda side, n: F.coalesce(F.col(side)[f"level{n}"], zero).alias(f"level{n}")
    return sides.select(
        *FUNDING_KEY,
        "grant_code",
        "primary_institute",
        F.struct(
            level("_outcome", 1),
            level("_outcome", 2),
            level("_funding", 3),
            level("_funding", 4),
            level("_outcome", 5),
        ).alias("level_details"),
        L.final_level(
            F.col("_outcome.highest_level"), F.col("_funding.highest_level")
        ).alias("highest_level"),
        L.level_descriptions().alias("level_descriptions"),
        *keep,
    )


def score_updates(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Records in the shape of the stored table; ``total_score`` is the highest level."""
    return records.select(
        F.col("researcher").alias("Name"),
        F.col("project").alias("Project_Title"),
        F.col("grant_code").alias("Competition_CD"),
        F.col("data").alias("outcome_data"),
        F.col("scores.level1").alias("level_1_score"),
        F.col("scores.level2").alias("level_2_score"),
        F.col("scores.level5").alias("level_5_score"),
        F.col("scores.highest_level").alias("total_score"),
        F.col("scores.total").alias("total"),
        *keep,
    )


def upsert_scores(
    target: DataFrame, updates: DataFrame, latest_first: list[Column] | None = None
) -> DataFrame:
    """The stored table with the scores of matching updates.

    Without a stated order, of several updates of one key the one with the
    highest level, then the greatest document text, counts.
    """
    order = latest_first or [F.desc("total_score"), F.desc("outcome_data")]
    return update_matched(target, updates, C.SCORE_KEY, C.SCORE_COLUMNS, order)


def read_outcomes(
    stored: DataFrame, name: str | None = None, limit: int | None = None
) -> DataFrame:
    """Stored records that hold a document, with the counts found in it."""
    held = stored.where(L.has_payload(F.col("outcome_data")))
    if name is not None:
        held = held.where(F.col("Name") == F.lit(name))
    if limit is not None:
        held = held.orderBy(*C.SCORE_KEY).limit(limit)
    doc = F.col("_doc")
    return (
        held.withColumn("_doc", L.parsed(F.col("outcome_data")))
        .withColumns(
            {
                "primary_institute": F.try_variant_get(doc, "$.primary_institute", "string"),
                "ip_count": L.level_count(doc, 1),
                "companies_count": L.level_count(doc, 2),
                "exits_count": L.level_count(doc, 5),
            }
        )
        .drop("_doc")
    )


def unreadable_outcomes(stored: DataFrame) -> DataFrame:
    """Stored records whose document is not JSON, to be reported beside the scores."""
    held = stored.where(L.has_payload(F.col("outcome_data")))
    return held.where(L.parsed(F.col("outcome_data")).isNull())


def stored_items(stored: DataFrame, name: str | None = None) -> DataFrame:
    """One row per item listed in the stored documents."""
    held = stored.where(L.has_payload(F.col("outcome_data")))
    if name is not None:
        held = held.where(F.col("Name") == F.lit(name))
    return outcome_items(held, C.SCORE_KEY, "outcome_data")
