"""Outcomes enriched from grants by title: exact first, then by distance."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave import columns as C
from tallyweave.operators.dedupe import digest
from tallyweave.operators.fuzzy import grants_in_reach, nearest_grants
from tallyweave.operators.joins import join_to_single, left_join_many
from tallyweave.operators.schema import available_enrichment, require_columns, title_column
from tallyweave.operators.titles import (
    exact_winners,
    one_per_title,
    with_title_key,
    with_usable_key,
)
from tallyweave.runtime import cut

# Fixed value: how many edits apart two titles may be.
MAX_DISTANCE = 5


def enrich_by_title(
    outcomes: DataFrame,
    grants: DataFrame,
    *,
    mode: str = "one",
    form: str = "loose",
    max_distance: int = MAX_DISTANCE,
    outcome_title: str = "Project_Title",
    grant_title: str | None = None,
    enrichment: Mapping[str, str] = C.TITLE_ENRICHMENT,
) -> DataFrame:
    """All outcomes, with the enrichment columns taken from the matching grant.

    ``grants`` needs a unique ``grant_id``. In mode ``one`` each outcome row stays
    one row and the last of several grants with the same key wins; in mode ``all``
    every such grant gives a row. ``match_stage`` is ``exact``, ``fuzzy`` or
    ``none``, ``distance`` tells how far a fuzzy match is.
    """
    if mode not in ("one", "all"):
        raise ValueError(f"mode is 'one' or 'all', not {mode!r}")
    require_columns(outcomes, [outcome_title])
    require_columns(grants, ["grant_id"])
    grant_title = grant_title or title_column(grants)
    if grant_title is None:
        raise ValueError(f"no title column; the table has {grants.columns}")
    served = available_enrichment(grants, dict(enrichment))

    # Titles may be whole documents: they are joined by the digest of their key.
    key_id = digest(F.col("title_key")).alias("key_id")
    keyed = with_title_key(outcomes, outcome_title, form).select("*", key_id)
    # Rows of one raw title have one key, so it is worked out once for each.
    known = cut(
        with_usable_key(one_per_title(grants, grant_title), grant_title, form).select(
            key_id,
            F.unhex(F.md5(F.col(grant_title))).alias("known_id"),
            "title_key",
            "grant_id",
            F.col(grant_title).alias("matched_title"),
            *[F.col(source).alias(target) for source, target in served.items()],
        ),
        "known",
    )
    # All tables here grow with the input, and in memory far beyond what Spark takes their
    # files for. So they are joined by merging, and the answers found as ids only.
    held = known.select("key_id").distinct().withColumn("held", F.lit(True)).hint("merge")
    asked = cut(
        keyed.where(F.col("key_id").isNotNull())
        .groupBy("key_id")
        .agg(F.first("title_key").alias("title"))
        .join(held, "key_id", "left")
        .select("key_id", F.when(F.col("held").isNull(), F.col("title")).alias("title")),
        "asked",
    )
    exact = known.select("key_id", "grant_id", "known_id").join(
        asked.where(F.col("title").isNull()).select("key_id").hint("merge"), "key_id", "left_semi"
    )
    if mode == "one":
        exact = exact_winners(exact, "key_id")
    wanted = cut(
        asked.where(F.col("title").isNotNull()).select(F.unhex(F.md5("title")).alias("tid"), "key_id", "title"),
        "titles",
    )
    near = known.select(F.col("title_key").alias("title"), "grant_id")
    near = cut(grants_in_reach(near, wanted, max_distance), "grants")
    nearest = nearest_grants(wanted, near, max_distance)
    fuzzy = (
        nearest.join(wanted.select("tid", "key_id").hint("merge"), "tid")
        .select("key_id", "grant_id", "distance")
        .join(known.select("grant_id", "known_id").hint("merge"), "grant_id")
    )
    # Exact and fuzzy keys are disjoint, so one table answers both in one join.
    answers = cut(
        exact.withColumns({"match_stage": F.lit("exact"), "distance": F.lit(0)}).unionByName(
            fuzzy.withColumn("match_stage", F.lit("fuzzy"))
        ).drop("grant_id"),
        "answers",
    )
    facts = known.drop("key_id", "title_key").hint("merge")
    answers = answers.join(facts, "known_id").drop("known_id").hint("merge")

    base = keyed.drop("title_key", *served.values())
    if mode == "one":
        joined = join_to_single(base, answers, ["key_id"], "left")
    else:
        joined = left_join_many(base, answers, "key_id").drop("matched")
    kept = [c for c in outcomes.columns if c not in served.values()]
    return joined.select(
        *kept,
        *served.values(),
        "grant_id",
        "matched_title",
        F.coalesce("match_stage", F.lit("none")).alias("match_stage"),
        "distance",
    )
