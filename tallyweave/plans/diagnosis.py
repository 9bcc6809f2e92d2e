"""Why rows found no match."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import loose_title
from tallyweave.operators.names import lookup_names
from tallyweave.operators.partial import partial_matches
from tallyweave.operators.words import average_length, sample_rows, top_words, word_counts
from tallyweave.runtime import cut


class Diagnosis(NamedTuple):
    """Length figures, frequent words, the rows looked at closely, and what was near them."""

    lengths: DataFrame
    words: DataFrame
    sample: DataFrame
    partial: DataFrame
    names: DataFrame


def diagnose_unmatched(
    unmatched: DataFrame, grants: DataFrame, sample: int | None = 5, seed: int = 0
) -> Diagnosis:
    """Reports on unmatched outcomes.

    ``unmatched`` has ``outcome_id``, ``Name`` and ``Project_Title``; ``grants`` has
    ``grant_id``, ``name`` and ``title``. Partial and name matches are looked for
    among ``sample`` random rows, or among all with None. Both sides are written
    once with their keys, which every report reads.
    """
    keyed = cut(
        unmatched.select(
            "outcome_id",
            "Name",
            "Project_Title",
            loose_title(F.col("Project_Title")).alias("title_key"),
            loose_title(F.col("Name")).alias("name_key"),
        ),
        "unmatched",
    )
    picked = keyed
    if sample is not None:
        picked = cut(sample_rows(keyed, F.col("outcome_id"), sample, seed), "picked")
    grant_keys = cut(
        grants.select(
            "grant_id",
            "title",
            loose_title(F.col("title")).alias("title_key"),
            loose_title(F.col("name")).alias("name_key"),
        ),
        "grant-keys",
    )
    return Diagnosis(
        average_length(keyed, "Project_Title"),
        top_words(word_counts(keyed, "title_key")),
        picked,
        partial_matches(
            picked.select(F.col("outcome_id").alias("title_id"), F.col("title_key").alias("title")),
            grant_keys.select("grant_id", F.col("title_key").alias("title")),
        ),
        lookup_names(picked, grant_keys.select("name_key", "grant_id", "title")),
    )
