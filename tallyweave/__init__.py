"""Record enrichment and outcome scoring as Spark DataFrame operations."""

from tallyweave.plans.combine import combine_sources, combine_tables
from tallyweave.plans.diagnosis import diagnose_unmatched
from tallyweave.plans.name_enrichment import enrich_by_name
from tallyweave.plans.scoring import (
    combine_levels,
    read_outcomes,
    score_funding,
    score_outcomes,
    upsert_scores,
)
from tallyweave.plans.title_enrichment import enrich_by_title
from tallyweave.operators.profile import profile_table

__all__ = [
    "combine_levels",
    "combine_sources",
    "combine_tables",
    "diagnose_unmatched",
    "enrich_by_name",
    "enrich_by_title",
    "profile_table",
    "read_outcomes",
    "score_funding",
    "score_outcomes",
    "upsert_scores",
]
