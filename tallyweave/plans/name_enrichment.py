"""Recipients enriched from the yearly tables by name."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave import columns as C
from tallyweave.functions.text import clean_name
from tallyweave.operators.names import column_match_rates, join_by_name, match_rate
from tallyweave.operators.schema import require_columns
from tallyweave.runtime import cut


class NameEnrichment(NamedTuple):
    """Enriched rows, the overall match rate and the rate per column."""

    rows: DataFrame
    rate: DataFrame
    column_rates: DataFrame


def enrich_by_name(gold: DataFrame, silver: DataFrame, name: str = "Name") -> NameEnrichment:
    """Every recipient with each grant row of that name; ``Not Found`` fills the gaps.

    ``silver`` comes from :func:`combine_sources` or :func:`combine_tables`. It is
    written first, so that the yearly tables are read once however often the
    join and the rates refer to them.
    """
    keyed = require_columns(gold, [name]).withColumn("clean_name", clean_name(F.col(name)))
    rows = join_by_name(keyed, cut(silver, "silver"))
    present = [t for t in C.NAME_ENRICHMENT if t in rows.columns]
    first = F.col(present[0]) != C.NOT_FOUND if present else F.col("matched")
    return NameEnrichment(rows, match_rate(rows, first), column_match_rates(rows, present))
