"""Name enrichment, schema drift and combining."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import roles as R
from tallyweave import columns as C
from tallyweave.functions.text import loose_title
from tallyweave.operators.names import lookup_names
from tallyweave.plans.combine import combine_frames, combine_sources, combine_tables, stack_folder
from tallyweave.plans.name_enrichment import enrich_by_name

TARGETS = ", ".join(f'"{c}"' for c in C.NAME_ENRICHMENT)


def _enriched(spark, d):
    silver = combine_frames(spark, R.year_tables(spark, d)).rows
    return enrich_by_name(R.recipients(spark, d), silver)


_ENRICHED_SQL = f"""
  SELECT g."Name", g.recipient_key, lower(trim(g."Name")) AS clean_name, s.fiscal_year,
         s.clean_name IS NOT NULL AS matched,
         {", ".join(f"coalesce(s.\"{c}\", 'Not Found') AS \"{c}\"" for c in C.NAME_ENRICHMENT)}
  FROM ({R.RECIPIENTS_SQL}) g LEFT JOIN ({R.YEAR_TABLES_SQL}) s
    ON lower(trim(g."Name")) = s.clean_name
"""


def name_enrich(spark, d):
    return _enriched(spark, d).rows


def match_rate(spark, d):
    return _enriched(spark, d).rate


def column_match_rate(spark, d):
    return _enriched(spark, d).column_rates


def schema_union(spark, d):
    return combine_frames(spark, R.year_tables(spark, d)).rows


def catalog_union(spark, d):
    """The same through tables found by name."""
    for name, frame in R.year_tables(spark, d).items():
        frame.createOrReplaceTempView(f"tw_{name}")
    return combine_tables(spark, "tw_recipients").rows


def folder_union(spark, d):
    """All given files that have a name column, whatever it is called."""
    targets = ("C_MktSegment", "P_Brand", "r_regionkey")
    return combine_sources(spark, d, ".parquet", "parquet", targets).rows


def folder_rejects(spark, d):
    """The given files that have none, with the rows left out for it."""
    rejects = combine_sources(spark, d, ".parquet", "parquet").rejects
    return rejects.select(
        F.substring_index("source", "/", -1).alias("Source_File"), "reason"
    ).join(folder_stack(spark, d).select("Source_File", "rows"), "Source_File")


def folder_stack(spark, d):
    """Rows per file of the stacked columns of all given files."""
    return (
        stack_folder(spark, d, ".parquet", "parquet")
        .rows.groupBy("Source_File")
        .agg(F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("with_doc_id"))
    )


def name_lookup(spark, d):
    people = R.recipients(spark, d).select(loose_title(F.col("Name")).alias("name_key"))
    customers = R.table(spark, d, "customer").select("c_custkey", "c_name")
    grants = (
        R.table(spark, d, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            loose_title(F.col("c_name")).alias("name_key"),
            F.col("o_orderkey").alias("grant_id"),
            F.col("o_orderpriority").alias("title"),
        )
    )
    found = lookup_names(people, grants)
    return found.select(
        "name_key", "grant_count", F.array_join("first_titles", "|").alias("first_titles")
    )


_named = ("region", "nation", "supplier", "customer", "part")
_all = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
_of_table = {"customer": "c_mktsegment", "part": "p_brand", "region": "r_regionkey::VARCHAR"}


def _folder_part(t: str) -> str:
    served = {"customer": "C_MktSegment", "part": "P_Brand", "region": "r_regionkey"}
    cells = ", ".join(
        f'{_of_table[o] if o == t else "NULL::VARCHAR"} AS "{alias}"' for o, alias in served.items()
    )
    return (
        f"SELECT lower(trim({t[0]}_name)) AS clean_name, "
        f"'Unknown' AS fiscal_year, '{t}.parquet' AS \"Source_File\", {cells} FROM {t}"
    )


QUERIES = {
    "q_name_enrich": (name_enrich, _ENRICHED_SQL),
    "q_match_rate": (
        match_rate,
        f"""SELECT count(*) AS total, count(*) FILTER (WHERE "{C.PRIMARY}" <> 'Not Found') AS enriched,
              100.0::DOUBLE * (count(*) FILTER (WHERE "{C.PRIMARY}" <> 'Not Found')::DOUBLE / count(*)) AS rate
            FROM ({_ENRICHED_SQL})""",
    ),
    "q_col_match_rate": (
        column_match_rate,
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE "{c}" <> 'Not Found') AS matched,
                  count(*) AS total,
                  100.0::DOUBLE * (count(*) FILTER (WHERE "{c}" <> 'Not Found')::DOUBLE / count(*)) AS rate
                FROM ({_ENRICHED_SQL})"""
            for c in C.NAME_ENRICHMENT
        ),
    ),
    "q_schema_union": (schema_union, R.YEAR_TABLES_SQL),
    "q_catalog_union": (
        catalog_union,
        f"SELECT clean_name, fiscal_year, {TARGETS} FROM ({R.YEAR_TABLES_SQL})",
    ),
    "q_folder_union": (folder_union, " UNION ALL ".join(map(_folder_part, _named))),
    "q_folder_rejects": (
        folder_rejects,
        " UNION ALL ".join(
            f"SELECT '{t}.parquet' AS \"Source_File\", 'no name column' AS reason, "
            f"count(*) AS rows FROM {t}"
            for t in _all
            if t not in _named
        ),
    ),
    "q_folder_stack": (
        folder_stack,
        " UNION ALL ".join(
            f"SELECT '{t}.parquet' AS \"Source_File\", count(*) AS rows, "
            f"{'count(doc_id)' if t in ('documents', 'labels') else '0'} AS with_doc_id FROM {t}"
            for t in _all
        ),
    ),
    "q_name_lookup": (
        name_lookup,
        f"""WITH g AS (SELECT {R.loose_sql("c_name")} AS name_key, o_orderkey, o_orderpriority,
                  row_number() OVER (PARTITION BY {R.loose_sql("c_name")} ORDER BY o_orderkey) AS rn
                FROM orders JOIN customer ON o_custkey = c_custkey)
            SELECT name_key, count(*) AS grant_count,
              string_agg(o_orderpriority, '|' ORDER BY o_orderkey) FILTER (WHERE rn <= 3) AS first_titles
            FROM g WHERE name_key IN (SELECT {R.loose_sql('"Name"')} FROM ({R.RECIPIENTS_SQL}))
            GROUP BY name_key""",
    ),
}
