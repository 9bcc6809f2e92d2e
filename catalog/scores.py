"""Competition codes, level scores, stored documents and their upsert."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import roles as R
from tallyweave import columns as C
from tallyweave.functions.levels import OUTCOME_TYPE, level_count, parsed, typed_count
from tallyweave.functions.text import code_year_month, edit_distance, file_slug, grant_date
from tallyweave.operators.dedupe import first_per_key
from tallyweave.operators.items import outcome_items
from tallyweave.operators.profile import profile_table, profile_tables, sample_values
from tallyweave.operators.titles import with_title_key
from tallyweave.plans.scoring import (
    FUNDING_KEY,
    combine_levels,
    read_outcomes,
    score_funding,
    score_outcomes,
    score_updates,
    stored_items,
    unreadable_outcomes,
    upsert_scores,
)
from tallyweave.runtime import cut, scratch_path
from tallyweave.sources.readers import (
    CORRUPT,
    find_tables,
    read_csv,
    read_json,
    read_table,
    split_rejects,
    with_corrupt_column,
)
from tallyweave.sources.writers import (
    read_latest_run,
    write_csv,
    write_json,
    write_json_per_person,
    write_parquet,
    write_run,
    write_table,
)

ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def code_parse(spark, d):
    parsed_code = code_year_month(F.col("code"))
    return R.coded_events(spark, d).select(
        "event_id",
        parsed_code["year"].alias("year"),
        parsed_code["month"].alias("month"),
        grant_date(F.col("code")).alias("grant_date"),
    )


def _flat_scores(df, *levels):
    return df.select(
        "researcher",
        "project",
        "grant_date",
        "primary_institute",
        "companies_analyzed",
        *[F.col(f"scores.level{n}").alias(f"level{n}") for n in levels],
        F.col("scores.total").alias("total"),
        F.col("scores.highest_level").alias("highest_level"),
    )


def scores125(spark, d):
    return _flat_scores(score_outcomes(R.scored_records(spark, d)), 1, 2, 5)


def _funding(spark, d):
    records = score_outcomes(R.scored_records(spark, d))
    return score_funding(records, R.funding_documents(spark, d))


def scores34(spark, d):
    return _flat_scores(_funding(spark, d), 3, 4)


def levels_repeated(spark, d):
    """Many records of one person, project and date, and the latest funding document of each."""
    events = R.scored_records(spark, d).withColumn("Project_Title", F.col("event_type"))
    funding = R.funding_documents(spark, d).withColumn("project", F.col("event_type"))
    latest = first_per_key(funding, FUNDING_KEY, [F.desc("event_id")])
    records = score_outcomes(events, keep=["event_id"])
    return combine_levels(score_funding(records, latest), keep=["event_id"]).select(
        "event_id", "grant_code", "grant_date", "level_details.*", "highest_level"
    )


def levels(spark, d):
    return combine_levels(_funding(spark, d)).select(
        "researcher",
        "project",
        "grant_date",
        "primary_institute",
        "level_details.*",
        "highest_level",
        F.col("level_descriptions")[F.col("highest_level").cast("string")].alias("description"),
    )


def json_counts(spark, d):
    return read_outcomes(R.scored_records(spark, d)).select(
        "event_id", "primary_institute", "ip_count", "companies_count", "exits_count"
    )


def unreadable(spark, d):
    return unreadable_outcomes(R.scored_records(spark, d)).select("event_id", "outcome_data")


def outcomes_of_name(spark, d):
    """The first records of one researcher."""
    return read_outcomes(R.scored_records(spark, d), "Researcher, 7", 10).select(
        *C.SCORE_KEY, "ip_count"
    )


def items(spark, d):
    return stored_items(R.scored_records(spark, d)).select(
        "Name",
        "Project_Title",
        "Competition_CD",
        "level",
        "item_no",
        "item_name",
        "item_type",
        "item_year",
        "item_party",
        "item_detail",
    )


def funding_items(spark, d):
    key = ["researcher", "project", "grant_date"]
    found = outcome_items(R.funding_documents(spark, d), key, "funding_data", (3, 4))
    return found.select(
        *key,
        "level",
        "item_no",
        "item_name",
        "item_type",
        "item_year",
        "item_party",
        "item_detail",
        "clinical_stage",
        "clinical_trial_year",
    )


def _stored(spark, d):
    """One stored record per researcher, event type and code, not scored yet."""
    return (
        R.coded_events(spark, d)
        .select(
            F.concat(F.lit("Researcher, "), F.col("user_id").cast("string")).alias("Name"),
            F.col("event_type").alias("Project_Title"),
            F.col("code").alias("Competition_CD"),
        )
        .distinct()
        .withColumns({c: F.lit(0) for c in C.SCORE_COLUMNS})
        .withColumn("outcome_data", F.lit(None).cast("string"))
    )


def upsert(spark, d):
    """Scores of most events; the latest event of a key counts."""
    events = R.scored_records(spark, d).where(F.col("k") % 7 != 3)
    records = score_outcomes(
        events.withColumn("Project_Title", F.col("event_type")), keep=["event_id"]
    )
    updates = score_updates(records, keep=["event_id"])
    return upsert_scores(_stored(spark, d), updates, [F.desc("event_id")]).drop("outcome_data")


def slugs(spark, d):
    return R.scored_records(spark, d).select("event_id", file_slug(F.col("Name")).alias("slug"))


def name_distance(spark, d):
    """Edit distance between the address and the title key of a page."""
    pages = with_title_key(R.page_outcomes(spark, d), "Project_Title")
    return pages.select(
        "outcome_id", edit_distance(F.col("Name"), F.col("title_key")).alias("distance")
    )


def profile(spark, d):
    return profile_tables({t: R.table(spark, d, t) for t in ALL_TABLES})


def profile_columns(spark, d):
    """Pages with their labels, of which many are missing; the sketched figures are left out."""
    labels = R.table(spark, d, "labels").select("doc_id", "toxic", "quality")
    pages = R.table(spark, d, "documents").join(labels, "doc_id", "left")
    return profile_table(pages).drop("distinct_about")


def profile_sample(spark, d):
    keys = {"nation": "n_nationkey", "documents": "doc_id", "region": "r_regionkey"}
    return sample_values({t: (R.table(spark, d, t), [key]) for t, key in keys.items()})


def json_files(spark, d):
    """Customers as files of one array each, and every nation as a file of one object."""
    path = scratch_path(spark, "customer-arrays")
    customer = F.struct("c_custkey", "c_name", "c_nationkey")
    lists = (
        R.table(spark, d, "customer")
        .groupBy((F.col("c_custkey") % 40).alias("part"))
        .agg(F.to_json(F.collect_list(customer)).alias("value"))
    )
    lists.write.partitionBy("part").text(f"{path}/arrays")
    nation = F.struct(F.lit(-1).alias("c_custkey"), F.col("n_name").alias("c_name"), F.col("n_nationkey").alias("c_nationkey"))
    nations = R.table(spark, d, "nation").select(F.col("n_nationkey").alias("part"), F.to_json(nation).alias("value"))
    nations.write.partitionBy("part").text(f"{path}/objects")
    shape = "c_custkey long, c_name string, c_nationkey long"
    return read_json(spark, f"{path}/*/*", shape, lines=False)


def csv_round_trip(spark, d):
    path = scratch_path(spark, "customer-csv")
    customers = R.table(spark, d, "customer")
    write_csv(customers, path)
    return read_csv(spark, path, customers.schema)


def csv_by_header(spark, d):
    """Two files whose columns differ in place, letter case and number, and their bad lines."""
    path = scratch_path(spark, "customer-files")
    nation = F.when(F.col("c_custkey") % 50 == 0, "n/a").otherwise(F.col("c_nationkey").cast("string"))
    customers = R.table(spark, d, "customer").withColumn("c_nationkey", nation)
    even = F.col("c_custkey") % 2 == 0
    write_csv(customers.where(even).select("c_custkey", "c_name", "c_nationkey"), f"{path}/even")
    turned = {"C_NATIONKEY": "c_nationkey", "segment": "c_mktsegment", "C_Name": "c_name", "C_CustKey": "c_custkey"}
    odd = customers.where(~even).select(*[F.col(c).alias(name) for name, c in turned.items()])
    write_csv(odd, f"{path}/odd")
    shape = T.StructType.fromDDL("c_custkey long, c_name string, c_nationkey int, c_phone string")
    lines = read_csv(spark, f"{path}/*", with_corrupt_column(shape))
    good, bad = split_rejects(cut(lines, "customer-lines"))
    return good.withColumn("line", F.lit(None).cast("string")).unionByName(
        bad.select(F.col(CORRUPT).alias("line")), allowMissingColumns=True
    )


def json_round_trip(spark, d):
    """Whole records, their document and nested scores among it."""
    path = scratch_path(spark, "records-json")
    rows = score_outcomes(R.scored_records(spark, d), keep=["event_id"])
    write_json(rows, path)
    back = read_json(spark, path, rows.schema)
    return back.select(
        "event_id",
        "researcher",
        "project",
        "grant_code",
        "companies_analyzed",
        "scores.*",
        level_count(parsed(F.col("data")), 1).alias("in_document"),
    )


def json_per_person(spark, d):
    path = scratch_path(spark, "person-json")
    rows = R.scored_records(spark, d).select("Name", "event_id", "k", "outcome_data")
    write_json_per_person(rows, path, "Name")
    shape = "Name string, event_id long, k int, outcome_data string, slug string"
    back = read_json(spark, path, shape)
    in_document = level_count(parsed(F.col("outcome_data")), 2)
    return back.withColumn("in_document", in_document).drop("outcome_data")


def table_round_trip(spark, d):
    """Suppliers as a managed table, replaced once, read back by name."""
    suppliers = R.table(spark, d, "supplier")
    name = f"tw_suppliers_{uuid.uuid4().hex}"
    write_table(suppliers.limit(0), name)
    write_table(suppliers, name)
    return read_table(spark, find_tables(spark, name)[0])


def typed_counts(spark, d):
    """List lengths of documents read with their types."""
    doc = F.from_json("outcome_data", OUTCOME_TYPE)
    typed = R.scored_records(spark, d).select("event_id", doc.alias("d"))
    return typed.select(
        "event_id",
        typed_count(F.col("d.level1_ip")).alias("n1"),
        typed_count(F.col("d.level2_companies")).alias("n2"),
        typed_count(F.col("d.level5_exits")).alias("n5"),
    )


def latest_run(spark, d):
    """Orders written as one run, with one more column as a newer one, and one left unfinished."""
    path = scratch_path(spark, "runs")
    orders = R.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    write_run(orders, path, "20240101_000000")
    wider = R.table(spark, d, "orders").select(
        "o_orderkey", F.lower("o_orderstatus").alias("o_orderstatus"), "o_orderpriority"
    )
    write_run(wider, path, "20240102_000000")
    # a newer run that has written some rows but is not finished
    write_parquet(orders.limit(10), f"{path}/run_id=20240103_000000")
    return read_latest_run(spark, path)


def _highest(pairs) -> str:
    return "CASE " + " ".join(f"WHEN {n} > 0 THEN {v}" for v, n in pairs) + " ELSE 0 END"


_RECORD = """'Researcher, ' || user_id AS researcher, 'Project ' || event_id AS project, grant_date,
  institute AS primary_institute"""
_COMPANIES = """CASE WHEN k % 11 = 3 OR k % 11 > 4 THEN coalesce((SELECT string_agg('Company ' || event_id || '-' || i, ', ' ORDER BY i)
  FROM range(1, n2 + 1) t(i)), '') END AS companies_analyzed"""
_HAS = "k % 11 > 2"

QUERIES = {
    "q_code_parse": (
        code_parse,
        f"""SELECT event_id, split_part(grant_date, '-', 1)::INT AS year,
              split_part(grant_date, '-', 2)::INT AS month, grant_date FROM ({R.CODED_EVENTS_SQL})""",
    ),
    "q_scores125": (
        scores125,
        f"""SELECT {_RECORD}, {_COMPANIES}, n1 AS level1, n2 AS level2, n5 AS level5,
              n1 + n2 + n5 AS total, {_highest([(5, "n5"), (2, "n2"), (1, "n1")])} AS highest_level
            FROM ({R.SCORED_SQL})""",
    ),
    "q_scores34": (
        scores34,
        f"""SELECT {_RECORD}, {_COMPANIES}, n3 AS level3, n4 AS level4, n3 + n4 AS total,
              {_highest([(4, "n4"), (3, "n3")])} AS highest_level
            FROM ({R.SCORED_SQL}) WHERE n2 > 0 AND k % 7 <> 3""",
    ),
    "q_levels": (
        levels,
        f"""SELECT *, CASE highest_level
              -- fixed values: what the levels mean
              WHEN 1 THEN 'Patents, copyright, trademarks'
              WHEN 2 THEN 'Companies opened'
              WHEN 3 THEN 'Series A funding round occurred; product in clinical stage I'
              WHEN 4 THEN 'Series B and C funding rounds occurred; product in clinical stage II, and III'
              WHEN 5 THEN 'Companies acquired/publicly listed (exit strategies for companies)' END AS description
            FROM (SELECT {_RECORD}, n1 AS level1, n2 AS level2, n3 AS level3, n4 AS level4, n5 AS level5,
              {_highest([(5, "n5"), (4, "n4"), (3, "n3"), (2, "n2"), (1, "n1")])} AS highest_level
            FROM ({R.SCORED_SQL}) WHERE n2 > 0 AND k % 7 <> 3)""",
    ),
    "q_levels_repeated": (
        levels_repeated,
        f"""WITH s AS ({R.SCORED_SQL}),
              f AS (SELECT user_id, event_type, grant_date, n3 AS f3, n4 AS f4 FROM s WHERE k % 7 <> 3
                    QUALIFY row_number() OVER (PARTITION BY user_id, event_type, grant_date
                                               ORDER BY event_id DESC) = 1)
            SELECT event_id, code AS grant_code, grant_date, n1 AS level1, n2 AS level2, f3 AS level3,
              f4 AS level4, n5 AS level5,
              {_highest([(5, "n5"), (4, "f4"), (3, "f3"), (2, "n2"), (1, "n1")])} AS highest_level
            FROM s JOIN f USING (user_id, event_type, grant_date) WHERE n2 > 0""",
    ),
    "q_json_counts": (
        json_counts,
        f"""SELECT event_id, institute AS primary_institute, n1 AS ip_count, n2 AS companies_count,
              n5 AS exits_count FROM ({R.SCORED_SQL}) WHERE {_HAS}""",
    ),
    "q_unreadable": (
        unreadable,
        """SELECT event_id, '{"level1_ip": [{}' AS outcome_data FROM events
           WHERE CAST(props->>'$.k' AS INT) % 11 = 4""",
    ),
    "q_outcomes_of_name": (
        outcomes_of_name,
        f"""SELECT "Name", "Project_Title", code AS "Competition_CD", n1 AS ip_count
            FROM ({R.SCORED_SQL}) WHERE {_HAS} AND "Name" = 'Researcher, 7'
            ORDER BY "Name", "Project_Title", code NULLS FIRST LIMIT 10""",
    ),
    "q_outcome_items": (
        items,
        f"""WITH r AS (SELECT *, code AS "Competition_CD" FROM ({R.SCORED_SQL}))
            SELECT "Name", "Project_Title", "Competition_CD", 1 AS level, i AS item_no,
              CASE WHEN i < 3 THEN 'IP ' || event_id || '-' || i ELSE 'Untitled' END AS item_name,
              CASE WHEN i > 1 THEN 'patent' ELSE 'IP' END AS item_type, k + 1950 AS item_year,
              event_type AS item_party,
              CASE WHEN i % 2 = 0 THEN 'About ' || event_id || '-' || i END AS item_detail
            FROM r, range(1, 7) t(i) WHERE i <= n1
            UNION ALL
            SELECT "Name", "Project_Title", "Competition_CD", 2, i, 'Company ' || event_id || '-' || i,
              CASE WHEN k % 2 = 0 THEN 'biotech' END, k + 1900, NULL, 'via ' || event_id || '-' || i
            FROM r, range(1, 7) t(i) WHERE i <= n2
            UNION ALL
            SELECT "Name", "Project_Title", "Competition_CD", 5, i, 'Company ' || event_id || '-' || i,
              CASE WHEN k % 5 = 0 THEN 'IPO' ELSE 'acquisition' END, k + 1970,
              CASE WHEN k % 5 <> 0 THEN 'Buyer' END, CASE WHEN i > 1 THEN k || 'M' END
            FROM r, range(1, 7) t(i) WHERE i <= n5""",
    ),
    "q_funding_items": (
        funding_items,
        f"""WITH r AS (SELECT *, 'Researcher, ' || user_id AS researcher, 'Project ' || event_id AS project
                       FROM ({R.SCORED_SQL}) WHERE k % 7 <> 3)
            SELECT researcher, project, grant_date, 3 AS level, i AS item_no,
              'Company ' || event_id || '-' || i AS item_name,
              CASE WHEN i > 1 THEN 'Pill' END AS item_type, k + 1990 AS item_year, NULL AS item_party,
              k || 'K' AS item_detail, NULL AS clinical_stage,
              CASE WHEN i = 1 THEN k + 2000 END AS clinical_trial_year
            FROM r, range(1, 7) t(i) WHERE i <= n3
            UNION ALL
            SELECT researcher, project, grant_date, 4, i, 'Company ' || event_id || '-' || i, 'B', k + 1995,
              'Pump', k || 'M', CASE WHEN i % 2 = 0 THEN 'II' END, k + 2001
            FROM r, range(1, 7) t(i) WHERE i <= n4""",
    ),
    "q_upsert": (
        upsert,
        f"""WITH s AS ({R.SCORED_SQL}),
              t AS (SELECT DISTINCT "Name", event_type AS "Project_Title", code AS "Competition_CD" FROM s),
              u AS (SELECT *, event_type AS pt,
                      {_highest([(5, "n5"), (2, "n2"), (1, "n1")])} AS highest FROM s
                    WHERE k % 7 <> 3 AND code IS NOT NULL
                    QUALIFY row_number() OVER (PARTITION BY "Name", event_type, code ORDER BY event_id DESC) = 1)
            SELECT t."Name", t."Project_Title", t."Competition_CD", coalesce(n1, 0) AS level_1_score,
              coalesce(n2, 0) AS level_2_score, coalesce(n5, 0) AS level_5_score,
              coalesce(highest, 0) AS total_score
            FROM t LEFT JOIN u ON t."Name" = u."Name" AND t."Project_Title" = u.pt
              AND t."Competition_CD" = u.code""",
    ),
    "q_slugs": (slugs, "SELECT event_id, 'Researcher_' || user_id AS slug FROM events"),
    "q_name_distance": (
        name_distance,
        f"""SELECT outcome_id, CASE WHEN abs(length("Name") - length(k)) > 10 THEN 999
              ELSE levenshtein("Name", k) END AS distance FROM ({R.PAGE_OUTCOMES_SQL})""",
    ),
    "q_profile": (
        profile,
        " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS row_count, "
            f"(SELECT count(*)::INT FROM (DESCRIBE {t})) AS column_count"
            for t in ALL_TABLES
        ),
    ),
    "q_profile_columns": (
        profile_columns,
        """WITH p AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))
           SELECT position, column_name, data_type, (SELECT count(*) FROM p) AS row_count,
             (SELECT count(*) FROM p) - filled AS null_count
           FROM (VALUES (1, 'doc_id', 'bigint', (SELECT count(doc_id) FROM p)),
                        (2, 'text', 'string', (SELECT count(text) FROM p)),
                        (3, 'lang', 'string', (SELECT count(lang) FROM p)),
                        (4, 'source', 'string', (SELECT count(source) FROM p)),
                        (5, 'n_chars', 'bigint', (SELECT count(n_chars) FROM p)),
                        (6, 'toxic', 'int', (SELECT count(toxic) FROM p)),
                        (7, 'quality', 'int', (SELECT count(quality) FROM p))) v(position, column_name, data_type, filled)""",
    ),
    "q_profile_sample": (
        profile_sample,
        " UNION ALL ".join(
            f"""SELECT '{t}' AS table_name, row_no::INT AS row_no, {i} AS position, '{c}' AS column_name, {c}::VARCHAR AS value
                FROM (SELECT *, row_number() OVER (ORDER BY {columns[0]}) AS row_no FROM {t}) WHERE row_no <= 5"""
            for t, columns in {
                "nation": ["n_nationkey", "n_name", "n_regionkey"],
                "documents": ["doc_id", "text", "lang", "source", "n_chars"],
                "region": ["r_regionkey", "r_name"],
            }.items()
            for i, c in enumerate(columns, start=1)
        ),
    ),
    "q_json_files": (
        json_files,
        """SELECT c_custkey, c_name, c_nationkey FROM customer
           UNION ALL SELECT -1, n_name, n_nationkey FROM nation""",
    ),
    "q_csv_round_trip": (
        csv_round_trip,
        "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    ),
    "q_csv_by_header": (
        csv_by_header,
        """SELECT c_custkey, c_name, c_nationkey, NULL::VARCHAR AS c_phone, NULL::VARCHAR AS line
             FROM customer WHERE c_custkey % 50 <> 0
           UNION ALL SELECT NULL, NULL, NULL, NULL, c_custkey || ',' || c_name || ',n/a'
             FROM customer WHERE c_custkey % 50 = 0""",
    ),
    "q_json_round_trip": (
        json_round_trip,
        f"""SELECT event_id, 'Researcher, ' || user_id AS researcher, 'Project ' || event_id AS project,
              code AS grant_code, {_COMPANIES}, n1 AS level1, n2 AS level2, n5 AS level5,
              n1 + n2 + n5 AS total, {_highest([(5, "n5"), (2, "n2"), (1, "n1")])} AS highest_level,
              n1 AS in_document FROM ({R.SCORED_SQL})""",
    ),
    "q_json_per_person": (
        json_per_person,
        f"""SELECT "Name", event_id, k, 'Researcher_' || user_id AS slug, n2 AS in_document
            FROM ({R.SCORED_SQL})""",
    ),
    "q_table_round_trip": (table_round_trip, "SELECT * FROM supplier"),
    "q_typed_counts": (
        typed_counts,
        f"SELECT event_id, n1, n2, n5 FROM ({R.SCORED_SQL})",
    ),
    "q_latest_run": (
        latest_run,
        "SELECT o_orderkey, lower(o_orderstatus) AS o_orderstatus, o_orderpriority FROM orders",
    ),
}
