"""The given tables in the roles the library works on.

recipients   customers and suppliers, some names padded and in capitals
year tables  orders with their customer, one table per order year, columns drifting
grants       every line of every document, as a title
outcomes     every web page, by its title
texts        whole documents: those with a label are outcomes, the others grants
scored       one record per event, with a JSON document made from it
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave import columns as C
from tallyweave.functions.text import grant_date
from tallyweave.runtime import cut

FIRST_YEAR, LAST_YEAR = 1995, 2001


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return table(spark, d, name).select(*columns)


def recipients(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select(
        F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")))
        .otherwise(F.col("c_name"))
        .alias("Name"),
        F.col("c_custkey").alias("recipient_key"),
    )
    suppliers = table(spark, d, "supplier").select(
        F.col("s_name").alias("Name"), F.col("s_suppkey").alias("recipient_key")
    )
    return customers.unionByName(suppliers)


RECIPIENTS_SQL = """
  SELECT CASE WHEN c_nationkey % 2 = 0 THEN '  ' || upper(c_name) || ' ' ELSE c_name END AS "Name",
         c_custkey AS recipient_key FROM customer
  UNION ALL SELECT s_name, s_suppkey FROM supplier
"""


def year_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Tables by name. The first and last also take any year before or after."""
    names = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    orders = table(spark, d, "orders")
    ordered = F.col("o_orderdate")
    frames = {}
    for year in range(FIRST_YEAR, LAST_YEAR + 1):
        its = F.lit(True)
        if year > FIRST_YEAR:
            its = its & (ordered >= F.lit(f"{year}-01-01").cast("timestamp"))
        if year < LAST_YEAR:
            its = its & (ordered < F.lit(f"{year + 1}-01-01").cast("timestamp"))
        rows = orders.where(ordered.isNotNull() & its).join(
            names, F.col("o_custkey") == F.col("c_custkey")
        )
        name = F.col("c_name").alias(
            {0: C.NAME_CANDIDATES[1], 1: C.NAME_CANDIDATES[0], 2: "recipient_name"}[year % 3]
        )
        primary = F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias(
            C.PRIMARY.lower() if year == 1998 else C.PRIMARY
        )
        columns = [name, primary, F.col("c_mktsegment").alias(C.CATEGORIES)]
        if year != 1996:
            columns.append(F.col("o_orderstatus").alias(C.KEYWORDS))
        frames[f"recipients_{year}_{(year + 1) % 100:02d}"] = rows.select(*columns)
    return frames


_year = f"greatest({FIRST_YEAR}, least({LAST_YEAR}, year(o_orderdate)))"
YEAR_TABLES_SQL = f"""
  SELECT lower(trim(c_name)) AS clean_name,
         {_year} || '-' || lpad((({_year} + 1) % 100)::VARCHAR, 2, '0') AS fiscal_year,
         nullif(o_orderpriority, '4-NOT SPECIFIED') AS "{C.PRIMARY}",
         c_mktsegment AS "{C.CATEGORIES}",
         CASE WHEN {_year} <> 1996 THEN o_orderstatus END AS "{C.KEYWORDS}"
  FROM orders JOIN customer ON o_custkey = c_custkey
"""


def line_grants(spark: SparkSession, d: str) -> DataFrame:
    documents = texts(spark, d, "documents", "doc_id", "lang", "source", "n_chars", "text")
    lines = documents.select(
        "doc_id", "lang", "source", "n_chars", F.posexplode(F.split("text", "\n")).alias("at", "line")
    )
    return lines.select(
        (F.col("doc_id") * 1000000 + F.col("at")).alias("grant_id"),
        F.col("line").alias(C.TITLE_COLUMN),
        F.col("source").alias(C.PRIMARY),
        F.col("lang").alias(C.CATEGORIES),
        F.col("doc_id").cast("string").alias(C.FUNDING_START),
        F.col("n_chars").cast("string").alias(C.FUNDING_END),
    )


def page_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d, "pages", "page_id", "url", "html").select(
        F.col("page_id").alias("outcome_id"),
        F.regexp_extract("url", "//([^/]+)", 1).alias("Name"),
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("Project_Title"),
        F.lit("earlier").alias("Primary_Institute"),
    )


# Title keys in the other engine: the characters Unicode counts as white space.
_white = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def loose_sql(text: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(lower({text}), '[^a-z0-9{_white}]', '', 'g'),"
        f" '[{_white}]+', ' ', 'g'))"
    )


def strict_sql(text: str) -> str:
    white = r"\t-\r "
    return (
        f"lower(regexp_replace(regexp_replace(trim({text}), '[^a-zA-Z0-9{white}]', '', 'g'),"
        f" '[{white}]+', ' ', 'g'))"
    )


LINE_GRANTS_SQL = f"""
  SELECT doc_id * 1000000 + place - 1 AS grant_id, line AS title, nullif({loose_sql("line")}, '') AS k,
         source AS p, lang AS c, doc_id::VARCHAR AS s, n_chars::VARCHAR AS e
  FROM (SELECT doc_id, lang, source, n_chars, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents)
"""
PAGE_OUTCOMES_SQL = f"""
  SELECT outcome_id, "Name", "Project_Title", nullif({loose_sql('"Project_Title"')}, '') AS k
  FROM (SELECT page_id AS outcome_id, regexp_extract(url, '//([^/]+)', 1) AS "Name",
               regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS "Project_Title" FROM pages)
"""


def text_grants(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "labels").select("doc_id")
    return _documents(spark, d).join(labelled, "doc_id", "left_anti").select(
        F.col("doc_id").alias("grant_id"),
        F.col("text").alias(C.TITLE_COLUMN),
        F.col("source").alias(C.PRIMARY),
        F.col("lang").alias(C.CATEGORIES),
    )


def text_outcomes(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "labels").select("doc_id")
    return _documents(spark, d).join(labelled, "doc_id", "left_semi").select(
        F.col("doc_id").alias("outcome_id"), F.col("text").alias("Project_Title")
    )


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d, "documents", "doc_id", "text", "source", "lang")


TEXT_GRANTS_SQL = f"""
  SELECT doc_id AS grant_id, text AS title, nullif({loose_sql("text")}, '') AS k, source AS p, lang AS c
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
"""
TEXT_OUTCOMES_SQL = f"""
  SELECT doc_id AS outcome_id, text AS "Project_Title", nullif({loose_sql("text")}, '') AS k
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
"""


def coded_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with the number ``k`` of their properties and a competition code, some broken."""
    events = texts(spark, d, "events", "event_id", "user_id", "event_type", "props", "ts").select(
        "event_id",
        "user_id",
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.date_format("ts", "yyyyMM").alias("month"),
    )
    part = F.col("k") % 10
    code = (
        F.when(part == 0, F.lit("20AB09"))
        .when(part == 1, F.lit(None))
        .when(part == 2, F.lit("2024"))
        .when(part == 3, F.lit("202499X"))
        .otherwise(F.concat("month", F.lit("PJT")))
    )
    return events.withColumn("code", code)


def _list(n, item):
    return F.transform(F.filter(F.sequence(F.lit(1), F.lit(6)), lambda i: i <= n), item)


def scored_records(spark: SparkSession, d: str) -> DataFrame:
    """One record per event; its document is JSON text, absent, odd or broken for some.

    Written first, as such records are read from a table.
    """
    k = F.col("k")
    label = lambda kind, i: F.concat(F.lit(kind), "event_id", F.lit("-"), i.cast("string"))
    ip = _list(
        k % 7,
        lambda i: F.struct(
            F.when(i < 3, label("IP ", i)).alias("title"),
            F.when(i > 1, F.lit("patent")).alias("type"),
            (k + 1950).alias("filing_year"),
            F.col("event_type").alias("assignee"),
            F.when(i % 2 == 0, label("About ", i)).alias("description"),
        ),
    )
    companies = _list(
        k % 5,
        lambda i: F.struct(
            label("Company ", i).alias("company_name"),
            (k + 1900).alias("founding_year"),
            F.when(k % 2 == 0, F.lit("biotech")).alias("industry"),
            label("via ", i).alias("connection"),
        ),
    )
    exits = _list(
        k % 3,
        lambda i: F.struct(
            label("Company ", i).alias("company_name"),
            F.when(k % 5 == 0, F.lit("IPO")).otherwise("acquisition").alias("exit_type"),
            F.lit("Buyer").alias("acquirer"),
            (k + 1970).alias("exit_year"),
            F.when(i > 1, F.concat(k.cast("string"), F.lit("M"))).alias("value"),
        ),
    )
    whole = F.to_json(
        F.struct(
            F.col("event_type").alias("primary_institute"),
            ip.alias("level1_ip"),
            companies.alias("level2_companies"),
            exits.alias("level5_exits"),
        )
    )
    odd = F.concat(
        F.lit('{"level1_ip": {"title": "no list"}, "level2_companies": '), F.to_json(companies), F.lit("}")
    )
    part = k % 11
    document = (
        F.when(part == 0, F.lit("null"))
        .when(part == 1, F.lit("{}"))
        .when(part == 2, F.lit(None))
        .when(part == 3, odd)
        .when(part == 4, F.lit('{"level1_ip": [{}'))
        .otherwise(whole)
    )
    records = coded_events(spark, d).select(
        F.concat(F.lit("Researcher, "), F.col("user_id").cast("string")).alias("Name"),
        F.concat(F.lit("Project "), F.col("event_id").cast("string")).alias("Project_Title"),
        F.col("code").alias("Competition_CD"),
        document.alias("outcome_data"),
        "event_id",
        "event_type",
        "k",
    )
    return cut(records, "scored")


CODED_EVENTS_SQL = """
  SELECT event_id, user_id, event_type, k,
         CASE k % 10 WHEN 0 THEN '20AB09' WHEN 1 THEN NULL WHEN 2 THEN '2024' WHEN 3 THEN '202499X'
              ELSE strftime(ts, '%Y%m') || 'PJT' END AS code,
         CASE k % 10 WHEN 0 THEN '2017-09' WHEN 1 THEN '2017-09' WHEN 2 THEN '2017-09'
              WHEN 3 THEN '2024-99' ELSE strftime(ts, '%Y-%m') END AS grant_date
  FROM (SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events)
"""
# The counts follow from k; the documents themselves are not needed.
SCORED_SQL = f"""
  SELECT *, 'Researcher, ' || user_id AS "Name", 'Project ' || event_id AS "Project_Title",
         CASE WHEN k % 11 > 4 THEN k % 7 ELSE 0 END AS n1,
         CASE WHEN k % 11 = 3 OR k % 11 > 4 THEN k % 5 ELSE 0 END AS n2,
         CASE WHEN k % 11 > 4 THEN k % 3 ELSE 0 END AS n5,
         CASE WHEN k % 11 > 4 THEN event_type END AS institute,
         (k // 4) % 5 AS n3, (k // 12) % 4 AS n4
  FROM ({CODED_EVENTS_SQL})
"""


def funding_documents(spark: SparkSession, d: str) -> DataFrame:
    """Funding documents of most events, keyed like the records."""
    k = F.col("k")
    name = lambda i: F.concat(F.lit("Company "), "event_id", F.lit("-"), i.cast("string"))
    series_a = _list(
        F.floor(k / 4) % 5,
        lambda i: F.struct(
            name(i).alias("company_name"),
            (k + 1990).alias("funding_year"),
            F.concat(k.cast("string"), F.lit("K")).alias("funding_amount"),
            F.when(i > 1, F.lit("Pill")).alias("product_name"),
            F.when(i == 1, k + 2000).alias("clinical_trial_year"),
        ),
    )
    series_bc = _list(
        F.floor(k / 12) % 4,
        lambda i: F.struct(
            name(i).alias("company_name"),
            F.lit("B").alias("funding_round"),
            (k + 1995).alias("funding_year"),
            F.concat(k.cast("string"), F.lit("M")).alias("funding_amount"),
            F.lit("Pump").alias("product_name"),
            F.when(i % 2 == 0, F.lit("II")).alias("clinical_stage"),
            (k + 2001).alias("clinical_trial_year"),
        ),
    )
    document = F.to_json(
        F.struct(series_a.alias("level3_series_a"), series_bc.alias("level4_series_bc"))
    )
    return (
        coded_events(spark, d)
        .where(k % 7 != 3)
        .select(
            "event_id",
            "event_type",
            F.concat(F.lit("Researcher, "), F.col("user_id").cast("string")).alias("researcher"),
            F.concat(F.lit("Project "), F.col("event_id").cast("string")).alias("project"),
            grant_date(F.col("code")).alias("grant_date"),
            document.alias("funding_data"),
        )
    )
