"""Title keys, title enrichment and the diagnosis of what found no match."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import roles as R
from tallyweave import columns as C
from tallyweave.functions.text import loose_title, record_id, strict_title
from tallyweave.operators.dedupe import digest, duplicate_count, first_per_key, without_duplicates
from tallyweave.operators.fuzzy import best_edit_matches
from tallyweave.operators.partial import partial_matches
from tallyweave.operators.profile import sample_where
from tallyweave.operators.titles import (
    keep_known,
    one_per_title,
    stage_counts,
    title_keys,
    unmatched_keys,
    with_title_key,
    with_usable_key,
)
from tallyweave.operators.words import average_length, sample_rows, top_words, word_counts
from tallyweave.plans.diagnosis import diagnose_unmatched
from tallyweave.plans.title_enrichment import enrich_by_title
from tallyweave.runtime import cut


def norm_strict(spark, d):
    return R.texts(spark, d, "documents", "doc_id", "text").select(
        "doc_id", strict_title(F.col("text")).alias("title_key")
    )


def norm_loose(spark, d):
    return R.texts(spark, d, "documents", "doc_id", "text").select(
        "doc_id", loose_title(F.col("text")).alias("title_key")
    )


def _keyed(spark, d):
    outcomes = with_title_key(R.page_outcomes(spark, d), "Project_Title")
    grants = with_usable_key(R.line_grants(spark, d), C.TITLE_COLUMN)
    return outcomes, one_per_title(grants, C.TITLE_COLUMN)


def title_exact(spark, d):
    """Every outcome with every distinct raw title of its key."""
    outcomes, grants = _keyed(spark, d)
    return outcomes.join(grants, "title_key").select("outcome_id", "title_key", "grant_id")


def _grant_keys(spark, d):
    return with_usable_key(R.line_grants(spark, d), C.TITLE_COLUMN)


def title_unmatched(spark, d):
    outcomes = with_title_key(R.page_outcomes(spark, d), "Project_Title")
    return unmatched_keys(title_keys(outcomes), _grant_keys(spark, d))


def _open_titles(spark, d):
    outcomes, grants = _keyed(spark, d)
    grants = cut(grants.select("title_key", "grant_id"), "known")
    return (
        unmatched_keys(title_keys(outcomes), grants).withColumnRenamed("title_key", "title"),
        grants.select(F.col("title_key").alias("title"), "grant_id"),
    )


def title_fuzzy(spark, d):
    return best_edit_matches(*_open_titles(spark, d))


def title_enrich(spark, d):
    return enrich_by_title(R.page_outcomes(spark, d), R.line_grants(spark, d))


def title_enrich_all(spark, d):
    return enrich_by_title(R.page_outcomes(spark, d), R.line_grants(spark, d), mode="all")


def title_strict(spark, d):
    """Exact and near titles in the strict form, one row per grant of a title."""
    return enrich_by_title(
        R.page_outcomes(spark, d), R.line_grants(spark, d), mode="all", form="strict"
    )


def enrichment_subset(spark, d):
    """Grants that lack two of the enrichment columns."""
    grants = R.line_grants(spark, d).drop(C.FUNDING_START, C.FUNDING_END)
    return enrich_by_title(R.page_outcomes(spark, d), grants)


def unenriched_sample(spark, d):
    """The first five outcomes without a grant."""
    return sample_where(
        title_enrich(spark, d), F.col("match_stage") == "none", [F.col("outcome_id")]
    ).select("outcome_id", "Project_Title", "match_stage")


def diagnosis(spark, d):
    """The whole report on unmatched pages as rows of one shape."""
    number = F.col("outcome_id") % 3
    name = F.when(number == 0, "EN").when(number == 1, " fr").otherwise(F.col("Name"))
    unmatched = _unmatched(spark, d).select("outcome_id", name.alias("Name"), "Project_Title")
    grants = R.line_grants(spark, d).select(
        "grant_id", F.col(C.CATEGORIES).alias("name"), F.col(C.TITLE_COLUMN).alias("title")
    )
    report = diagnose_unmatched(unmatched, grants, sample=None)

    def rows(part, df, key, number, text=None):
        return df.select(
            F.lit(part).alias("part"),
            F.col(key).cast("string").alias("key"),
            F.col(number).cast("double").alias("number"),
            (F.lit(None).cast("string") if text is None else text).alias("note"),
        )

    lengths = report.lengths.withColumn("key", F.lit("average"))
    return (
        rows("lengths", lengths, "key", "average_length", F.col("rows").cast("string"))
        .unionByName(rows("words", report.words, "word", "occurrences"))
        .unionByName(
            rows("partial", report.partial, "title_id", "grant_id", F.col("match_type"))
        )
        .unionByName(
            rows(
                "names",
                report.names,
                "name_key",
                "grant_count",
                F.array_join("first_titles", "|"),
            )
        )
    )


def stages(spark, d):
    return stage_counts(title_enrich(spark, d))


def text_enrich(spark, d):
    """Whole documents as titles, up to ten edits apart."""
    return enrich_by_title(
        R.text_outcomes(spark, d), R.text_grants(spark, d), max_distance=10
    ).drop("matched_title")


def _unmatched(spark, d):
    outcomes = with_title_key(R.page_outcomes(spark, d), "Project_Title")
    known = _grant_keys(spark, d).select("title_key").distinct()
    return outcomes.join(known, "title_key", "left_anti")


def unmatched_length(spark, d):
    return average_length(_unmatched(spark, d), "Project_Title")


def unmatched_words(spark, d):
    return top_words(word_counts(_unmatched(spark, d), "title_key"))


def word_top(spark, d):
    """The most frequent words of all documents."""
    keyed = with_usable_key(R.texts(spark, d, "documents", "text"), "text")
    return top_words(word_counts(keyed, "title_key"))


def unmatched_sample(spark, d):
    return sample_rows(_unmatched(spark, d), F.col("outcome_id")).select(
        "outcome_id", "Project_Title"
    )


def partial(spark, d):
    lines = _grant_keys(spark, d).select("grant_id", F.col("title_key").alias("title"))
    lines = cut(lines, "line-titles")
    outcomes = with_title_key(R.page_outcomes(spark, d), "Project_Title")
    titles = outcomes.select(F.col("outcome_id").alias("title_id"), F.col("title_key").alias("title"))
    known = lines.select("title").distinct()
    return partial_matches(titles.join(known, "title", "left_anti"), lines)


def dedupe_titles(spark, d):
    """The document with the smallest id of every text."""
    documents = R.table(spark, d, "documents").select(
        "doc_id", "source", "lang", digest(F.col("text")).alias("text_digest")
    )
    return first_per_key(documents, ["text_digest"], [F.col("doc_id")]).drop("text_digest")


def duplicates(spark, d):
    return duplicate_count(R.table(spark, d, "documents").select("text", "lang"))


def dedupe_rows(spark, d):
    return without_duplicates(R.table(spark, d, "documents").select("text", "lang"))


def reconcile(spark, d):
    """Documents whose language and text occur among the labelled ones."""
    documents = R.table(spark, d, "documents").select("doc_id", "lang", "text")
    labelled = documents.join(R.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return keep_known(documents, labelled, record_id(F.col("lang"), F.col("text"))).select("doc_id")


def enriched_sample(spark, d):
    """The first five enriched outcomes."""
    return sample_where(
        title_enrich(spark, d), F.col("match_stage") != "none", [F.col("outcome_id")]
    ).select("outcome_id", "Primary_Institute", "match_stage")


_EDGES = f"""
  o AS ({R.PAGE_OUTCOMES_SQL}),
  g AS (SELECT * FROM ({R.LINE_GRANTS_SQL}) WHERE k IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY title ORDER BY grant_id) = 1),
  u AS (SELECT DISTINCT k FROM o WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM g))
"""


def _fuzzy_sql(k: int) -> str:
    return f"""
  f AS (SELECT * FROM (
          SELECT u.k, x.grant_id, x.k AS gk, levenshtein(u.k, x.k) AS distance
          FROM u JOIN (SELECT k, min(grant_id) AS grant_id FROM g GROUP BY k) x
            ON length(x.k) BETWEEN length(u.k) - {k} AND length(u.k) + {k})
        WHERE distance <= {k}
        QUALIFY row_number() OVER (PARTITION BY k ORDER BY distance, grant_id) = 1)
"""


_STAGED = f"""
  WITH {_EDGES}, {_fuzzy_sql(5)},
  e AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY grant_id DESC) = 1),
  a AS (SELECT k, grant_id, 'exact' AS match_stage, 0 AS distance FROM __EXACT__
        UNION ALL SELECT k, grant_id, 'fuzzy', distance FROM f)
  SELECT o.outcome_id, o."Name", o."Project_Title", g.p AS "Primary_Institute",
         g.c AS "Research_Categories", g.s AS "Funding_Start", g.e AS "Funding_End",
         a.grant_id, g.title AS matched_title,
         coalesce(a.match_stage, 'none') AS match_stage, a.distance
  FROM o LEFT JOIN a ON o.k = a.k LEFT JOIN g ON g.grant_id = a.grant_id
"""
_ONE = _STAGED.replace("__EXACT__", "e")
_ALL = _STAGED.replace("__EXACT__", "g")

_UNMATCHED = f"WITH {_EDGES} SELECT o.* FROM o WHERE k IS NULL OR k IN (SELECT k FROM u)"

_WORDS = "SELECT unnest(string_split(k, ' ')) AS word"

_LENGTH = f"""SELECT count(*) AS rows, avg(coalesce(length("Project_Title"), 0)) AS average_length
            FROM ({_UNMATCHED})"""
_TOP_WORDS = f"""SELECT word, count(*) AS occurrences FROM ({_WORDS} FROM ({_UNMATCHED}))
            WHERE length(word) > 3 GROUP BY word ORDER BY occurrences DESC, word LIMIT 10"""
_PARTIAL = f"""WITH {_EDGES},
              un AS (SELECT outcome_id, k FROM o WHERE k IS NULL OR k IN (SELECT k FROM u)),
              tw AS (SELECT DISTINCT outcome_id, w FROM (SELECT outcome_id, unnest(string_split(k, ' ')) AS w FROM un)
                     WHERE length(w) >= 5),
              gr AS (SELECT grant_id, k FROM ({R.LINE_GRANTS_SQL}) WHERE k IS NOT NULL),
              gw AS (SELECT DISTINCT grant_id, w FROM (SELECT grant_id, unnest(string_split(k, ' ')) AS w FROM gr)
                     WHERE length(w) >= 5),
              tv AS (SELECT DISTINCT w FROM tw), gv AS (SELECT DISTINCT w FROM gw),
              near AS (SELECT tv.w AS t, gv.w AS g, 1 AS kind FROM tv JOIN gv ON contains(gv.w, tv.w)
                       UNION ALL SELECT tv.w, gv.w, 2 FROM tv JOIN gv ON contains(tv.w, gv.w)),
              hits AS (SELECT DISTINCT tw.outcome_id, near.kind, gw.grant_id
                       FROM tw JOIN near ON tw.w = near.t JOIN gw ON gw.w = near.g),
              best AS (SELECT * FROM hits QUALIFY
                       row_number() OVER (PARTITION BY outcome_id ORDER BY grant_id, kind) <= 5)
            SELECT outcome_id AS title_id, best.grant_id, gr.k AS grant_title,
              CASE kind WHEN 1 THEN 'word_in_grant' ELSE 'word_in_unmatched' END AS match_type
            FROM best JOIN gr ON gr.grant_id = best.grant_id"""
_STRICT = _ALL
for _text in ("line", '"Project_Title"'):
    _STRICT = _STRICT.replace(R.loose_sql(_text), R.strict_sql(_text))

QUERIES = {
    "q_title_strict": (title_strict, _STRICT),
    "q_enrichment_subset": (
        enrichment_subset,
        f'SELECT * EXCLUDE ("Funding_Start", "Funding_End") FROM ({_ONE})',
    ),
    "q_unenriched_sample": (
        unenriched_sample,
        f"""SELECT outcome_id, "Project_Title", match_stage FROM ({_ONE})
            WHERE match_stage = 'none' ORDER BY outcome_id LIMIT 5""",
    ),
    "q_diagnosis": (
        diagnosis,
        f"""SELECT 'lengths' AS part, 'average' AS key, average_length AS number, rows::VARCHAR AS note
            FROM ({_LENGTH})
            UNION ALL SELECT 'words', word, occurrences, NULL FROM ({_TOP_WORDS})
            UNION ALL SELECT 'partial', title_id::VARCHAR, grant_id, match_type FROM ({_PARTIAL})
            UNION ALL
            SELECT 'names', c, n, first FROM (
              SELECT c, count(*) AS n, string_agg(title, '|' ORDER BY grant_id) FILTER (WHERE rn <= 3) AS first
              FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY grant_id) AS rn
                    FROM ({R.LINE_GRANTS_SQL}))
              WHERE c IN (SELECT unnest(['en', 'fr'])) GROUP BY c)""",
    ),
    "q_norm_spark": (
        norm_strict,
        f"SELECT doc_id, {R.strict_sql('text')} AS title_key FROM documents",
    ),
    "q_norm_local": (
        norm_loose,
        f"SELECT doc_id, {R.loose_sql('text')} AS title_key FROM documents",
    ),
    "q_title_exact": (
        title_exact,
        f"WITH {_EDGES} SELECT o.outcome_id, o.k AS title_key, g.grant_id FROM o JOIN g ON o.k = g.k",
    ),
    "q_title_unmatched": (title_unmatched, f"WITH {_EDGES} SELECT k AS title_key FROM u"),
    "q_title_fuzzy": (
        title_fuzzy,
        f"WITH {_EDGES}, {_fuzzy_sql(5)} SELECT k AS title, grant_id, gk AS grant_title, distance FROM f",
    ),
    "q_title_enrich": (title_enrich, _ONE),
    "q_title_enrich_all": (title_enrich_all, _ALL),
    "q_stage_counts": (
        stages,
        f"SELECT match_stage, count(*) AS rows FROM ({_ONE}) GROUP BY match_stage",
    ),
    "q_text_enrich": (
        text_enrich,
        f"""WITH o AS ({R.TEXT_OUTCOMES_SQL}),
              g AS (SELECT * FROM ({R.TEXT_GRANTS_SQL}) WHERE k IS NOT NULL
                    QUALIFY row_number() OVER (PARTITION BY title ORDER BY grant_id) = 1),
              u AS (SELECT DISTINCT k FROM o WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM g)),
              {_fuzzy_sql(10)},
              e AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY grant_id DESC) = 1),
              a AS (SELECT k, grant_id, 'exact' AS match_stage, 0 AS distance FROM e
                    UNION ALL SELECT k, grant_id, 'fuzzy', distance FROM f)
            SELECT o.outcome_id, o."Project_Title", g.p AS "Primary_Institute",
                   g.c AS "Research_Categories", a.grant_id,
                   coalesce(a.match_stage, 'none') AS match_stage, a.distance
            FROM o LEFT JOIN a ON o.k = a.k LEFT JOIN g ON g.grant_id = a.grant_id""",
    ),
    "q_unmatched_len": (unmatched_length, _LENGTH),
    "q_unmatched_words": (unmatched_words, _TOP_WORDS),
    "q_word_top": (
        word_top,
        f"""SELECT word, count(*) AS occurrences
            FROM ({_WORDS} FROM (SELECT {R.loose_sql('text')} AS k FROM documents))
            WHERE length(word) > 3 GROUP BY word ORDER BY occurrences DESC, word LIMIT 10""",
    ),
    "q_unmatched_sample": (
        unmatched_sample,
        f"""SELECT outcome_id, "Project_Title" FROM ({_UNMATCHED})
            ORDER BY md5(outcome_id::VARCHAR || ':0'), outcome_id LIMIT 5""",
    ),
    "q_partial": (partial, _PARTIAL),
    "q_dedupe_titles": (
        dedupe_titles,
        """SELECT doc_id, source, lang FROM documents
           QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
    ),
    "q_duplicates": (
        duplicates,
        """SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS distinct_rows,
             count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicates
           FROM documents""",
    ),
    "q_dedupe": (dedupe_rows, "SELECT DISTINCT text, lang FROM documents"),
    "q_reconcile": (
        reconcile,
        """SELECT doc_id FROM documents WHERE (lang || '_' || text) IN
             (SELECT lang || '_' || text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))""",
    ),
    "q_enriched_sample": (
        enriched_sample,
        f"""SELECT outcome_id, "Primary_Institute", match_stage FROM ({_ONE})
            WHERE match_stage <> 'none' ORDER BY outcome_id LIMIT 5""",
    ),
}
