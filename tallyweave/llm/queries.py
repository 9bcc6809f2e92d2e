"""Registered queries of the corpus operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.llm import (
    alignment,
    encoding,
    fingerprints,
    hard_negatives,
    license_scan,
    neighbours,
    ngram_join,
    notices,
    packing,
    quality,
    secret_scan,
    token_counts,
    toxicity,
    url_filter,
)
from tallyweave.llm.labels import fold


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def packing_digests(pieces):
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


def op1_packing(spark, d):
    return packing_digests(packing.pack(_table(spark, d, "documents")))


def op2_quality(spark, d):
    documents = _table(spark, d, "documents")
    model = quality.fit(documents, _table(spark, d, "labels"))
    scored = documents.select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        model.score(F.col("text")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_fingerprints(spark, d):
    return fingerprints.beside_next(_table(spark, d, "documents"))


def op4_encoding(spark, d):
    decoded = encoding.decode(encoding.encode(_table(spark, d, "documents")))
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op5_neighbours(spark, d):
    vectors = _table(spark, d, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op6_toxicity(spark, d):
    documents = _table(spark, d, "documents")
    model = toxicity.fit(documents, _table(spark, d, "labels"))
    scored = model.score(documents.select("doc_id", "text")).select(
        "row.doc_id", (fold(F.col("row.doc_id"), 4) == 2).alias("held_out"), "score"
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_licenses(spark, d):
    documents = _table(spark, d, "documents")
    found = license_scan.scan(documents, notices.NOTICES, alike=notices.ALIKE)
    names = F.array_sort(F.array_distinct(F.col("matches.license")))
    span = F.transform(
        "matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"])
    )
    return found.select(
        "doc_id",
        F.size("matches").cast("bigint").alias("n_matches"),
        F.array_join(names, ",").alias("licenses"),
        F.array_join(span, ",").alias("spans"),
    )


def op8_secrets(spark, d):
    found = secret_scan.scan(_table(spark, d, "documents"))

    def count(kind):
        same = F.filter("base", lambda s: s["kind"] == kind)
        return F.size(same).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "row.doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


def op9_url_filter(spark, d):
    pages = _table(spark, d, "pages")
    return url_filter.judge(pages, url_filter.mine(pages, _table(spark, d, "labels")))


def op10_ngram_join(spark, d):
    return ngram_join.join(_table(spark, d, "documents"), words=3, percent=90)


def op11_hard_negatives(spark, d):
    return hard_negatives.mine(_table(spark, d, "embeddings"))


HARD_NEGATIVES_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS code
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, a.label = r.label AS same,
         CAST(list_inner_product(CAST(a.code AS DOUBLE[]), CAST(r.code AS DOUBLE[])) AS BIGINT) AS score
  FROM usable a JOIN usable r ON a.vec_id <> r.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (
         PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""


def op12_alignment(spark, d):
    aligned = alignment.align(_table(spark, d, "documents"))
    return alignment.weigh(aligned, alignment.link_counts(aligned)).drop("place")


def op13_token_counts(spark, d):
    return token_counts.count_tokens(_table(spark, d, "documents"))


QUERIES = {
    "op1_packing": (op1_packing, None),
    "op2_quality": (op2_quality, None),
    "op3_fingerprints": (op3_fingerprints, None),
    "op4_encoding": (op4_encoding, None),
    "op5_neighbours": (op5_neighbours, None),
    "op6_toxicity": (op6_toxicity, None),
    "op7_licenses": (op7_licenses, None),
    "op8_secrets": (op8_secrets, None),
    "op9_url_filter": (op9_url_filter, None),
    "op10_ngram_join": (op10_ngram_join, None),
    "op11_hard_negatives": (op11_hard_negatives, HARD_NEGATIVES_SQL),
    "op12_alignment": (op12_alignment, None),
    "op13_token_counts": (op13_token_counts, None),
}
