"""From raw documents to packed token windows, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import ngram_join, packing, quality, secret_scan, toxicity
from tallyweave.llm.common import small
from tallyweave.runtime import cut, discard

# A document goes at this toxicity score or more, and below this quality score.
TOXIC, GOOD = 0.3, 0.3


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC``. Null text counts as empty."""
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    return model.score(docs).where(F.col("score") < TOXIC).select("row.*")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least ``GOOD``. Null text counts as empty."""
    model = quality.fit(docs, _labels(spark, sf_dir))
    return docs.where(model.score(F.col("text")) >= GOOD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at five words and a similarity of 0.8: the smallest id.

    Documents without words are no copies of each other and all stay. Of rows
    equal in id and text one stays; rows that share only the id are told apart by
    a hash of their text.
    """
    own = F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("of_text"))
    marked = docs.select(F.struct("*").alias("row"), own.alias("own"))
    groups = cut(
        ngram_join.join(marked.select(F.col("own").alias("doc_id"), "row.text"), 5, 80),
        "groups",
    )
    first = groups.where(F.col("doc_id") == F.col("component_id"))
    kept = cut(first.groupBy(F.col("doc_id").alias("own")).count(), "kept")
    discard(groups)
    once = small(kept.select("own"), 40)
    stay = marked.join(once, "own", "left_semi")
    again = kept.where(F.col("count") > 1).select("own")
    if again.take(1):
        repeated = marked.join(again, "own", "left_semi").dropDuplicates(["own"])
        stay = stay.join(again, "own", "left_anti").unionByName(repeated)
    return stay.select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked in ``text``; ``n_chars`` follows. Null stays null."""
    found = secret_scan.scan(docs)
    row, old = F.col("row"), F.col("row.text")
    changed = row.withField("text", secret_scan.redacted(old, F.col("spans")))
    if "n_chars" in docs.columns:
        length = F.char_length(changed["text"]).cast(docs.schema["n_chars"].dataType)
        changed = changed.withField(
            "n_chars", F.when(F.size("spans") > 0, length).otherwise(row["n_chars"])
        )
    return found.select(changed.alias("row")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of windows of 1024 ids, with the ids and their checksum."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

# Trained models and a tokenizer decide, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again; then what it read is deleted."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        discard(*read)
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
