"""Rows for fitting: which may be learnt from, and bounded samples of them, with and without label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import narrow, small


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)), F.lit(-1))


def learning_rows(
    documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int
) -> DataFrame:
    """``text`` and ``label`` (0.0 or 1.0) of labelled rows outside the held-out fold.

    About ``most`` of them at most, chosen by a hash of the id, so the same rows
    are chosen whatever the partitions. Null labels, and ids without document,
    are left out; an id labelled twice counts twice.
    """
    usable = labels.select(
        F.col("doc_id").alias("label_id"), F.col(label).cast("double").alias("label")
    ).where(
        F.col("label").isin(0.0, 1.0)
        & F.col("label_id").isNotNull()
        & (fold(F.col("label_id"), folds) != held)
    )
    share = most / max(usable.count(), 1)
    place = F.pmod(F.xxhash64("label_id", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    chosen = usable.where(place < share)
    return (
        narrow(documents, "doc_id", "text")
        .join(small(chosen, 24), F.col("doc_id") == F.col("label_id"))
        .select("doc_id", "text", "label")
    )


def unlabelled_rows(
    documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int
) -> DataFrame:
    """``doc_id`` and ``text`` of documents without a label, outside the held-out fold.

    About ``most`` at most, chosen by a hash of the id before labelled ones are
    left out. An id counts as labelled if any of its labels is 0 or 1; rows
    without an id are left out.
    """
    rows = narrow(documents, "doc_id", "text")
    share = most / max(rows.count(), 1)
    place = F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(1 << 30)) / (1 << 30)
    chosen = rows.where(
        F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held) & (place < share)
    )
    given = labels.where(F.col(label).cast("double").isin(0.0, 1.0)).select("doc_id")
    known = given.join(small(chosen.select("doc_id").distinct(), 24), "doc_id", "left_semi")
    return chosen.join(known, "doc_id", "left_anti").select("doc_id", "text")
