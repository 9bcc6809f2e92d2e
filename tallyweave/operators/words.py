"""Word and length figures of the titles that found no match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import words


def average_length(df: DataFrame, title: str) -> DataFrame:
    """Number of rows and average title length, a missing title counting as 0."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.coalesce(F.length(title), F.lit(0))).alias("average_length"),
    )


def word_counts(df: DataFrame, title: str, longer_than: int = 3) -> DataFrame:
    """How often each word of more than ``longer_than`` characters occurs."""
    return (
        df.select(F.explode(words(F.col(title), longer_than)).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def top_words(counts: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent words, ties in alphabetical order."""
    return counts.orderBy(F.desc("occurrences"), "word").limit(n)


def sample_rows(df: DataFrame, key: Column, n: int = 5, seed: int = 0) -> DataFrame:
    """``n`` rows picked at random but the same on every run with one seed."""
    mixed = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))
    return df.orderBy(mixed, key).limit(n)
