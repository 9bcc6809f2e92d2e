"""Rules against a plain reading, and held-out accuracy on the given tables."""

import math

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import quality, queries
from tallyweave.llm.labels import fold

FOLDER = "/root/testdata/sf0.01"
LABELS = "doc_id bigint, quality int"


def test_paths():
    described = """RandomForest
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= 2.0)
      Predict: 0.0
     Else (feature 1 > 2.0)
      If (feature 0 <= 0.25)
       Predict: 1.0
      Else (feature 0 > 0.25)
       Predict: 0.0
    Else (feature 0 > 0.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 1 <= 1.0E-4)
     Predict: 0.0
    Else (feature 1 > 1.0E-4)
     Predict: 1.0
"""
    b = quality.Bound
    assert quality.paths(described, ["x", "y"]) == [
        (b("x", False, 0.5),),
        (b("x", False, 0.5), b("y", False, 2.0)),
        (b("x", False, 0.5), b("y", True, 2.0)),
        (b("x", False, 0.25), b("y", True, 2.0)),
        (b("x", False, 0.5), b("x", True, 0.25), b("y", True, 2.0)),
        (b("x", True, 0.5),),
        (b("y", False, 1e-4),),
        (b("y", True, 1e-4),),
    ]


def test_score_sums_the_rules_that_hold(spark):
    b = quality.Bound
    model = quality.RuleEnsemble(
        0.5, (((b("capitals", True, 0.2),), -2.0), ((b("log_chars", False, 2.0),), 1.0))
    )
    rows = [("ABCDEFGHIJ",), ("abcdefghij",), ("a",), ("",), (None,)]
    got = spark.createDataFrame(rows, "text string").select(model.score(F.col("text"))).collect()
    for (score,), z in zip(got, [-1.5, 0.5, 1.5, 1.5, 1.5], strict=True):
        assert score == pytest.approx(1 / (1 + math.exp(-z)))


def test_statistics_are_finite_on_odd_texts(spark):
    rows = [("",), (" \n ",), ("a" * 100_000,), ("漢字😀\x00",), ("no no no, NO!! %%% 12",)]
    df = spark.createDataFrame(rows, "text string")
    for row in df.select(*[v.alias(k) for k, v in quality.statistics(F.col("text")).items()]).collect():
        assert all(math.isfinite(v) for v in row)
    assert row.same_word_again == 1 / 7 and row.lone_signs == 1 / 7


def test_no_labels_and_one_class(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "doc_id bigint, text string")
    none = quality.fit(docs, spark.createDataFrame([], LABELS))
    assert [r[0] for r in docs.select(none.score(F.col("text"))).collect()] == [0.5] * 3
    rows = [(1, 1), (1, 1), (2, 1), (7, 0), (2, None), (None, 0)]
    one = quality.fit(docs, spark.createDataFrame(rows, LABELS), held=99)
    assert all(r[0] > 0.99 for r in docs.select(one.score(F.col("text"))).collect())
    assert quality.fit(docs.limit(0), spark.createDataFrame(rows, LABELS)).weighted == ()


def test_fold(spark):
    rows = spark.createDataFrame([(0,), (1,), (None,)], "i bigint").select(fold(F.col("i"), 5))
    import zlib

    assert [r[0] for r in rows.collect()] == [zlib.crc32(b"0") % 5, zlib.crc32(b"1") % 5, -1]


def test_held_out_accuracy(spark):
    scored = queries.op2_quality(spark, FOLDER).toPandas()
    assert scored.score.between(0, 1).all() and len(scored) == 1000
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas()
    held = scored[scored.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.93
