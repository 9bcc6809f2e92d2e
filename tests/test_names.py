import pytest
from pyspark.sql import functions as F

from tallyweave import columns as C
from tallyweave.operators.joins import join_to_single, left_join_many
from tallyweave.operators.names import lookup_names
from tallyweave.plans.name_enrichment import enrich_by_name


def test_left_join_keeps_everything(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, l int")
    right = spark.createDataFrame([("a", 8), ("a", 9), (None, 7), ("z", 6)], "k string, r int")
    got = {(r.k, r.l, r.r, r.matched) for r in left_join_many(left, right, "k").collect()}
    assert got == {
        ("a", 1, 8, True),
        ("a", 1, 9, True),
        ("a", 2, 8, True),
        ("a", 2, 9, True),
        ("b", 3, None, False),
        (None, 4, None, False),
    }


def test_enrich_by_name(spark):
    gold = spark.createDataFrame([(" Ann ",), ("BO",), ("Cy",), (None,)], "Name string")
    silver = spark.createDataFrame(
        [("ann", "2010-11", "p1", "c1"), ("ann", "2011-12", None, "c2"), ("bo", "2010-11", "p2", None)],
        ["clean_name", "fiscal_year", C.PRIMARY, C.CATEGORIES],
    )
    out = enrich_by_name(gold, silver)
    got = {(r.clean_name, r.fiscal_year, r[C.PRIMARY], r[C.CATEGORIES], r.matched) for r in out.rows.collect()}
    assert got == {
        ("ann", "2010-11", "p1", "c1", True),
        ("ann", "2011-12", "Not Found", "c2", True),
        ("bo", "2010-11", "p2", "Not Found", True),
        ("cy", None, "Not Found", "Not Found", False),
        (None, None, "Not Found", "Not Found", False),
    }
    assert tuple(out.rate.first()) == (5, 2, 40.0)
    assert {r.column_name: r.matched for r in out.column_rates.collect()} == {
        C.PRIMARY: 2,
        C.CATEGORIES: 2,
    }
    nobody = enrich_by_name(gold.limit(0), silver)
    assert tuple(nobody.rate.first()) == (0, 0, 0.0)


def test_lookup_names(spark):
    people = spark.createDataFrame([("ann",), ("ann",), ("bo",), ("",), (None,)], "name_key string")
    grants = spark.createDataFrame(
        [("ann", i, f"t{i}") for i in (5, 3, 9, 1)] + [("", 7, "blank"), (None, 8, "none"), ("cy", 2, "t")],
        "name_key string, grant_id int, title string",
    )
    got = [tuple(r) for r in lookup_names(people, grants).collect()]
    assert got == [("ann", 4, ["t1", "t3", "t5"])]


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti", "inner"])
def test_hot_keys_are_split(spark, how):
    """A key with most of the rows is spread over several tasks, on either side."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        hot = F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
        many = spark.range(0, 40000, 1, 8).select(hot.alias("k"), F.col("id").alias("v"))
        few = spark.range(0, 600, 1, 8).select(
            F.when(F.col("id") == 1, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
            (F.col("id") * 2).alias("w"),
        )
        if how == "inner":
            out = left_join_many(few, many, "k")
        else:
            out = join_to_single(many, few.groupBy("k").agg(F.max("w").alias("w")), ["k"], how)
        rows = out.count()
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    expected = many.join(few, "k", "left" if how == "inner" else how).count()
    if how == "inner":
        expected = few.join(many, "k", "left").count()
    assert rows == expected
    assert "SortMergeJoin(skew=true)" in plan
