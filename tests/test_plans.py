"""The plans Spark makes of the operations: no pair-wise joins, early limits, pushed filters."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from catalog import names, titles
from catalog import roles as R
from tallyweave.operators.dedupe import first_per_key
from tallyweave.operators.fuzzy import best_edit_matches
from tallyweave.operators.partial import partial_matches
from tallyweave.operators.words import top_words, word_counts
from tallyweave.plans.scoring import read_outcomes, score_outcomes


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "t")
    spark.createDataFrame(
        [("n", "p", "201709X", "{}", "unused")],
        "Name string, Project_Title string, Competition_CD string, outcome_data string, other string",
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_first_per_key_drops_rows_before_the_shuffle(spark):
    rows = spark.range(10).withColumn("k", F.col("id") % 3)
    text = plan(first_per_key(rows, ["k"], [F.col("id")]))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_matching_forms_no_product(spark):
    titles = spark.createDataFrame([("gene therapy one",)], "title string")
    grants = spark.createDataFrame([(1, "gene therapy two")], "grant_id int, title string")
    near = best_edit_matches(titles, grants)
    parts = partial_matches(titles.withColumn("title_id", F.lit(1)), grants)
    for df in (near, parts):
        text = plan(df)
        assert "Cartesian" not in text and "NestedLoop" not in text


def test_stored_filters_reach_the_files(stored):
    text = plan(read_outcomes(stored, "n").select("ip_count"))
    assert "EqualTo(Name,n)" in text
    assert "IsNotNull(outcome_data)" in text and "Not(EqualTo(outcome_data,{}))" in text
    assert "ReadSchema: struct<Name:string,outcome_data:string>" in text


def test_scoring_reads_its_columns_only_and_shuffles_nothing(stored):
    text = plan(score_outcomes(stored).select("researcher", "scores"))
    assert "ReadSchema: struct<Name:string,outcome_data:string>" in text
    assert "Exchange" not in text


def test_top_words_keep_few_rows_per_task(spark):
    rows = spark.createDataFrame([("gene gene",)], "t string")
    assert "TakeOrderedAndProject" in plan(top_words(word_counts(rows, "t")))


SMALL = "/root/testdata/sf0.001"
given_tables = pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables not present")


@given_tables
def test_yearly_tables_are_written_before_they_are_joined(spark):
    text = plan(names.name_enrich(spark, SMALL))
    assert "orders.parquet" not in text and "silver-" in text
    frames = R.year_tables(spark, SMALL).values()
    assert all("LessThan(o_orderdate" in plan(f) or "GreaterThan" in plan(f) for f in frames)


@given_tables
@pytest.mark.parametrize("query", [titles.dedupe_rows, titles.title_fuzzy, titles.text_enrich])
def test_no_text_is_a_key_of_a_shuffle_or_sort(spark, query):
    text = plan(query(spark, SMALL))
    keys = re.findall(r"hashpartitioning\((.*?)\)", text) + re.findall(r"Sort \[(.*?)\]", text)
    assert keys
    whole = re.compile(r"\b(text|title|title_key|matched_title|grant_title|Project_Title)#")
    assert not [k for k in keys if whole.search(k)]


@given_tables
def test_unmatched_queries_need_no_window(spark):
    for query in (titles.unmatched_length, titles.unmatched_words, titles.title_unmatched):
        assert "Window" not in plan(query(spark, SMALL))
