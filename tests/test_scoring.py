import json

from pyspark.sql import functions as F

from tallyweave.functions import levels as L
from tallyweave.operators.items import outcome_items
from tallyweave.operators.profile import profile_table, profile_tables, sample_values, sample_where
from tallyweave.plans.scoring import (
    combine_levels,
    read_outcomes,
    score_funding,
    score_outcomes,
    score_updates,
    stored_items,
    unreadable_outcomes,
    upsert_scores,
)

DOC = {
    "primary_institute": "Brain",
    "level1_ip": [{"title": "T1", "type": "patent", "filing_year": 2020}, {"assignee": None}],
    "level2_companies": [{"company_name": "A Inc."}, {"company_name": "B Corp."}],
    "level5_exits": [{"company_name": "A Inc.", "exit_type": "IPO", "exit_year": 2019, "acquirer": "Z"}],
}
FUNDING = {
    "level3_series_a": [{"company_name": "B Corp.", "funding_year": 2022, "clinical_trial_year": None}],
    "level4_series_bc": [],
}


def stored(spark, *documents):
    rows = [
        ("Doe, Jane", f"Project {i}", "201709PJT", d if isinstance(d, str) or d is None else json.dumps(d))
        for i, d in enumerate(documents)
    ]
    return spark.createDataFrame(
        rows, "Name string, Project_Title string, Competition_CD string, outcome_data string"
    )


def test_golden_levels_125(spark):
    r = score_outcomes(stored(spark, DOC)).first()
    assert r.scores.asDict() == {"level1": 2, "level2": 2, "level5": 1, "total": 5, "highest_level": 5}
    assert (r.grant_date, r.primary_institute, r.companies_analyzed) == ("2017-09", "Brain", "A Inc., B Corp.")


def test_odd_documents_score_zero(spark):
    docs = [None, "null", "{}", "no json", "[]", {"level1_ip": {"title": "x"}}, {"level2_companies": "[1]"}, {"level1_ip": None}]
    assert [r.scores.total for r in score_outcomes(stored(spark, *docs)).collect()] == [0] * len(docs)


def test_highest_levels(spark):
    docs = [
        {"level1_ip": [{}]},
        {"level1_ip": [{}], "level2_companies": [{}]},
        {"level5_exits": [{}, {}, {}], "level1_ip": [{}]},
    ]
    out = score_outcomes(stored(spark, *docs)).collect()
    assert [r.scores.highest_level for r in out] == [1, 2, 5]
    assert [r.scores.total for r in out] == [1, 2, 4]


def test_golden_levels_34_and_combined(spark):
    records = score_outcomes(stored(spark, DOC, {"level1_ip": [{}]}))
    funding = spark.createDataFrame(
        [("Doe, Jane", f"Project {i}", "2017-09", json.dumps(FUNDING)) for i in (0, 1)],
        "researcher string, project string, grant_date string, funding_data string",
    )
    scored = score_funding(records, funding)
    rows = scored.collect()  # the second record lists no company
    assert [r.project for r in rows] == ["Project 0"]
    assert rows[0].scores.asDict() == {"level3": 1, "level4": 0, "total": 1, "highest_level": 3}
    assert rows[0].companies_analyzed == "A Inc., B Corp."
    both = combine_levels(scored).collect()
    assert len(both) == 1
    assert list(both[0].level_details) == [2, 2, 1, 0, 1] and both[0].highest_level == 5
    assert both[0].level_descriptions == {str(k): v for k, v in L.LEVEL_DESCRIPTIONS.items()}


def test_records_of_one_key_stay_apart(spark):
    """Unreadable codes share a date; each record keeps its own levels, NULLs in the key match."""
    docs = [DOC, {"level2_companies": [{}]}, DOC]
    rows = [
        ("A", "P", "bad1", json.dumps(docs[0])),
        ("A", "P", "bad2", json.dumps(docs[1])),
        (None, "P", "bad1", json.dumps(docs[2])),
    ]
    records = score_outcomes(
        spark.createDataFrame(
            rows, "Name string, Project_Title string, Competition_CD string, outcome_data string"
        )
    )
    funding = spark.createDataFrame(
        [(n, "P", "2017-09", json.dumps(FUNDING)) for n in ("A", None)],
        "researcher string, project string, grant_date string, funding_data string",
    )
    got = combine_levels(score_funding(records, funding)).collect()
    assert sorted((r.researcher or "", r.grant_code, list(r.level_details)) for r in got) == [
        ("", "bad1", [2, 2, 1, 0, 1]),
        ("A", "bad1", [2, 2, 1, 0, 1]),
        ("A", "bad2", [0, 1, 1, 0, 0]),
    ]


def test_typed_documents(spark):
    typed = stored(spark, DOC).select(F.from_json("outcome_data", L.OUTCOME_TYPE).alias("d"))
    out = typed.select(
        L.typed_count(F.col("d.level1_ip")), L.typed_count(F.lit(None).cast("array<int>"))
    ).first()
    assert tuple(out) == (2, 0)
    row = spark.createDataFrame([(json.dumps(FUNDING),)], "f string").select(
        F.from_json("f", L.FUNDING_TYPE).alias("d")
    ).first()
    assert row.d.level3_series_a[0].clinical_trial_year is None


def test_final_level(apply):
    assert apply(L.final_level, [(1, 3), (None, 2), (None, None)], "a int, b int") == [3, 2, 0]


def test_items(spark):
    table = stored(spark, DOC, None, "{}", {"level5_exits": [{"exit_type": "acquisition", "acquirer": "Y"}, {"acquirer": "Q"}]})
    out = stored_items(table).orderBy("Project_Title", "level", "item_no").collect()
    got = [(r.Project_Title, r.level, r.item_no, r.item_name, r.item_type, r.item_year, r.item_party) for r in out]
    assert got == [
        ("Project 0", 1, 1, "T1", "patent", 2020, None),
        ("Project 0", 1, 2, "Untitled", "IP", None, None),
        ("Project 0", 2, 1, "A Inc.", None, None, None),
        ("Project 0", 2, 2, "B Corp.", None, None, None),
        ("Project 0", 5, 1, "A Inc.", "IPO", 2019, None),
        ("Project 3", 5, 1, "Unnamed", "acquisition", None, "Y"),
        ("Project 3", 5, 2, "Unnamed", None, None, None),
    ]
    funding = spark.createDataFrame([("k", json.dumps(FUNDING))], "k string, f string")
    row = outcome_items(funding, ["k"], "f", (3, 4)).collect()
    assert [(r.level, r.item_name, r.item_year, r.clinical_trial_year) for r in row] == [(3, "B Corp.", 2022, None)]


def test_read_outcomes(spark):
    table = stored(spark, DOC, None, "null", "{}", {"level1_ip": {"a": 1}})
    out = read_outcomes(table).orderBy("Project_Title").collect()
    assert [(r.Project_Title, r.ip_count, r.companies_count, r.exits_count) for r in out] == [
        ("Project 0", 2, 2, 1),
        ("Project 4", 0, 0, 0),
    ]
    assert read_outcomes(table, "x' OR '1'='1").count() == 0
    assert read_outcomes(table, "Doe, Jane", 1).count() == 1


def test_unreadable(spark):
    table = stored(spark, DOC, None, "{}", "{broken", "[1")
    assert sorted(r.outcome_data for r in unreadable_outcomes(table).collect()) == ["[1", "{broken"]


def test_upsert(spark):
    table = stored(spark, "{}", "{}", "{}").withColumns(
        {c: F.lit(0) for c in ("level_1_score", "level_2_score", "level_5_score", "total_score")}
    )
    table = table.unionByName(table.where("Project_Title = 'Project 1'"))
    table = table.unionByName(table.limit(1).withColumn("Name", F.lit(None).cast("string")))
    updates = score_updates(score_outcomes(stored(spark, DOC, {"level1_ip": [{}]})))
    updates = updates.unionByName(updates.withColumn("Name", F.lit(None).cast("string")))
    updates = updates.unionByName(
        updates.where("Project_Title = 'Project 1'").withColumns({"level_1_score": F.lit(9), "total_score": F.lit(0)})
    )
    once = upsert_scores(table, updates)
    assert once.columns == table.columns
    got = sorted((str(r.Name), r.Project_Title, r.level_1_score, r.total_score) for r in once.collect())
    assert got == [
        ("Doe, Jane", "Project 0", 2, 5),
        ("Doe, Jane", "Project 1", 1, 1),
        ("Doe, Jane", "Project 1", 1, 1),
        ("Doe, Jane", "Project 2", 0, 0),
        ("None", "Project 0", 0, 0),
    ]
    again = upsert_scores(once, updates)
    assert again.exceptAll(once).count() == 0 and once.exceptAll(again).count() == 0


def test_profile(spark):
    table = stored(spark, DOC, None)
    out = profile_table(table).collect()
    assert [(r.position, r.column_name, r.data_type, r.row_count) for r in out][0] == (1, "Name", "string", 2)
    assert len(out) == 4
    tables = profile_tables({"a": table, "b": spark.range(7)}).collect()
    assert sorted(tuple(r) for r in tables) == [("a", 2, 4), ("b", 7, 1)]
    assert sample_where(spark.range(9), F.col("id") > 2, [F.col("id")], 2).collect()[0].id == 3


def test_profile_counts_nulls_and_values(spark):
    rows = [(i % 20, None if i % 3 else "x", {"k": i}) for i in range(60)]
    table = spark.createDataFrame(rows, "`a.b` int, c string, m map<string,int>")
    for df, scale in ((table, 1), (table.limit(0), 0)):
        found = {r.column_name: r for r in profile_table(df).collect()}
        assert [found[c].null_count for c in ("a.b", "c", "m")] == [0, 40 * scale, 0]
        assert abs(found["a.b"].distinct_about - 20 * scale) <= 3
        assert found["c"].distinct_about == scale and found["m"].distinct_about is None


def test_sample_values(spark):
    table = spark.createDataFrame([(i, f"v{i}") for i in range(20, 0, -1)], "`a.b` int, c string")
    got = sample_values({"t": (table, ["`a.b`"]), "e": (table.limit(0), ["c"])}, 2).collect()
    assert sorted((r.row_no, r.position, r.column_name, r.value) for r in got) == [
        (1, 1, "a.b", "1"), (1, 2, "c", "v1"), (2, 1, "a.b", "2"), (2, 2, "c", "v2"),
    ]
