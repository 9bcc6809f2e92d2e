import random

import pytest
from pyspark.sql import functions as F

from tallyweave import columns as C
from tallyweave.operators.dedupe import duplicate_count, first_per_key, without_duplicates
from tallyweave.operators import partial as partial_module
from tallyweave.operators.partial import partial_matches
from tallyweave.operators.titles import keep_known, stage_counts
from tallyweave.functions.text import record_id
from tallyweave.runtime import cut
from tallyweave.operators.words import average_length, sample_rows, top_words, word_counts
from tallyweave.plans.diagnosis import diagnose_unmatched
from tallyweave.plans.title_enrichment import enrich_by_title


@pytest.fixture(scope="module")
def grants(spark):
    return spark.createDataFrame(
        [
            (1, "Gene Therapy: a study", "p1", "c1"),
            (2, "Gene Therapy: a study", "p2", "c2"),  # same raw title, later id
            (3, "gene therapy a study", "p3", None),  # same key, other raw title
            (4, "Neural pathways of sleep", "p4", "c4"),
            (5, None, "p5", "c5"),
            (6, "!!!", "p6", "c6"),
        ],
        f"grant_id int, {C.TITLE_COLUMN} string, {C.PRIMARY} string, {C.CATEGORIES} string",
    )


@pytest.fixture(scope="module")
def outcomes(spark):
    return spark.createDataFrame(
        [
            ("a", "GENE therapy - a study", "old"),
            ("b", "Neural pathway of sleep", "old"),
            ("c", "Neural pathway of sleep", "old"),
            ("d", "something else entirely", "old"),
            ("e", None, "old"),
            ("f", "???", "old"),
        ],
        "Name string, Project_Title string, Primary_Institute string",
    )


def test_enrich_one(outcomes, grants):
    out = enrich_by_title(outcomes, grants)
    got = {r.Name: (r.Primary_Institute, r.Research_Categories, r.match_stage, r.distance) for r in out.collect()}
    assert out.count() == outcomes.count()
    assert got == {
        "a": ("p3", None, "exact", 0),
        "b": ("p4", "c4", "fuzzy", 1),
        "c": ("p4", "c4", "fuzzy", 1),
        "d": (None, None, "none", None),
        "e": (None, None, "none", None),
        "f": (None, None, "none", None),
    }
    assert {r.match_stage: r.rows for r in stage_counts(out).collect()} == {
        "exact": 1,
        "fuzzy": 2,
        "none": 3,
    }


def test_enrich_all(outcomes, grants):
    out = enrich_by_title(outcomes, grants, mode="all")
    assert sorted((r.Name, r.grant_id or 0) for r in out.collect()) == [
        ("a", 1),
        ("a", 3),
        ("b", 4),
        ("c", 4),
        ("d", 0),
        ("e", 0),
        ("f", 0),
    ]


def test_strict_form_keeps_edge_blanks(spark, grants):
    odd = spark.createDataFrame([("a", "Neural pathways of sleep -")], "Name string, Project_Title string")
    assert enrich_by_title(odd, grants).first().match_stage == "exact"
    assert enrich_by_title(odd, grants, form="strict").first().distance == 1


def test_wrong_calls(outcomes, grants):
    with pytest.raises(ValueError, match="mode"):
        enrich_by_title(outcomes, grants, mode="some")
    with pytest.raises(ValueError, match="missing"):
        enrich_by_title(outcomes.drop("Project_Title"), grants)
    with pytest.raises(ValueError, match="no title column"):
        enrich_by_title(outcomes, grants.drop(C.TITLE_COLUMN))


def test_dedupe(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "id int, t string")
    assert sorted(r.id for r in first_per_key(rows, ["t"], [F.col("id")]).collect()) == [1, 2, 4]
    twice = rows.unionAll(rows)
    assert tuple(duplicate_count(twice).first()) == (10, 5, 5)
    assert tuple(duplicate_count(rows.limit(0)).first()) == (0, 0, 0)
    assert without_duplicates(twice).count() == 5


def test_keep_known(spark):
    old = spark.createDataFrame([("a", "t"), (None, "u")], "Name string, Title string")
    new = spark.createDataFrame([("a", "t"), ("a", "t"), ("b", "t"), (None, "u")], "Name string, Title string")
    kept = keep_known(new, old, record_id(F.col("Name"), F.col("Title")))
    assert kept.columns == ["Name", "Title"] and kept.count() == 3


def test_words_and_lengths(spark):
    rows = spark.createDataFrame([("gene gene sleep",), ("sleep the zeta",), (None,)], "t string")
    assert tuple(average_length(rows, "t").first()) == (3, 29 / 3)
    top = top_words(word_counts(rows, "t"), 2).collect()
    assert [tuple(r) for r in top] == [("gene", 2), ("sleep", 2)]
    many = spark.range(100)
    assert sample_rows(many, F.col("id"), 5).collect() == sample_rows(many, F.col("id"), 5).collect()
    assert sample_rows(many, F.col("id"), 5).count() == 5


def brute_partial(title, grants, min_length=5):
    """First five matches by trying every grant in turn."""
    out = []
    for grant_id, text in sorted(grants):
        if any(len(w) >= min_length and w in text for w in title.split()):
            out.append((grant_id, "word_in_grant"))
        if any(len(w) >= min_length and w in title for w in text.split()):
            out.append((grant_id, "word_in_unmatched"))
    return out[:5]


def test_partial_same_as_brute_force(spark):
    rng = random.Random(5)
    stems = ["gene", "path", "ways", "neuro", "sleep", "ing", "cardio", "x" * 40, "y" * 33 + "z"]
    word = lambda: "".join(rng.choices(stems, k=rng.randint(1, 3)))
    phrase = lambda: " ".join(word() for _ in range(rng.randint(0, 4)))
    titles = [(i, phrase()) for i in range(60)] + [(99, None)]
    grants = [(i, phrase()) for i in range(80)]
    out = partial_matches(
        spark.createDataFrame(titles, "title_id int, title string"),
        spark.createDataFrame(grants, "grant_id int, title string"),
    ).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.title_id, r.grant_id, r.match_type)):
        got.setdefault(r.title_id, []).append((r.grant_id, r.match_type))
        assert r.grant_title == dict(grants)[r.grant_id]
    expected = {i: brute_partial(t, grants) for i, t in titles if t and brute_partial(t, grants)}
    assert got == expected


def test_partial_with_very_long_words(spark):
    """Words longer than a head agree with brute force, and rows grow with characters only."""
    rng = random.Random(6)
    long = ["".join(rng.choices("ab", k=n)) for n in (64, 65, 66, 90, 300)]
    grown = [rng.choice(long) + rng.choice(["", "b", "ab" * 20]) for _ in range(40)] + ["a" * 64, "a" * 65]
    titles = [(i, t) for i, t in enumerate([*long, *(w[3:] for w in long), "a" * 70, "aaaaa short"])]
    grants = list(enumerate([*grown, *long, "x" + long[3][:-1], "short", "a" * 200]))
    rows = partial_matches(
        spark.createDataFrame(titles, "title_id int, title string"),
        spark.createDataFrame(grants, "grant_id int, title string"),
    ).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.title_id, r.grant_id, r.match_type)):
        got.setdefault(r.title_id, []).append((r.grant_id, r.match_type))
    assert got == {i: brute_partial(t, grants) for i, t in titles if brute_partial(t, grants)}


def test_partial_lists_a_row_per_character(spark, monkeypatch):
    whole = "".join(random.Random(7).choices("abcdefgh", k=50_000))
    rows = []

    def counted(df, label):
        made = cut(df, label)
        if label == "contained":
            rows.append(made.count())
        return made

    monkeypatch.setattr(partial_module, "cut", counted)
    titles = spark.createDataFrame([(1, whole[:20]), (2, "a" * 50_000)], "title_id int, title string")
    grants = spark.createDataFrame([(1, whole), (2, "aaaaa"), (3, whole[100:150])], "grant_id int, title string")
    got = {(r.title_id, r.grant_id, r.match_type) for r in partial_matches(titles, grants).collect()}
    assert got == {(1, 1, "word_in_grant"), (2, 2, "word_in_unmatched")}
    # the word of many equal places is listed once
    assert rows == [2]


def test_diagnosis(spark):
    unmatched = spark.createDataFrame(
        [(1, "Ann Lee", "Sleeping pathways"), (2, "Bo", None), (3, None, "zzz")],
        "outcome_id int, Name string, Project_Title string",
    )
    grants = spark.createDataFrame(
        [(1, "ann LEE", "Pathways of sleep"), (2, "Ann Lee", "sleep")],
        "grant_id int, name string, title string",
    )
    report = diagnose_unmatched(unmatched, grants, sample=None)
    assert report.lengths.first()["rows"] == 3
    assert {r.word for r in report.words.collect()} == {"sleeping", "pathways"}
    assert {(r.title_id, r.grant_id, r.match_type) for r in report.partial.collect()} == {
        (1, 1, "word_in_grant"),
        (1, 1, "word_in_unmatched"),
        (1, 2, "word_in_unmatched"),
    }
    assert [tuple(r) for r in report.names.collect()] == [("ann lee", 2, ["Pathways of sleep", "sleep"])]
    assert diagnose_unmatched(unmatched, grants, sample=2).sample.count() == 2


def test_answers_are_found_as_ids_without_broadcast(spark):
    grants = spark.createDataFrame(
        [(None, "No id", "p0"), (7, "Same A", "p1"), (7, "Same B", "p2"), (9, "near title one", "p3")],
        "grant_id long, title string, institute string",
    )
    outcomes = spark.createDataFrame(
        [(1, "no id"), (2, "same a"), (3, "Same B"), (4, "near title two"), (5, None)],
        "outcome_id long, Project_Title string",
    )
    columns = {"institute": "Primary_Institute"}
    for mode in ("one", "all"):
        out = enrich_by_title(outcomes, grants, mode=mode, grant_title="title", enrichment=columns)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("strategy=merge") >= 2
        got = {(r.outcome_id, r.Primary_Institute, r.grant_id, r.match_stage) for r in out.collect()}
        assert got == {
            (1, "p0", None, "exact"),
            (2, "p1", 7, "exact"),
            (3, "p2", 7, "exact"),
            (4, "p3", 9, "fuzzy"),
            (5, None, None, "none"),
        }
