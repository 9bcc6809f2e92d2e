"""Voters, label model and classifier on planted votes, and held-out accuracy."""

import zlib

import numpy as np
import pytest

from tallyweave.llm import queries, toxicity
from tallyweave.llm.labels import unlabelled_rows

FOLDER = "/root/testdata/sf0.1"
LABELS = "doc_id bigint, toxic int"


def test_traits():
    assert toxicity.traits("Abcdefg, ab!") == {"abcdefg", "ab", "abcd*", "abcde*", "abcdef*"}
    assert toxicity.traits("") == set()


def test_label_model_finds_rates_and_repeats():
    random = np.random.default_rng(1)
    toxic = random.random(4000) < 0.2
    rates = [(0.8, 0.02), (0.6, 0.01), (0.5, 0.05), (0.3, 0.3)]
    votes = np.array([random.random(4000) < np.where(toxic, t, c) for t, c in rates]).T
    votes = np.c_[votes, votes[:, 1]].astype(float)  # the last only repeats the second
    labels = np.where(random.random(4000) < 0.2, toxic, np.nan).astype(float)
    model, posterior = toxicity.fit_label_model(votes, labels)
    assert model.in_toxic[:4] == pytest.approx([t for t, _ in rates], abs=0.08)
    assert model.in_clean[:4] == pytest.approx([c for _, c in rates], abs=0.03)
    assert max(model.weight[1], model.weight[4]) < 0.5 < min(model.weight[0], model.weight[3])
    unlabelled = np.isnan(labels)
    assert ((posterior > 0.5) == toxic)[unlabelled].mean() > 0.9


def test_linear():
    votes = np.array([[0, 0], [1, 0], [0, 1], [1, 1]], float)
    intercept, weights = toxicity.fit_linear(votes, np.array([0.02, 0.9, 0.02, 0.9]))
    assert intercept < 0 and weights[0] > 3 and abs(weights[1]) < 0.1


def test_texts_with_planted_words(spark):
    rows = [(i, f"w{i % 7} some words here {'vileword' if i % 5 == 0 else ''}") for i in range(200)]
    rows += [(500, None), (None, "vileword"), (501, ""), (502, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame(
        [(i, int(i % 5 == 0)) for i in range(200)] + [(500, 0), (None, 1), (7, None)], LABELS
    )
    model = toxicity.fit(docs, labels)
    clash = docs.selectExpr("*", "1 as score", "2 as row", "3 as label")
    got = {r.row.doc_id: r.score for r in model.score(clash).collect()}
    assert len(got) == len(rows)
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in range(200))
    assert got[None] >= 0.3 and max(got[500], got[501], got[502]) < 0.3


def test_voters_do_not_depend_on_partitions(spark):
    rows = [(f"common words vile{i % 9}", 1.0) for i in range(40)]
    rows += [(f"common words other{i % 9}", 0.0) for i in range(280)]
    for parts in (1, 8):  # of 8, the first holds all toxic rows and no clean one
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "text string, label double")
        found = toxicity.mine_voters(df, 3, 8.0)
        assert set(found) == {f"vile{i}" for i in range(9)} | {"vile*"}, parts


def test_every_voter_that_passes_is_kept(spark):
    rows = [(i, f"z{i % 700:03d}") for i in range(2100)] + [(i, f"c{i % 50}") for i in range(2100, 9000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 2100)) for i, _ in rows], LABELS)
    model = toxicity.fit(docs, labels, held=-2)
    assert {f"z{i:03d}" for i in range(700)} <= model.weights.keys()
    got = {r.row.doc_id: r.score for r in model.score(docs).collect()}
    assert all((got[i] >= 0.3) == (i < 2100) for i, _ in rows)


def test_correlations_equal_the_dense_ones(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    random = np.random.default_rng(3)
    votes = (random.random((300, 11)) < 0.2).astype(float)
    texts, p = random.integers(1, 5, 300).astype(float), random.random(300)
    a, c = random.random(11), random.random(11)
    centred = (votes - np.outer(p, a) - np.outer(1 - p, c)) * np.sqrt(texts)[:, None]
    centred /= np.sqrt((centred**2).sum(0)) + 1e-9
    want = np.abs(centred.T @ centred)
    np.fill_diagonal(want, 0)
    want[want <= 0.1] = 0
    v = toxicity.Votes.of(votes)
    assert toxicity._repeats(v, v.together(texts), texts, p, (a, c), 0.1) == pytest.approx(want.sum(0))
    share = texts / texts.sum()
    norm = np.linalg.norm(np.c_[np.ones(300), votes] * np.sqrt(share)[:, None], 2) ** 2
    assert norm <= toxicity._steepest(v, share) * (1 + 1e-12) <= norm * 1.01


def test_unlabelled_texts_take_part(spark):
    rows = [(i, f"plain{i % 40} words {'vileword' if 5 <= i < 60 else ''} {'oddword' if i < 5 else ''}") for i in range(600)]
    rows += [(i, f"oddword plain{i % 40} words") for i in range(1000, 1600)]  # without label
    rows += [(None, "oddword"), (2000, None), (1000, "oddword plain0 words"), (2001, "oddword")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = [(i, int(i < 60)) for i in range(600)] + [(2001, None), (None, 1)]
    labels = spark.createDataFrame(labels, LABELS)
    others = unlabelled_rows(docs, labels, "toxic", 4, 9, 100_000)
    got = sorted(r.doc_id for r in others.collect())
    assert got == sorted([*range(1000, 1600), 1000, 2000, 2001])
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in unlabelled_rows(docs, labels, "toxic", 4, 2, 999_999).collect())
    assert 50 < unlabelled_rows(docs, labels, "toxic", 4, 9, 200).count() < 200
    alone = toxicity.fit(docs, labels, held=9, most_unlabelled=0).weights
    beside = toxicity.fit(docs, labels, held=9, unlabelled_weight=1.0).weights
    assert beside["oddword"] < alone["oddword"] - 0.5  # hundreds of texts with it and no other voter
    assert beside["vileword"] > 3


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    for rows in ([], [(1, 0)], [(1, None)], [(9, 1)]):
        model = toxicity.fit(docs, spark.createDataFrame(rows, LABELS))
        assert model.weights == {} and model.score(docs).first().score < 1e-6
    assert toxicity.fit(docs.limit(0), spark.createDataFrame([(1, 1)], LABELS)).weights == {}


def test_held_out_accuracy(spark):
    scored = queries.op6_toxicity(spark, FOLDER).toPandas()
    assert scored.score.between(0, 1).all()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas()
    held = scored[scored.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.toxic).mean() > 0.95
