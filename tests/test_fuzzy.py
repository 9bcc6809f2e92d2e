import random

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import fuzzy
from tallyweave.operators.fuzzy import best_edit_matches


def changed(rng, text, edits, letters):
    chars = list(text)
    for _ in range(edits):
        kind, at = rng.random(), rng.randint(0, len(chars))
        if kind < 0.34 and chars:
            chars[min(at, len(chars) - 1)] = rng.choice(letters)
        elif kind < 0.67 and chars:
            del chars[min(at, len(chars) - 1)]
        else:
            chars.insert(at, rng.choice(letters))
    return "".join(chars)


def frames(spark, titles, grants):
    return (
        spark.createDataFrame([(t,) for t in titles], "title string"),
        spark.createDataFrame(list(grants), "grant_id long, title string"),
    )


def brute(titles, grants, measure, limit):
    pairs = titles.where("trim(title) <> ''").distinct().crossJoin(
        grants.where("trim(title) <> ''").withColumnRenamed("title", "grant_title")
    )
    best = (
        pairs.withColumn("distance", measure)
        .where(F.col("distance").between(0, limit))
        .groupBy("title")
        .agg(F.min(F.struct("distance", "grant_id")).alias("b"))
    )
    return {r.title: (r.b.distance, r.b.grant_id) for r in best.collect()}


def found(matches):
    rows = matches.collect()
    assert len({r.title for r in rows}) == len(rows)
    return {r.title: (r.distance, r.grant_id) for r in rows}


@pytest.mark.parametrize("limit, heavy", [(5, 10**6), (4, 40), (2, 2), (5, 1)])
def test_same_as_brute_force(spark, limit, heavy):
    rng = random.Random(limit * 100 + heavy)
    letters = "abcd é"
    base = ["".join(rng.choices(letters, k=rng.randint(1, 24))) for _ in range(20)]
    grants = [(i, changed(rng, rng.choice(base), rng.randint(0, 4), letters)) for i in range(250)]
    wanted = [changed(rng, rng.choice(base), rng.randint(0, 6), letters) for _ in range(150)]
    titles, known = frames(spark, wanted + [None, "", "  "], grants + [(900, None), (901, " ")])
    expected = brute(titles, known, F.levenshtein("title", "grant_title", limit), limit)
    assert found(best_edit_matches(titles, known, limit, heavy)) == expected


def test_lengths_at_the_edge_and_ties(spark):
    long = "the quick brown fox jumps over the lazy dog"
    titles, known = frames(
        spark,
        [long, long + "12345", long + "123456", "xyz"],
        [(4, long[:-5]), (2, long[5:]), (9, long + "12345"), (3, "xy"), (1, "yz")],
    )
    assert found(best_edit_matches(titles, known)) == {
        long: (5, 2),
        long + "12345": (0, 9),
        long + "123456": (1, 9),
        "xyz": (1, 1),
    }


NAME = "annual report number {} of the research institute"


@pytest.fixture
def key_rows(monkeypatch):
    """Key rows of the grants, per round, as they are made."""
    seen, split = [], fuzzy._split_grants

    def counted(parts, k):
        made = split(parts, k)
        seen.append((k, made.groupBy("gid").count().agg(F.max("count")).first()[0]))
        return made

    monkeypatch.setattr(fuzzy, "_split_grants", counted)
    return seen


@pytest.mark.parametrize("heavy", [10**6, 2000])
@pytest.mark.parametrize("away", [3, 4, 5, None])
def test_dense_cluster(spark, key_rows, heavy, away):
    """Numbered titles lie close together; those asked for are ``away`` from one, or from none."""
    rng = random.Random(7)
    numbers = [f"{i:07d}" for i in rng.sample(range(10**7), 400)]
    edit = (lambda n: "abcdefg") if away is None else (lambda n: "x" * away + n[away:])
    asked = [NAME.format(edit(n)) + f"{'' if away else i}" for i, n in enumerate(numbers[:20])]
    titles, known = frames(spark, asked, [(i, NAME.format(n)) for i, n in enumerate(numbers)])
    expected = brute(titles, known, F.levenshtein("title", "grant_title", 5), 5)
    assert found(best_edit_matches(titles, known, 5, heavy)) == expected
    assert (len(expected) == 0) == (away is None)
    for k, rows in key_rows:  # bounded by the distance alone
        assert rows <= ((k + 1) if k > fuzzy.NEAREST else (k + 1) ** (fuzzy.GROWTHS + 1))


def test_signatures_never_part_near_titles(spark):
    rng = random.Random(11)
    letters = "abcdefgh é"
    rows = []
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        rows.append((text, changed(rng, text, rng.randint(0, 5), letters)))
    pairs = spark.createDataFrame(rows + [("a" * 300, "a" * 295), ("", "ab")], "a string, b string")
    for k in (0, 1, 3, 5):
        near = pairs.where(F.levenshtein("a", "b") <= k)
        kept = fuzzy.may_be_near(fuzzy.signature(F.col("a")), fuzzy.signature(F.col("b")), k)
        assert near.count() > 0 and near.where(~kept).count() == 0


def scattered(rng, text, edits):
    chars = list(text)
    for at in rng.sample(range(len(chars)), edits):
        chars[at] = rng.choice("abcdefghijklmnopqrstuvwxyz")
    return "".join(chars)


def test_few_titles_of_a_dense_cluster_are_compared(spark):
    """A cluster of 20,000 near-identical grants, none within 3 edits of those asked for."""
    rng = random.Random(12)
    base = "randomised trial of early rehabilitation after acute ischemic stroke"
    grants = [(i, scattered(rng, base, 7)) for i in range(20_000)]
    asked = [scattered(rng, base, 6) for _ in range(60)]
    titles, known = frames(spark, asked, grants)
    titles, known = (
        df.withColumn("signature", fuzzy.signature(F.col("title"))).cache() for df in (titles, known)
    )
    pairs = titles.crossJoin(known.withColumnsRenamed({"title": "grant_title", "signature": "other"}))
    in_reach = F.abs(F.length("title") - F.length("grant_title")) <= 5
    calls = pairs.where(in_reach & fuzzy.may_be_near(F.col("signature"), F.col("other"), 5))
    assert calls.count() * 10 <= pairs.where(in_reach).count()
    expected = brute(titles.select("title"), known, F.levenshtein("title", "grant_title", 5), 5)
    assert found(best_edit_matches(titles.select("title"), known.select("grant_id", "title"), 5, 5000)) == expected


@pytest.mark.parametrize("limit, heavy", [(5, 10**6), (3, 10**6), (3, 20), (1, 10**6), (0, 10**6)])
def test_long_titles_same_as_brute_force(spark, limit, heavy):
    rng = random.Random(limit + heavy)
    letters = "abcdefgh é"
    edge = fuzzy.LONG * (2 * limit + 1)  # from here on grants are filed by class
    base = ["".join(rng.choices(letters, k=edge + rng.randint(-4, 60))) for _ in range(12)]
    base += ["ab" * (edge // 2), "a" * (edge + 30)]
    grants = [(i, changed(rng, rng.choice(base), rng.randint(0, 3), letters)) for i in range(120)]
    wanted = [changed(rng, rng.choice(base), rng.randint(0, 5), letters) for _ in range(80)]
    titles, known = frames(spark, wanted, grants)
    expected = brute(titles, known, F.levenshtein("title", "grant_title", limit), limit)
    assert expected
    assert found(best_edit_matches(titles, known, limit, heavy)) == expected


def test_keys_of_a_long_title_do_not_multiply_by_length(spark):
    titles, _ = frames(spark, ["".join(random.Random(1).choices("abcdefgh ", k=3000))], [(1, "a")])
    keys = fuzzy._whole_titles(titles.withColumn("tid", F.col("title")), 10)
    assert keys.count() <= 2 * 11**2


def test_growing_tables_are_not_broadcast(spark):
    titles, known = frames(spark, ["some title", "another"], [(1, "some tite"), (2, "other")])
    matches = best_edit_matches(titles, known, 2)
    plan = matches._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 5
    assert found(matches) == {"some title": (1, 1), "another": (2, 2)}
