"""Hard negatives against all pairs: the index, small tables with odd rows, and SQL."""

import math

import duckdb
import numpy as np
import pytest

from tallyweave.llm import hard_negatives as H
from tallyweave.llm import queries


@pytest.mark.parametrize("threshold", [-1e18, 0, 1, 2000, 9000, 20000, 1e6])
@pytest.mark.parametrize("dim", [1, 7, 64])
def test_the_index_finds_all_above_a_threshold(threshold, dim):
    random = np.random.default_rng(dim)
    rows = np.floor(random.standard_normal((300, dim)) * random.uniform(0, 60, dim))
    rows[5], rows[6] = 0, rows[7]
    anchors = np.floor(random.standard_normal((9, dim)) * random.uniform(0, 60, dim))
    wanted = random.random((9, 300)) < 0.9
    thresholds = threshold + np.arange(9) * 100.0
    norms = H.prefix_norms(anchors)
    index = H.Index(rows, H.prefix_norms(rows), norms.max(axis=0), thresholds.min())
    a, r, score = H.above(index, anchors, norms, thresholds, wanted)
    full = anchors @ rows.T
    want = np.argwhere(wanted & (full >= thresholds[:, None])).tolist()
    assert sorted(zip(a.tolist(), r.tolist())) == sorted(map(tuple, want))
    assert score.tolist() == full[a, r].tolist()


def test_coordinates_under_the_bound_are_not_indexed():
    rows = np.array([[1.0, 2, 3, 90], [1, 1, 1, 1]])
    index = H.Index(rows, H.prefix_norms(rows), H.prefix_norms(np.array([[1.0, 1, 1, 1]]))[0], 30.0)
    assert index.left_out.tolist() == [3, 4]
    assert [held.tolist() for _, held, _ in index.lists.values()] == [[0]]


def brute(rows, positives=5, negatives=10):
    usable = {}
    for i, e, label in rows:
        if None in (i, e, label) or None in e or not all(map(math.isfinite, e)):
            continue
        made = (label, [math.floor(256 * x) for x in e])
        usable[i] = min(usable.get(i, made), made)
    usable = {i: ((label + 1) % 10 if i % 7 == 0 else label, code) for i, (label, code) in usable.items()}
    out = []
    for a, (label, code) in usable.items():
        if a % 100:
            continue
        scored = [
            (-sum(x * y for x, y in zip(code, other)), i, of == label)
            for i, (of, other) in usable.items()
            if i != a
        ]
        for p, i, _ in sorted(s for s in scored if s[2])[:positives]:
            fit = sorted(s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p)
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j, _) in enumerate(fit[:negatives])]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int"


def mined(spark, rows, **options):
    return sorted(map(tuple, H.mine(spark.createDataFrame(rows, SCHEMA), **options).collect()))


@pytest.mark.parametrize("block_numbers", [64, 1 << 22])
def test_small_tables_with_odd_rows(spark, block_numbers):
    random = np.random.default_rng(3)
    rows = [
        (i, (random.standard_normal(6) * 0.5 + 0.2).astype(np.float32).tolist(), int(random.integers(0, 3)))
        for i in range(420)
    ]
    nan, inf = float("nan"), float("inf")
    rows += [
        (None, [1.0] * 6, 1), (500, None, 1), (501, [1.0, None], 1), (502, [nan] * 6, 1),
        (503, [inf] * 6, 1), (504, [1.0] * 6, None), (600, [], 1), (601, [0.5, 0.25], 2),
        (700, [0.0] * 6, 2), rows[3], rows[100], (-100, [0.3] * 6, 0), (-7, [0.3] * 6, 9),
        (105, [0.9] * 6, 0), (505, [1e30] * 6, 1),
    ]
    # many equal vectors, whose ties go by id
    rows += [(1000 + i, [0.25] * 6, i % 3) for i in range(150)]
    want = brute([r for r in rows if r[0] != 505])
    assert want and mined(spark, rows, block_numbers=block_numbers) == want


def test_windows_that_stay_open(spark):
    # hardly any negative scores near a positive: thresholds fall to the end of the window
    rows = [(i, [1.0, 0.0], 1) for i in range(0, 60)] + [(1000 + i, [0.0, 1.0], 2) for i in range(600)]
    rows += [(2001, [0.5, 0.5], 3), (2002, [0.31, 0.0], 3), (2003, [0.29, 0.0], 3)]
    assert mined(spark, rows) == brute(rows)


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [], 1), (200, [], 2), (1, [], 1)]) == brute([(100, [], 1), (200, [], 2), (1, [], 1)])
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mined(spark, [(100, [1.0], 1), (2, [1.0], 1)]) == []


def test_other_columns_may_clash(spark):
    rows = [(i, [math.sin(i), math.cos(i)], i % 2, i) for i in range(220)]
    frame = spark.createDataFrame(rows, SCHEMA + ", code int")
    assert sorted(map(tuple, H.mine(frame).collect())) == brute([r[:3] for r in rows])


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_its_sql(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS FROM '{folder}/embeddings.parquet'")
    want = sorted(duck.sql(queries.HARD_NEGATIVES_SQL).fetchall())
    got = sorted(map(tuple, queries.op11_hard_negatives(spark, folder).collect()))
    assert want and got == want
