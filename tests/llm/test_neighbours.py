"""Nearest neighbours against brute force: the index exactly, the whole by recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import neighbours as N
from tallyweave.llm import queries

FOLDER = "/root/testdata/sf0.1"
SCHEMA = "vec_id bigint, embedding array<float>"


@pytest.mark.parametrize("radius", [0, 1, 5, 11, 20, 47, 64])
def test_the_index_holds_every_code_within_the_radius(radius):
    random = np.random.default_rng(radius)
    codes = random.integers(0, 4, (500, 8)).astype(np.uint8) * 37
    index = N.ByteIndex(codes)
    for q in codes[:20] ^ np.uint8(3):
        apart = np.bitwise_count(codes ^ q).sum(axis=1)
        assert index.within(q, radius).tolist() == np.flatnonzero(apart <= radius).tolist()


def brute(rows, k, step):
    fit = {
        i: np.array(e, np.float64) for i, e in rows
        if i is not None and e is not None and len(e) == 3 and None not in e
        and np.isfinite(np.array(e, np.float64)).all() and any(e)
    }
    out = []
    for q in fit:
        if q % step == 0:
            near = sorted((float(np.sqrt(((v - fit[q]) ** 2).sum())), i) for i, v in fit.items() if i != q)
            out += [(q, n + 1, i, round(s, 9)) for n, (s, i) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [16, 1000])
def test_small_tables_are_exact(spark, block):
    random = np.random.default_rng(2)
    rows = [(i, random.integers(-3, 4, 3).astype(float).tolist()) for i in range(120)]
    rows += [(i, [1.0, 2.0, 3.0]) for i in range(200, 260)]  # one vector very often
    rows += [(300, None), (301, [1.0, None, 2.0]), (302, [float("nan")] * 3), (303, [0.0] * 3)]
    rows += [(304, [float("inf"), 1.0, 1.0]), (305, [1.0]), (306, []), (None, [1.0, 1.0, 2.0])]
    rows += [(200, [1.0, 2.0, 3.0])]  # a row twice
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = df.selectExpr("*", "1 as query", "2 as block", "3 as ids", "4 as score")
    asked = df.where(F.col("vec_id") % 20 == 0)
    got = N.nearest(df, asked, recall=1.0, block=block).collect()
    assert sorted((*r[:3], round(r[3], 9)) for r in got) == brute(rows, 10, 20)


def test_few_or_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], SCHEMA)
    assert [tuple(r) for r in N.nearest(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 2**0.5)]
    assert N.nearest(df.limit(1), df.limit(1)).count() == 0
    assert N.nearest(df.limit(0), df.limit(0)).count() == 0
    assert N.nearest(df, df.limit(0)).count() == 0


def test_recall_on_the_given_table(spark):
    got = queries.op5_neighbours(spark, FOLDER).toPandas()
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    x, ids = np.array(table.embedding.tolist(), np.float64), table.vec_id.to_numpy()
    found = wanted = 0
    for q, rows in got.groupby("query_id"):
        distance = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        distance[ids == q] = np.inf
        true = set(ids[np.argsort(distance, kind="stable")[:10]])
        assert rows.sort_values("rank")["rank"].tolist() == list(range(1, 11))
        found, wanted = found + len(true & set(rows.vec_id)), wanted + 10
    assert found / wanted >= 0.9
    print("recall", found / wanted)
