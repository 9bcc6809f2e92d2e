"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: the signs of their coordinates after rotations that
are learnt so that signs lose little. A code is split into bytes, and every byte
is indexed. If two codes differ in at most R bits, the pigeonhole principle says
that some byte differs in few, so probing all byte values that near a query's
retrieves every code within R; these candidates are reranked by their floats.
R is set on the sample, so that the wanted share of true neighbours lies within.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import Rows
from tallyweave.operators.dedupe import top_per_key
from tallyweave.runtime import cut

# Numbers that the codes are learnt from at most, rotations, and vectors of an index block.
MOST_NUMBERS, ROTATIONS, BLOCK = 2_000_000, 4, 1 << 15
_DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))


@dataclass(frozen=True)
class Codes:
    """Rotations, their centre, and the radius in bits."""

    centre: np.ndarray
    rotations: np.ndarray
    radius: int

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """A row of bytes per vector."""
        return np.packbits((vectors - self.centre) @ self.rotations > 0, axis=1)


def learn(
    sample: np.ndarray, rotations: int, k: int, recall: float, seed: int = 5, rounds: int = 30
) -> Codes:
    """Codes for vectors like ``sample``'s, and the radius that holds ``recall`` of neighbours.

    Each rotation starts from the principal axes and a random turn, and is then
    turned towards the signs it yields, again and again.
    """
    random = np.random.default_rng(seed)
    dim = sample.shape[1]
    centre = sample.mean(axis=0)
    z = sample - centre
    axes = np.linalg.svd(z.T @ z)[0]
    turned = z @ axes
    made = []
    for _ in range(rotations):
        turn = np.linalg.qr(random.standard_normal((dim, dim)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(turned.T @ np.where(turned @ turn > 0, 1.0, -1.0))
            turn = u @ v
        made.append(axes @ turn)
    codes = Codes(centre, np.hstack(made), rotations * dim)
    if len(sample) <= 10 * k:
        return codes
    bits = codes.encode(sample)
    apart = []
    for i in random.choice(len(sample), min(300, len(sample)), replace=False):
        distance = ((sample - sample[i]) ** 2).sum(axis=1)
        near = np.argpartition(distance, k)[: k + 1]
        apart.append(np.bitwise_count(bits[near[near != i]] ^ bits[i]).sum(axis=1))
    return Codes(centre, codes.rotations, int(np.quantile(np.concatenate(apart), recall)))


class ByteIndex:
    """For each byte position, the rows in order of that byte's value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(column, kind="stable") for column in codes.T]
        values = np.arange(257)
        self.starts = [
            np.searchsorted(column[order], values)
            for column, order in zip(codes.T, self.order, strict=True)
        ]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is at most ``radius`` bits from ``code``.

        Were the first ``radius % m + 1`` of m bytes all further than ``radius // m``
        and the rest at least that far, the bits would add up to more than ``radius``.
        """
        bytes_, (each, more) = len(code), divmod(radius, len(code))
        marked = np.zeros(len(self.codes), bool)
        for j in range(bytes_):
            reach = each if j <= more else each - 1
            order, starts = self.order[j], self.starts[j]
            for value in np.flatnonzero(_DISTANCE[code[j]] <= reach):
                marked[order[starts[value] : starts[value + 1]]] = True
        rows = np.flatnonzero(marked)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Ids and vectors of doubles that are finite and not zero; repeated rows once."""
    given = vectors.select(
        F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"),
        F.col(f"`{embedding}`").cast("array<double>").alias("embedding"),
    )

    def fine(x):
        return F.coalesce(F.abs(x) < float("inf"), F.lit(False))

    return given.where(
        F.col("vec_id").isNotNull()
        & F.forall("embedding", fine)
        & F.exists("embedding", lambda x: x != 0)
    )


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[
        column.offsets[0].as_py() : column.offsets[-1].as_py()
    ].reshape(len(column), -1)


def _answer(codes: Codes, k: int, radius: int):
    """Rows by block, the index's before the queries': the k + 1 nearest of each query in it."""
    schema = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, block, parts, ids, index, vectors = Rows(schema), None, [], [], None, None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            queries = batch.column("query").fill_null(0).to_numpy()
            indexed = batch.column("query").is_null().to_numpy(zero_copy_only=False)
            given, members = _matrix(batch.column("embedding")), batch.column("ids")
            # runs of rows of one block and one kind
            changes = (np.diff(blocks) != 0) | (np.diff(indexed.astype(int)) != 0)
            edges = [0, *(np.flatnonzero(changes) + 1).tolist(), len(blocks)]
            for low, high in zip(edges, edges[1:], strict=False):
                if blocks[low] != block:
                    block, parts, ids, index = blocks[low], [], [], None
                if indexed[low]:
                    parts.append(given[low:high])
                    ids.extend(members.slice(low, high - low).to_pylist())
                    continue
                if not parts and index is None:
                    continue
                if index is None:
                    vectors, parts = np.vstack(parts), []
                    index = ByteIndex(codes.encode(vectors))
                for at in range(low, high):
                    found = index.within(codes.encode(given[at : at + 1])[0], radius)
                    score = np.sqrt(((vectors[found] - given[at]) ** 2).sum(axis=1))
                    if len(found) > k + 1:
                        limit = np.partition(score, k)[k]
                        found, score = found[score <= limit], score[score <= limit]
                    nearest = sorted(
                        (s, i) for s, f in zip(score.tolist(), found.tolist(), strict=True) for i in ids[f]
                    )[: k + 1]
                    for s, i in nearest:
                        if out.add((int(queries[at]), i, s)):
                            yield out.batch()
        yield out.batch()

    return run


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    recall: float = 0.97,
    rotations: int = ROTATIONS,
    block: int = BLOCK,
    most_numbers: int = MOST_NUMBERS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the k nearest of each query, itself left out.

    Nearness is Euclidean distance in doubles; ties go to the smaller id. Vectors
    that are null, zero, or hold nulls or numbers that are not finite take no part,
    nor do those of another length than most, or without id. Repeated rows count once.

    Codes are learnt from a sample of about ``most_numbers`` numbers at most; every
    vector is indexed. Equal vectors are one entry that keeps its k + 1 smallest
    ids, which no query can need more of; equal queries are asked once. The index
    is dealt out in blocks of about ``block`` vectors, and the queries are sent to
    each. A query that finds fewer than k within the radius is asked once more
    with a radius that holds everything.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors, vec_id, embedding)
    lengths = usable.groupBy(F.size("embedding").alias("n")).count()
    most = lengths.orderBy(F.col("count").desc(), "n").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if most is None:
        return spark.createDataFrame([], schema)
    dim, rows = most["n"], most["count"]
    usable = usable.where(F.size("embedding") == dim)
    share = most_numbers / dim / rows
    place = F.pmod(F.xxhash64("vec_id", F.lit("codes")), F.lit(1 << 30)) / (1 << 30)
    sample = usable.where(place < share) if share < 1 else usable
    # ordered, so that the same codes are learnt whatever the partitions
    learnt = sample.orderBy("vec_id", "embedding").select("embedding").toArrow()
    codes = learn(_matrix(learnt.column(0).combine_chunks()), rotations, k, recall)

    firsts = top_per_key(usable.distinct(), ["embedding"], [F.col("vec_id")], k + 1)
    entries = cut(
        firsts.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")),
        "vector-entries",
    )
    wanted = cut(
        _usable(queries, vec_id, embedding)
        .where(F.size("embedding") == dim)
        .select(F.col("vec_id").alias("query_id"), "embedding")
        .distinct(),
        "vector-queries",
    )
    asked = cut(
        wanted.groupBy("embedding").agg(F.min("query_id").alias("query")), "vector-asked"
    )
    blocks = max(1, -(-entries.count() // block))

    def ask(some: DataFrame, radius: int) -> DataFrame:
        """At most k + 1 answers of each query and block, cut down to the k + 1 best."""
        indexed = entries.select(
            F.pmod(F.xxhash64("embedding"), F.lit(blocks)).alias("block"),
            F.lit(None).cast("bigint").alias("query"), "embedding", "ids",
        )
        sent = some.select(
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1))).alias("block"),
            "query", "embedding", F.array().cast("array<bigint>").alias("ids"),
        )
        found = (
            indexed.unionByName(sent)
            .repartition(blocks, "block")
            .sortWithinPartitions("block", F.col("query").asc_nulls_first())
            .mapInArrow(_answer(codes, k, radius), "query bigint, vec_id bigint, score double")
        )
        best = top_per_key(found, ["query"], [F.col("score"), F.col("vec_id")], k + 1)
        return cut(best, "vector-answers")

    answers = ask(asked, codes.radius)
    enough = answers.groupBy("query").count().where(F.col("count") > k).select("query")
    again = cut(asked.join(enough, "query", "left_anti"), "vector-again")
    bits = codes.rotations.shape[1]
    if codes.radius < bits and again.take(1):
        full = ask(again, bits)
        answers = answers.join(again.select("query"), "query", "left_anti").unionByName(full)
    mine = wanted.join(asked, "embedding").select("query_id", "query").join(answers, "query")
    others = mine.where(F.col("query_id") != F.col("vec_id"))
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        others.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
