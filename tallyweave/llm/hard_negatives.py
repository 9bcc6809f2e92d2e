"""Hard-negative mining by threshold joins over an inverted index with norm bounds.

Every search is a join above a threshold, after L2AP (Anastasiu, Karypis: ICDE
2014): the coordinates of a row are taken in one order for all; as long as the
norm of what has been taken, times the longest anchor's norm over the same
coordinates, stays below the threshold, no anchor can reach it on them alone,
and they are left out of the index. The rest goes into lists by coordinate. An
anchor adds up its products list by list, from the last coordinate on, and drops
a row as soon as what it has, plus the product of the norms of what remains,
stays below the threshold. Few rows survive to be completed from the coordinates
left out.

A window asks for the best ``k`` rows whose score is at most ``high`` and at least
``low``. Its threshold begins near ``high``, where about enough rows are
expected, and is lowered, for the windows that are not full, until they are, or
until it is ``low``. Whatever a threshold lets through is whole, so a full window
is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.dedupe import first_per_key, top_per_key
from tallyweave.runtime import cut

# Numbers of an index block, rows and anchors compared at a time, coordinates of a step.
BLOCK_NUMBERS, ROWS, ANCHORS, STEP = 1 << 22, 4096, 128, 8
# Rows expected above the first thresholds, per row asked for, and the factor of each lowering.
EXPECTED, LOWERING, ROUNDS = 4, 16, 3
# Longer rows would not multiply exactly in doubles.
LONGEST = 1 << 26
_LEAST, _MOST = -(1 << 62), 1 << 62
# Bounds are rounded; a little on top keeps them bounds.
_SLACK = 1 + 1e-9
_WINDOW = ["anchor_id", "window"]
_CARRIED = ["tile", "ids", "labels", "codes", "windows"]


class Index:
    """The inverted index of some rows, for anchors no longer than ``reach`` over each
    prefix of the coordinates, above a threshold.

    ``lists`` holds, for each step of coordinates, the rows with an indexed one.
    """

    def __init__(self, rows: np.ndarray, norms: np.ndarray, reach: np.ndarray, threshold: float):
        self.rows, self.norms = rows, norms
        covered = norms * reach * _SLACK < threshold
        # coordinates left out: as many as keep every prefix below the threshold
        self.left_out = np.where(covered.all(axis=1), rows.shape[1], covered.argmin(axis=1) - 1)
        self.left_out = np.maximum(self.left_out, 0)
        self.lists = {}
        for begin in range(0, rows.shape[1], STEP):
            end = min(begin + STEP, rows.shape[1])
            held = np.flatnonzero(self.left_out < end)
            if len(held):
                part = rows[held, begin:end]
                indexed = np.arange(begin, end) >= self.left_out[held][:, None]
                self.lists[begin] = (end, held, np.where(indexed, part, 0.0))


def above(
    index: Index, anchors: np.ndarray, norms: np.ndarray, thresholds: np.ndarray, wanted: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the wanted pairs that score at least the anchor's threshold."""
    scores = np.zeros(wanted.shape)
    alive = wanted & (index.left_out < index.rows.shape[1])
    every, pairs = np.arange(len(index.rows)), None
    for begin in sorted(index.lists, reverse=True):
        end, held, part = index.lists[begin]
        # the coordinates before the edge have not been added up yet
        edge = np.maximum(index.left_out, begin)
        if pairs is None:
            scores[:, held] += anchors[:, begin:end] @ part.T
            rest = norms[:, edge] * index.norms[every, edge] * _SLACK
            alive &= scores + rest >= thresholds[:, None]
            if np.count_nonzero(alive) * 8 < alive.size:
                # few are left: they go on one by one
                a, r = np.nonzero(alive)
                pairs = a, r, scores[a, r]
            continue
        a, r, score = pairs
        indexed = np.arange(begin, end) >= index.left_out[r][:, None]
        score = score + np.einsum(
            "ij,ij->i", anchors[a, begin:end], np.where(indexed, index.rows[r, begin:end], 0.0)
        )
        rest = norms[a, edge[r]] * index.norms[r, edge[r]] * _SLACK
        stays = score + rest >= thresholds[a]
        pairs = a[stays], r[stays], score[stays]
    if pairs is None:
        a, r = np.nonzero(alive)
        pairs = a, r, scores[a, r]
    a, r, score = pairs
    # the coordinates that were left out of the index
    for begin in range(0, index.rows.shape[1], STEP):
        some = np.flatnonzero(index.left_out[r] > begin)
        if not len(some):
            break
        end = begin + STEP
        left = index.rows[r[some], begin:end]
        left = np.where(np.arange(begin, begin + left.shape[1]) < index.left_out[r[some]][:, None], left, 0.0)
        score[some] += np.einsum("ij,ij->i", anchors[a[some], begin:end], left)
    stays = score >= thresholds[a]
    return a[stays], r[stays], score[stays].astype(np.int64)


def prefix_norms(rows: np.ndarray) -> np.ndarray:
    """The norm of each row over its first 0, 1, ... coordinates."""
    return np.sqrt(np.hstack([np.zeros((len(rows), 1)), np.cumsum(rows * rows, axis=1)]))


class Windows:
    """The windows of one tile of anchors, and the best ``k`` rows of each found so far."""

    def __init__(self, owner: np.ndarray, name: np.ndarray, high: np.ndarray, low: np.ndarray, k: int):
        self.owner, self.name, self.high, self.low, self.k = owner, name, high, low, k
        self.found = [np.zeros(0, np.int64) for _ in range(3)]  # window, row id, score
        order = np.argsort(owner, kind="stable")
        self.order, self.sorted = order, owner[order]

    def thresholds(self, anchors: int) -> np.ndarray:
        """The least score each anchor still has use for."""
        least = np.full(anchors, float(_MOST))
        np.minimum.at(least, self.owner, self.low.astype(float))
        return least

    def add(self, anchor: np.ndarray, ids: np.ndarray, score: np.ndarray):
        """Take in what was found; a window that is full raises its ``low``."""
        first = np.searchsorted(self.sorted, anchor)
        many = np.searchsorted(self.sorted, anchor, "right") - first
        pair = np.repeat(np.arange(len(anchor)), many)
        window = self.order[
            np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        ]
        fits = (score[pair] <= self.high[window]) & (score[pair] >= self.low[window])
        pair, window = pair[fits], window[fits]
        merged = [
            np.append(old, new)
            for old, new in zip(self.found, (window, ids[pair], score[pair]), strict=True)
        ]
        order = np.lexsort((merged[1], -merged[2], merged[0]))
        window, ids, score = (x[order] for x in merged)
        begins = np.searchsorted(window, window)
        kept = np.arange(len(window)) - begins < self.k
        self.found = [x[kept] for x in (window, ids, score)]
        window, _, score = self.found
        full = np.bincount(window, minlength=len(self.name)) == self.k
        last = np.searchsorted(window, np.flatnonzero(full), "right") - 1
        self.low[full] = score[last]


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False)


def _answer(dim: int, k: int, same: bool):
    """Rows of a block, then tiles of anchors: the best of the block for every window."""
    schema = pa.schema(
        [(name, pa.int64()) for name in ("anchor_id", "window", "vec_id", "score")]
    )

    def answer(block, ids, labels, codes, windows) -> pa.RecordBatch:
        row_ids, row_labels, rows, row_norms, order = block
        anchors = codes.reshape(-1, dim).astype(float)[:, order]
        name, of, high, low = windows.reshape(-1, 4).T
        owner = np.searchsorted(ids, of)
        asked = Windows(owner, name, high, low.copy(), k)
        norms = prefix_norms(anchors)
        for begin in range(0, len(row_ids), ROWS):
            part = slice(begin, begin + ROWS)
            thresholds = asked.thresholds(len(ids))
            alike = labels[:, None] == row_labels[part]
            wanted = (alike if same else ~alike) & (ids[:, None] != row_ids[part])
            held = np.flatnonzero(wanted.any(axis=0))
            index = Index(rows[part][held], row_norms[part][held], norms.max(axis=0), thresholds.min())
            a, r, score = above(index, anchors, norms, thresholds, wanted[:, held])
            asked.add(a, row_ids[part][held][r], score)
        window, found, score = asked.found
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (ids[asked.owner[window]], asked.name[window], found, score)],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, ready = None, [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            tiles = batch.column("tile").fill_null(-1).to_numpy()
            changes = (np.diff(blocks) != 0) | (np.diff(tiles) != 0)
            edges = [0, *(np.flatnonzero(changes) + 1).tolist(), len(blocks)]
            for low, high in zip(edges, edges[1:], strict=False):
                if high == low:
                    continue
                if blocks[low] != block:
                    block, parts, ready = blocks[low], [], None
                some = batch.slice(low, high - low)
                vectors = [_matrix(some, name) for name in ("ids", "labels", "codes")]
                if tiles[low] < 0:
                    parts.append(vectors)
                    continue
                if ready is None:
                    if not parts:
                        continue
                    ids, labels, codes = (np.concatenate(x) for x in zip(*parts, strict=True))
                    codes = codes.reshape(-1, dim)
                    # coordinates that hold little come first, so that many are left out
                    order = np.argsort((codes.astype(float) ** 2).sum(axis=0), kind="stable")
                    rows = codes.astype(float)[:, order]
                    ready, parts = (ids, labels, rows, prefix_norms(rows), order), []
                yield answer(ready, *vectors, _matrix(some, "windows"))

    return run


def quantised(x: Column, scale: int = 256) -> Column:
    """The whole number at or below ``scale`` times the component, a double."""
    return F.floor(F.lit(float(scale)) * x)


def _usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    given = vectors.select(
        F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"),
        F.col(f"`{label}`").cast("int").alias("label"),
        F.col(f"`{embedding}`").cast("array<double>").alias("embedding"),
    )

    def fine(x):
        return F.coalesce(F.abs(x) < float("inf"), F.lit(False))

    square = F.aggregate(
        F.transform("embedding", lambda x: quantised(x).cast("double")),
        F.lit(0.0),
        lambda total, x: total + x * x,
    )
    return given.where(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.forall("embedding", fine)
        & (square < float(LONGEST) ** 2)
    ).select(
        "vec_id",
        "label",
        F.transform("embedding", lambda x: quantised(x).cast("int")).alias("code"),
        square.alias("square"),
    )


class Search:
    """Rows in blocks of an index, which tiles of anchors are sent to."""

    def __init__(self, rows: DataFrame, dim: int, count: int, mean_square: float, block_numbers: int):
        self.dim, self.count = dim, count
        # what a score scatters by, per unit of the anchor's norm, were all directions alike
        self.spread = math.sqrt(max(mean_square, 1.0) / max(dim, 1))
        spark = rows.sparkSession
        least = -(-count * max(dim, 1) // block_numbers)
        cores = spark.sparkContext.defaultParallelism
        self.blocks = max(1, least, min(cores, count // ROWS))
        self.rows = rows.select(
            F.pmod(F.xxhash64("vec_id"), F.lit(self.blocks)).alias("block"),
            F.lit(None).cast("bigint").alias("tile"),
            F.array("vec_id").alias("ids"),
            F.array("label").alias("labels"),
            F.col("code").alias("codes"),
            F.array().cast("array<bigint>").alias("windows"),
        )

    def _tiles(self, asked: DataFrame, anchors: DataFrame) -> DataFrame:
        """The anchors that ``asked`` has windows of, many to a row with all their windows."""
        windows = F.flatten(
            F.collect_list(F.array("window", "anchor_id", "high", "start"))
        ).alias("windows")
        asking = cut(asked.groupBy("anchor_id").agg(windows).join(anchors, "anchor_id"), "asking")
        tiles = F.lit(max(1, -(-asking.count() // ANCHORS)))
        packed = asking.groupBy(F.pmod(F.xxhash64("anchor_id"), tiles).alias("tile")).agg(
            F.array_sort(F.collect_list(F.struct("anchor_id", "label", "code", "windows"))).alias("all")
        )
        return cut(
            packed.select(
                "tile",
                F.col("all.anchor_id").alias("ids"),
                F.col("all.label").alias("labels"),
                F.flatten("all.code").alias("codes"),
                F.flatten("all.windows").alias("windows"),
            ),
            "tiles",
        )

    def best(self, asked: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """The best ``k`` rows of each window: ``anchor_id``, ``window``, ``vec_id``, ``score``.

        ``same``: rows of the anchor's label, or else those of others. ``asked`` has
        ``anchor_id``, ``window``, and the scores it spans from ``start`` to ``high``.
        """
        everywhere = F.sequence(F.lit(0).cast("bigint"), F.lit(self.blocks - 1).cast("bigint"))
        sent = self._tiles(asked, anchors).select(F.explode(everywhere).alias("block"), *_CARRIED)
        found = (
            self.rows.unionByName(sent)
            .repartition(self.blocks, "block")
            .sortWithinPartitions("block", F.col("tile").asc_nulls_first())
            .mapInArrow(
                _answer(self.dim, k, same),
                "anchor_id bigint, window bigint, vec_id bigint, score bigint",
            )
        )
        return top_per_key(found, _WINDOW, [F.col("score").desc(), F.col("vec_id")], k)

    def fill(self, asked: DataFrame, anchors: DataFrame, k: int, same: bool, share: float) -> DataFrame:
        """As ``best``, with thresholds that are lowered until the windows are full.

        ``share`` is about the share of rows that ``same`` lets through. ``asked``
        has ``anchor_id``, its ``norm``, ``window``, ``high`` and ``low``.
        """
        whole, found = max(self.count * share, 1.0), []
        for lowered in range(ROUNDS + 1):
            start = F.col("low")
            if lowered < ROUNDS:
                start = self._threshold(EXPECTED * k * LOWERING**lowered / whole)
            started = asked.withColumn("start", start)
            answers = cut(self.best(started, anchors, k, same), "answers")
            full = answers.groupBy(*_WINDOW).count().where(F.col("count") >= k).select(*_WINDOW)
            at_end = started.where(F.col("start") <= F.col("low")).select(*_WINDOW)
            done = cut(full.unionByName(at_end).distinct(), "full")
            found.append(answers.join(done, _WINDOW, "left_semi"))
            asked = cut(asked.join(done, _WINDOW, "left_anti"), "open")
            if not asked.take(1):
                break
        return cut(reduce(DataFrame.unionByName, found), "filled")

    def _threshold(self, hoped: float) -> Column:
        """A score above which, and below ``high``, about the share ``hoped`` of rows lie.

        Scores are taken as normal; how well that holds decides how often
        thresholds are lowered, never what is found.
        """
        spread = F.greatest(F.col("norm") * self.spread, F.lit(1.0))
        tail = NormalDist().inv_cdf(1 - min(max(hoped, 1e-15), 0.5))
        top = F.least(F.col("high") / spread, F.lit(tail + 1))
        # above the tail nearly nothing lies; below, the density at the top tells the width
        width = F.lit(hoped * math.sqrt(2 * math.pi)) * F.exp(F.pow(top, 2) / 2)
        start = F.when(top >= tail, F.lit(tail)).otherwise(top - F.least(width, F.lit(1e6)))
        return F.greatest(F.col("low"), F.floor(start * spread).cast("bigint"))


def mine(
    vectors: DataFrame,
    every: int = 100,
    relabelled: int = 7,
    labels: int = 10,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    block_numbers: int = BLOCK_NUMBERS,
) -> DataFrame:
    """For each anchor and positive the hardest negatives below it.

    ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``,
    ``negative_score``. Scores are inner products of whole numbers, ``quantised``
    components. Anchors are the rows whose id ``every`` divides; where ``relabelled``
    divides the id, the label first becomes the next of ``labels``. Positives are
    the best rows of the anchor's label, negatives the best of other labels that score
    between ``low_percent`` and ``high_percent`` of the positive. Higher scores come
    first, then smaller ids.

    Rows without id or label, and vectors that are null or hold nulls or numbers that
    are not finite, take no part, nor do vectors of a quantised length over
    ``LONGEST``, whose scores would not be exact. Of rows that share an id one counts,
    the first by label and vector. Coordinates that a shorter vector lacks count 0.

    The rows are dealt out in blocks, to which the anchors are sent many to a row.
    Every block gives at most what its windows can use.
    """
    given = _usable(vectors, vec_id, embedding, label)
    single = first_per_key(given, ["vec_id"], [F.col("label"), F.col("code")])
    moved = F.when(F.col("vec_id") % relabelled == 0, (F.col("label") + 1) % labels)
    rows = cut(single.withColumn("label", moved.otherwise(F.col("label"))), "rows")
    count, dim, mean_square, kinds = rows.agg(
        F.count(F.lit(1)), F.max(F.size("code")), F.avg("square"), F.count_distinct("label")
    ).first()
    if not count:
        return vectors.sparkSession.createDataFrame(
            [],
            "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
            "positive_score bigint, negative_score bigint",
        )
    dim = max(dim, 1)
    zeros = F.array_repeat(F.lit(0), F.lit(dim) - F.size("code"))
    rows = rows.withColumn("code", F.concat("code", zeros))
    search = Search(rows, dim, count, mean_square, block_numbers)
    anchors = cut(
        rows.where(F.col("vec_id") % every == 0).select(
            F.col("vec_id").alias("anchor_id"), "label", "code", F.sqrt("square").alias("norm")
        ),
        "anchors",
    )
    vector, length = anchors.drop("norm"), anchors.select("anchor_id", "norm")
    any_score = {"window": F.lit(0), "high": F.lit(_MOST), "low": F.lit(_LEAST)}
    first = length.withColumns({name: c.cast("bigint") for name, c in any_score.items()})
    alike = search.fill(first, vector, positives, True, 1 / kinds).select(
        "anchor_id", F.col("vec_id").alias("window"), F.col("score").alias("positive_score")
    )
    # in whole numbers; below 0 no score is in the window
    high = F.expr(f"positive_score * {high_percent} div 100")
    low = F.expr(f"(positive_score * {low_percent} + 99) div 100")
    windows = alike.where("positive_score >= 0").select(*_WINDOW, high.alias("high"), low.alias("low"))
    asked = cut(windows.where("low <= high").join(length, "anchor_id"), "windows")
    others = search.fill(asked, vector, negatives, False, max(1 - 1 / kinds, 1 / kinds))
    order = Window.partitionBy(*_WINDOW).orderBy(F.col("score").desc(), "vec_id")
    return (
        others.withColumn("rank", F.row_number().over(order))
        .join(alike, _WINDOW)
        .select(
            "anchor_id",
            F.col("window").alias("positive_id"),
            "rank",
            F.col("vec_id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
