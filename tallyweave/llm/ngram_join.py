"""N-gram Jaccard join over count vectors.

The shingles of a text are hashed into groups, and the groups' counts are its
point. A link of similarity p percent leaves at most d = n (100 - p) / p
differing shingles, n being the smaller set's size. The groups are dealt to more
than d blocks by their hash; so two linked points have the same counts in every
group of some block. These blocks are the index's boxes: boxes that span all
coordinates, as an R-tree would draw them, overlap every query at such
thresholds, while a box that is exact in one block's coordinates and open in all
others holds hardly any strangers, empty blocks aside, which are left out. A
point lies in one box per block.

Points of one box are compared by their overlap bound, the sum over coarser
groups of the smaller count: over 64 groups where whole boxes are compared, then
over 256 or, of larger sets, more for each distinct pair. Pairs that pass are verified on their exact sets.
First every point meets one other point of each of a few of its boxes, which differs
from box to box; of these a few per point are verified. What that links becomes a
component, and all pairs of points of a box, of whichever, that still lie in
different components are compared, since only components are asked for.
Such pairs grow with the square of a group, so they are never written: of the
pairs of a box that pass the bound only a spanning forest leaves its task. Points
that these forests join make a group, each point once however many boxes it shares
with others; the finer bound parts the groups again in the same way, and within
what is left pairs are verified where their exact sets lie side by side. Steps
delete the tables that no later one reads.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import Rows, narrow, rows_of, small
from tallyweave.llm.components import components
from tallyweave.runtime import cut, discard

_U = np.uint64
# Groups of the finer bound, of which a larger set has more, up to so many; groups of the coarser.
_GROUPS, _MOST_GROUPS, _COARSE = 256, 1 << 16, 64
# Most points and shingles of a box (its last point's aside) that make a tile; a task compares the
# points of one or two tiles at a time. Words whose hash a worker remembers.
TILE, TILE_SHINGLES, REMEMBERED = 4096, 1 << 21, 100_000
# Rows and columns of the block of pairs that is compared at once.
_BLOCK = 512
# Boxes and pairs of a point that are looked at before all of them are.
_FEW_BOXES, _FEW = 8, 4
# Pairs of a box and a point that a task sorts at a time, and bytes of a box's hash within them:
# strangers that meet since their boxes have the same hash are told apart like any others.
BUCKET, _BOX_BYTES = 1 << 19, 5
_LONGEST = 1 << 40  # shingles of the largest set provided for


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    """64-bit hash of each word met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(text: str, words: int, known: _Words) -> np.ndarray:
    """Sorted hashes of the distinct shingles; all words as one if there are fewer.

    A-Z count as a-z; words are parted by space and the control characters 9 to 13.
    """
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    size = min(words, len(found))
    hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    out = np.full(len(hashes) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - size + 1 + i])
    return np.unique(out)


@dataclass(frozen=True)
class Bands:
    """Which sizes are compared in which blocks, for similarities of ``percent`` or more."""

    percent: int

    def differing(self, largest: int) -> int:
        """Most shingles that only one of two linked sets has, if neither has more than ``largest``."""
        return 2 * largest * (100 - self.percent) // (100 + self.percent)

    def needed(self, a: int, b: int) -> int:
        """Fewest shingles that linked sets of these sizes share."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def starts(self) -> list[int]:
        """Least sizes of the bands. Linked sizes lie in one band or two neighbours."""
        ratio = (100 / self.percent) ** 3
        out = [-(-self.percent // (100 - self.percent))]
        while out[-1] < _LONGEST:
            out.append(max(out[-1] + 1, math.ceil(out[-1] * ratio)))
        return out

    def of(self, size: int, starts: list[int]) -> list[tuple[int, int]]:
        """(band, number of blocks) under which a set of ``size`` is filed.

        A band's blocks outnumber the differences of any link within it; a set
        that a set of the next band can link with is filed there too.
        """
        band = bisect_right(starts, size) - 1
        if band < 0:
            return []  # so small that only equal sets are linked
        found = [(band, self.differing(starts[band + 1] - 1) + 1)]
        if 100 * size >= self.percent * starts[band + 1]:
            found.append((band + 1, self.differing(starts[band + 2] - 1) + 1))
        return found


def boxes(shingles: np.ndarray, filed: list[tuple[int, int]]) -> np.ndarray:
    """A key for each box: band, block, and a linear hash of the block's 65,536 group counts.

    A quarter more blocks are made than asked for, and as many of the emptiest are
    left out: of the blocks that two linked sets have in common, at least one more
    than are left out, the fullest stays with both. Ties go by place.
    """
    weights = _mix((shingles & _U(0xFFFF)) + _U(0x9E3779B97F4A7C15))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weights)])
    high, made = shingles >> _U(32), []
    for band, asked in filed:
        blocks = asked + (asked + 3) // 4
        block = (high * _U(blocks)) >> _U(32)
        edges = np.searchsorted(block, np.arange(blocks + 1, dtype=np.uint64))
        counts = sums[edges[1:]] - sums[edges[:-1]]
        of_band = np.full(blocks, band + 1, np.uint64) * _U(0xD1B54A32D192ED03)
        place = _mix(np.arange(blocks, dtype=np.uint64) + of_band)
        fullest = np.argsort(-np.diff(edges), kind="stable")[:asked]
        made.append(_mix(counts + place)[fullest])
    return np.concatenate(made) if made else np.zeros(0, np.uint64)


def counts(shingles: np.ndarray) -> bytes:
    """Counts of 256 groups or, of larger sets, of parts of these, a byte each.

    A count of more than 255 is 255, which only loosens a bound. There are so many
    parts that a count is 4 on average at most: with larger ones, any two sets of a
    size would pass.
    """
    parts = 1
    while 4 * _GROUPS * parts < len(shingles) and _GROUPS * parts < _MOST_GROUPS:
        parts *= 2
    group = ((shingles >> _U(8)) & _U(_GROUPS - 1)) * _U(parts)
    most = _MOST_GROUPS // _GROUPS
    group += ((shingles >> _U(16)) & _U(most - 1)) // _U(most // parts)
    found = np.bincount(group.astype(np.int64), minlength=_GROUPS * parts)
    return np.minimum(found, 255).astype(np.uint8).tobytes()


def _folded(vectors: np.ndarray, groups: int) -> np.ndarray:
    """The rows' counts by fewer groups, again 255 at most."""
    if vectors.shape[1] == groups:
        return vectors
    summed = vectors.reshape(len(vectors), groups, -1).sum(axis=2)
    return np.minimum(summed, 255).astype(np.uint8)


def _key(shingles: np.ndarray) -> int:
    """What stands for a set: equal sets have it equal, others differ but for 64-bit chance."""
    return int(_mix(np.array([_mix(shingles).sum() ^ _U(len(shingles))]))[0].astype(np.int64))


def _sketch(words: int, bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, starts, met, out = _Words(), bands.starts(), set(), None
        for batch in batches:
            out = out or Rows(
                pa.schema(
                    [("doc_id", batch.column("doc_id").type), ("n", pa.int64()),
                     ("key", pa.int64()), ("counts", pa.binary()), ("coarse", pa.binary()),
                     ("boxes", pa.list_(pa.int64()))]
                )
            )
            for doc_id, text in rows_of([batch], ("doc_id", "text")):
                shingles = shingle_set(text, words, known)
                key = _key(shingles) if len(shingles) else None
                row, size = (doc_id, len(shingles), key, None, None, None), 64
                if key is not None and key not in met:  # copies add no point
                    met.add(key)
                    filed = boxes(shingles, bands.of(len(shingles), starts))
                    vector = counts(shingles)
                    row = (*row[:3], vector, coarse(vector), filed.view(np.int64))
                    size += 400 + 8 * len(filed)
                if out.add(row, size):
                    yield out.batch()
        if out:
            yield out.batch()

    return run


def _sets(words: int):
    schema = pa.schema([("key", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = _Words(), Rows(schema)
        for (text,) in rows_of(batches, ("text",)):
            shingles = shingle_set(text, words, known)
            if len(shingles) and out.add((_key(shingles), shingles.tobytes()), 8 * len(shingles)):
                yield out.batch()
        yield out.batch()

    return run


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def coarse(vector: bytes) -> bytes:
    """The counts of 64 groups of groups, again a byte each and 255 at most."""
    return _folded(np.frombuffer(vector, np.uint8)[None], _COARSE).tobytes()


def _minima(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of rows, the sum of the smaller counts."""
    if len(a) * len(b) <= 2048 or a.shape[1] > _GROUPS:
        return np.minimum(a[:, None], b[None]).sum(axis=2, dtype=np.int32)
    out, left, right = np.zeros((len(a), len(b)), np.uint16), a.T.copy(), b.T.copy()
    for x, y in zip(left, right, strict=True):
        out += np.minimum(x[:, None], y[None])
    return out.astype(np.int32)


def _passes(bands: Bands, a_n: np.ndarray, a: np.ndarray, b_n: np.ndarray, b: np.ndarray):
    """Which points of ``a`` may link with which of ``b``, by size and by the overlap bound.

    Counts that are cut off at 255 differ no more than the true ones. So what two
    points share is at most half of their sizes' sum less their counts' differences,
    and these are the counts' sums less twice the smaller ones.
    """
    low, high = np.minimum(a_n[:, None], b_n), np.maximum(a_n[:, None], b_n)
    fits, total = 100 * low >= bands.percent * high, low + high
    sums = a.sum(axis=1, dtype=np.int64)[:, None] + b.sum(axis=1, dtype=np.int64)
    needed = -(-bands.percent * total // (100 + bands.percent))
    return fits & ((total - sums) // 2 + _minima(a, b) >= needed)


def _bound(bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(_PAIR)
        names = ("a", "b", "a_n", "b_n", "a_counts", "b_counts")
        for a, b, a_n, b_n, a_counts, b_counts in rows_of(batches, names):
            x, y = (np.frombuffer(c, np.uint8)[None] for c in (a_counts, b_counts))
            x, y = (_folded(v, min(x.shape[1], y.shape[1])) for v in (x, y))
            if _passes(bands, np.array([a_n]), x, np.array([b_n]), y)[0, 0] and out.add((a, b)):
                yield out.batch()
        yield out.batch()

    return run


def _linked(bands: Bands, x: np.ndarray, y: np.ndarray) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= bands.percent * (len(x) + len(y) - shared)


def _verify(bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(_PAIR)
        for a, b, a_set, b_set in rows_of(batches, ("a", "b", "a_set", "b_set")):
            x, y = np.frombuffer(a_set, np.uint64), np.frombuffer(b_set, np.uint64)
            if _linked(bands, x, y) and out.add((a, b)):
                yield out.batch()
        yield out.batch()

    return run


def _tile_pairs(batches: Iterator[pa.RecordBatch], *more: str):
    """Box, low, high and rows (key, label, n, tile, ``more``) of pairs of tiles with several points."""
    names, of, held = ("box", "low", "high", "key", "label", "n", "tile", *more), None, []
    for row in rows_of(batches, names):
        if row[:3] != of:
            if len(held) > 1:
                yield *of, held
            of, held = row[:3], []
        held.append(row[3:])
    if len(held) > 1:
        yield *of, held


def _near(bands: Bands, rows: list[tuple], one_tile: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Each point's place among ``rows`` with those that may link with it, by label, size and bound.

    Every pair comes once; pairs within a tile only if there is one.
    """
    labels, sizes, tiles = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
    vectors = [np.frombuffer(r[4], np.uint8)[None] for r in rows]
    blocked = np.concatenate([_folded(v, _COARSE) for v in vectors])
    groups = np.array([v.shape[1] for v in vectors])
    fine = {}  # by number of groups: the counts of those points that have as many, and their places
    for least in np.unique(groups[groups > _COARSE]).tolist():
        having = groups >= least
        counted = [_folded(vectors[i], least) for i in np.flatnonzero(having)]
        fine[least] = np.concatenate(counted), np.cumsum(having) - 1
    own = np.flatnonzero(tiles == tiles.min())
    others = own if one_tile else np.flatnonzero(tiles != tiles.min())
    for i in range(0, len(own), _BLOCK):
        for j in range(i if one_tile else 0, len(others), _BLOCK):
            a, b = own[i : i + _BLOCK], others[j : j + _BLOCK]
            near = _passes(bands, sizes[a], blocked[a], sizes[b], blocked[b])
            near &= labels[a][:, None] != labels[b]
            if one_tile:
                near &= a[:, None] < b
            for x in np.flatnonzero(near.any(axis=1)):
                at, found = a[x : x + 1], b[near[x]]
                for least, (counted, place) in fine.items():
                    of = np.minimum(groups[found], groups[at]) == least
                    y = found[of]
                    of[of] = ~_passes(
                        bands, sizes[at], counted[place[at]], sizes[y], counted[place[y]]
                    )[0]
                    found = found[~of]
                yield int(at[0]), found


def _partners(bands: Bands):
    """Of each box and pair of its tiles, for each point one that passes the bound.

    It is the first in an order that the box's own key shuffles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(_PAIR)
        for box, low, high, rows in _tile_pairs(batches, "coarse"):
            keys = np.array([r[0] for r in rows])
            shuffled = _mix(keys.view(np.uint64) ^ np.array([box]).view(np.uint64))
            place = shuffled.argsort().argsort()
            first = np.full(len(rows), len(rows))  # place of the point each is to meet
            for x, found in _near(bands, rows, low == high):
                first[x] = min(first[x], place[found].min(initial=len(rows)))
                first[found] = np.minimum(first[found], place[x])
            at = np.argsort(place)
            for i in np.flatnonzero(first < len(rows)):
                pair = int(keys[i]), int(keys[at[first[i]]])
                if out.add((min(pair), max(pair))):
                    yield out.batch()
        yield out.batch()

    return run


def _forest(bands: Bands, vector: str, verified: bool = False):
    """Of each box and pair of its tiles, pairs that join all that pairs passing the bound join.

    With ``verified`` only pairs whose exact sets are similar enough count, and
    points of one label are joined from the start. So a point adds one pair at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(_PAIR)
        for _, low, high, rows in _tile_pairs(batches, vector, *["shingles"] * verified):
            sets = [np.frombuffer(r[5], np.uint64) for r in rows] if verified else []
            group = np.arange(len(rows))
            if verified:
                group = np.unique([r[1] for r in rows], return_inverse=True)[1]
            for x, found in _near(bands, rows, low == high):
                for y in found[group[found] != group[x]].tolist():
                    if group[x] == group[y]:
                        continue
                    if verified and not _linked(bands, sets[x], sets[y]):
                        continue
                    group[group == group[y]] = group[x]
                    pair = rows[x][0], rows[y][0]
                    if out.add((min(pair), max(pair))):
                        yield out.batch()
        yield out.batch()

    return run


def _with_points(pairs: DataFrame, points: DataFrame) -> DataFrame:
    for end in "ab":
        side = points.select(
            F.col("key").alias(end), F.col("n").alias(f"{end}_n"),
            F.col("counts").alias(f"{end}_counts"),
        )
        pairs = pairs.join(side, end)
    return pairs


def _sets_of(wanted: DataFrame, rows: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """``key`` and ``shingles`` of the sets whose ``key`` is wanted, as a written table."""
    # one document of each wanted set; another text under its id is told apart by its key
    ids = classes.join(wanted, "key", "left_semi").select(F.col("first").alias("id"))
    ids = cut(ids, "wanted-ids")
    texts = rows.join(small(ids, 16), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = cut(
        texts.select("text").mapInArrow(_sets(words), "key bigint, shingles binary"), "sets"
    )
    discard(ids)
    return sets


def _links(pairs: DataFrame, rows: DataFrame, classes: DataFrame, words: int, bands: Bands):
    """The pairs (a, b) whose exact sets are similar enough, as a written table; some twice."""
    wanted = pairs.select(F.col("a").alias("key")).unionByName(
        pairs.select(F.col("b").alias("key"))
    )
    sets = _sets_of(wanted, rows, classes, words)
    for end in "ab":
        side = sets.select(F.col("key").alias(end), F.col("shingles").alias(f"{end}_set"))
        pairs = pairs.join(side, end)
    verified = cut(pairs.mapInArrow(_verify(bands), "a bigint, b bigint"), "verified")
    discard(sets)
    return verified


def _dealt(buckets: int):
    """The (box, key) pairs of a batch of points, packed by bucket of boxes."""
    schema = pa.schema([("bucket", pa.int32()), ("pairs", pa.binary())])

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The batch by runs of points of about ``BUCKET`` pairs."""
        sizes = batch.column("boxes").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.diff(np.cumsum(sizes) // BUCKET, prepend=-1))
        for i, j in zip(begins, np.append(begins, len(sizes))[1:], strict=True):
            yield batch.slice(i, j - i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole)):
            boxes = batch.column("boxes")
            sizes = boxes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            box = boxes.flatten().to_numpy(zero_copy_only=False).view(_U)
            keys = np.repeat(batch.column("key").to_numpy(zero_copy_only=False), sizes)
            bucket = (box % _U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            pairs = np.empty((len(box), _BOX_BYTES + 8), np.uint8)
            within = np.ascontiguousarray((box // _U(buckets))[order], "<u8")
            pairs[:, :_BOX_BYTES] = within.view(np.uint8).reshape(-1, 8)[:, :_BOX_BYTES]
            pairs[:, _BOX_BYTES:] = keys[order].astype("<i8").view(np.uint8).reshape(-1, 8)
            bucket = bucket[order]
            begins = np.flatnonzero(np.diff(bucket, prepend=-1))
            # sets so small that only equal ones link have no box, so a batch may have none
            ends = np.append(begins, len(bucket))[1:]
            packed = [pairs[i:j].tobytes() for i, j in zip(begins, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[begins]), pa.array(packed, pa.binary())], schema=schema
            )

    return run


def _shared(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """``box``, ``key`` and ``pivot`` of the boxes of several points in a bucket."""
    found = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, _BOX_BYTES + 8)
    boxes = np.zeros((len(found), 8), np.uint8)
    boxes[:, :_BOX_BYTES] = found[:, :_BOX_BYTES]
    keys = np.ascontiguousarray(found[:, _BOX_BYTES:])
    pairs = np.stack([boxes.view("<i8")[:, 0], keys.view("<i8")[:, 0]], axis=1)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    # a set that several tasks have met lies in a box once
    pairs = pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))]
    begins = np.flatnonzero(np.append(True, pairs[1:, 0] != pairs[:-1, 0]))
    sizes = np.diff(np.append(begins, len(pairs)))
    several = np.repeat(sizes > 1, sizes)
    if not several.any():
        return None
    keys, begins = pairs[several, 1], begins[sizes > 1]
    sizes = sizes[sizes > 1]
    begins = np.cumsum(sizes) - sizes
    # boxes of the same points are one: their hash takes in the number, the ends and a mix of all
    box = np.add.reduceat(_mix(keys.view(_U)), begins)
    for part in (keys[begins], keys[begins + sizes - 1], sizes):
        box = _mix(box) + part.astype(np.int64).view(_U)
    return np.repeat(box.view(np.int64), sizes), keys, np.repeat(keys[begins], sizes)


def _shared_boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The points of boxes of several, bucket by bucket."""
    schema = pa.schema([(name, pa.int64()) for name in ("box", "key", "pivot")])

    def made(packed: list[bytes]):
        found = _shared(packed) if packed else None
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=schema)

    current, held = None, []
    for bucket, packed in rows_of(batches, ("bucket", "pairs")):
        if bucket != current:
            yield from made(held)
            current, held = bucket, []
        held.append(packed)
    yield from made(held)


def _filed(sketch: DataFrame) -> DataFrame:
    """``box``, ``key`` and ``pivot`` of the boxes of several points, one for each set of points.

    Most boxes hold one point. So the pairs of box and point travel packed, 13 bytes
    each, in buckets of about ``BUCKET`` pairs, and only boxes of several become rows. A task
    gets one bucket, since all it gets comes to Python at once.
    """
    placed = sketch.where("boxes is not null").select("key", "boxes")
    pairs = placed.agg(F.sum(F.size("boxes"))).first()[0] or 0
    buckets = max(1, -(-pairs // BUCKET))
    return (
        placed.mapInArrow(_dealt(buckets), "bucket int, pairs binary")
        .repartitionById(buckets, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_shared_boxes, "box bigint, key bigint, pivot bigint")
        .distinct()
    )


def _tiled(
    boxes: DataFrame, vectors: DataFrame, bands: Bands, shingles: float = 1.0
) -> DataFrame:
    """The points of each box (``box``, ``key``, ``label``, ``n``) by pairs of tiles.

    ``vectors`` has what else a point takes along, by ``key``; it is joined to the
    tiles, so it travels once for each. Of a point ``n * shingles`` count towards a
    tile's size. Tiles are in the order of ``n``, and a point goes only where its
    size lets it have links.
    """
    ordered, whole = Window.partitionBy("box").orderBy("n", "key"), Window.partitionBy("box")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.lit(-(-TILE_SHINGLES // TILE)).cast("bigint")
    size = F.greatest(F.ceil(F.col("n") * F.lit(shingles)), least)
    tiled = (
        boxes.withColumn("tile", F.floor((F.sum(size).over(so_far) - size) / TILE_SHINGLES))
        .withColumn("tile", F.col("tile") - F.lag("tile", 1, -1).over(ordered) > 0)
        .withColumn("starts", F.collect_list(F.when(F.col("tile"), F.col("n"))).over(whole))
        .withColumn("tile", F.sum(F.col("tile").cast("bigint")).over(so_far) - 1)
    )
    # tiles that end before the first size that fits, and those that start beyond the last
    short = F.size(F.filter("starts", lambda s: 100 * s < bands.percent * F.col("n")))
    within = F.size(F.filter("starts", lambda s: bands.percent * s <= 100 * F.col("n")))
    others = F.explode(F.sequence(F.greatest(short - 1, F.lit(0)), within - 1))
    return (
        tiled.select("box", "key", "label", "n", "tile", others.alias("other"))
        .withColumn("low", F.least("tile", "other"))
        .withColumn("high", F.greatest("tile", "other"))
        .drop("other")
        .join(vectors, "key")
        .repartition("box", "low", "high")
        .sortWithinPartitions("box", "low", "high", "key")
    )


def _apart(points_of_boxes: DataFrame) -> DataFrame:
    """``box``, ``key``, ``label`` and ``n`` in boxes that hold several labels."""
    by_box = Window.partitionBy("box")
    return (
        points_of_boxes.withColumn("least", F.min("label").over(by_box))
        .withColumn("most", F.max("label").over(by_box))
        .where("least <> most")
        .select("box", "key", "label", "n")
    )


def _missing_links(
    filed: DataFrame, labels: DataFrame, points: DataFrame, bands: Bands, sets_of
) -> DataFrame:
    """Links that join all that links between points of different labels join.

    ``sets_of`` gives the exact sets of keys. Each step hands on the groups that the
    pairs it lets pass join, not these pairs.
    """
    schema = "a bigint, b bigint"

    def rest(boxes: DataFrame) -> DataFrame:
        named = boxes.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
        return _apart(named.join(points.select("key", "n"), "key"))

    near = _tiled(rest(filed), points.select("key", "coarse"), bands, 0.0)
    joined = cut(near.mapInArrow(_forest(bands, "coarse"), schema).distinct(), "near-by-coarse")
    for last in (False, True):
        if not joined.take(1):
            return joined
        groups = components(joined)
        discard(joined)
        vectors = points.select("key", "counts")
        sets = sets_of(groups.select(F.col("node").alias("key"))) if last else None
        if last:
            vectors = vectors.join(sets, "key")
        boxes = groups.select(F.col("node").alias("key"), F.col("label").alias("box"))
        tiled = _tiled(rest(boxes), vectors, bands, 1.0 if last else 1 / 8)
        found = tiled.mapInArrow(_forest(bands, "counts", last), schema)
        joined = cut(found, "missing-links" if last else "near-by-counts")
        discard(groups, *[sets] * last)
    return joined


def join(
    documents: DataFrame,
    words: int = 5,
    percent: int = 80,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document.

    Two documents are linked if 100 times the shingles they share is at least
    ``percent`` times those that either has (``percent`` from 50 to 99);
    ``component_id`` is the smallest id reachable by links, the own included. A
    document without words, or with null text, has no shingles and no link.
    Documents of fewer than ``words`` words have one shingle, all their words.

    A null id counts only where no other is reachable. Repeated rows are kept and
    linked; other columns are ignored; an empty table gives no rows. No link
    between different texts is lost: pairs are left unverified only if their
    bound rules them out, or if links already found join them.
    """
    bands = Bands(percent)
    rows = narrow(documents, doc_id, text)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    sketch = cut(
        rows.mapInArrow(
            _sketch(words, bands),
            f"doc_id {id_type}, n bigint, key bigint, counts binary, coarse binary, boxes array<bigint>",
        ),
        "sketch",
    )
    own = cut(sketch.select("doc_id", F.col("n").alias("n_shingles"), "key"), "own")
    classes = cut(
        own.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first")),
        "classes",
    )
    filed = cut(_filed(sketch), "boxes")
    points = cut(
        sketch.where("boxes is not null")
        .select("key", "n", "counts", "coarse")
        .join(filed.select("key").distinct(), "key", "left_semi")
        .dropDuplicates(["key"]),
        "points",
    )
    discard(sketch)

    first = Window.partitionBy("key").orderBy(F.xxhash64("box"))
    alone = (
        filed.join(points.select("key", "n"), "key")
        .withColumn("label", F.col("key"))
        .withColumn("few", F.row_number().over(first) <= _FEW_BOXES)
        .where("few")
    )
    met = _tiled(_apart(alone), points.select("key", "coarse"), bands, 0.0)
    found = met.mapInArrow(_partners(bands), "a bigint, b bigint").distinct()
    some = Window.partitionBy("a").orderBy(F.xxhash64("a", "b"))
    few = found.withColumn("few", F.row_number().over(some) <= _FEW).where("few").select("a", "b")
    candidates = cut(few, "candidates")
    close = _with_points(candidates, points).mapInArrow(_bound(bands), "a bigint, b bigint")
    near = cut(close, "near-candidates")
    links = _links(near, rows, classes, words, bands)
    found = components(links)
    labels = found.withColumnRenamed("node", "key")
    missing = _missing_links(
        filed, labels, points, bands, lambda keys: _sets_of(keys, rows, classes, words)
    )
    discard(filed, points, candidates, near)
    if missing.take(1):
        discard(found)
        found = components(links.unionByName(missing))
    labels = found.withColumnRenamed("node", "key")
    named = cut(
        classes.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")),
        "labelled",
    )
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of_class = cut(named.join(least, "label").select("key", "component_id"), "components")
    discard(classes, links, missing, found, named)
    linked = own.where("key is not null").join(of_class, "key")
    alone = own.where("key is null").withColumn("component_id", F.col("doc_id"))
    return linked.select("doc_id", "n_shingles", "component_id").unionByName(
        alone.select("doc_id", "n_shingles", "component_id")
    )
