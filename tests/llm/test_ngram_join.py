"""The n-gram join against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyweave import runtime
from tallyweave.llm import ngram_join as J

FOLDER = "/root/testdata/sf0.01"


def plain_set(text, words):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not found:
        return frozenset()
    if len(found) < words:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def brute(rows, words, percent):
    """Components by walking over all pairs that share a shingle."""
    sets = [plain_set(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = {}
    for i, shingles in enumerate(sets):
        for shingle in shingles:
            holders.setdefault(shingle, []).append(i)
    pairs = {(a, b) for held in holders.values() for a in held for b in held if a < b}
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            parent[root(a)] = root(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(
        ((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)),
        key=repr,
    )


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def edited(words, edits):
    words = list(words)
    for _ in range(edits):
        words[random.randrange(len(words))] = f"new{random.randrange(10**6)}"
    return words


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80), (1, 50), (3, 60)])
def test_planted_copies(spark, words, percent):
    random.seed(percent)
    rows = []
    for _ in range(25):
        base = [f"w{random.randrange(400)}" for _ in range(random.choice([4, 12, 30, 90, 400]))]
        for _ in range(random.randrange(1, 9)):
            rows.append(" ".join(edited(base, random.randrange(0, 1 + len(base) // 12))))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [passage + f" tail {i} " * 3 for i in range(15)]
    rows += ["", None, " \t\n", "one", "ONE", "two words", "Two Words", "é É", "É É", "a\x0bb\x1cc d e"]
    rows = [(i * 3 % 1009, t) for i, t in enumerate(rows)]
    rows += [(None, rows[0][1]), (None, "only null"), (2000, rows[0][1]), (2000, rows[0][1])]
    rows += [(2001, "same id one two three"), (2001, "same id other four five six")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    df = df.selectExpr("*", "1 as key", "2 as n", "3 as box", "4 as first")
    assert got(J.join(df, words, percent)) == brute(rows, words, percent)


def test_a_dense_group_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(J, "TILE", 7)
    random.seed(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(base, random.randrange(0, 9)))) for i in range(250)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(J.join(df, 3, 90)) == brute(rows, 3, 90)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_a_box(percent):
    random_ = np.random.default_rng(percent)
    bands = J.Bands(percent)
    starts = bands.starts()
    for _ in range(300):
        size = int(random_.integers(1, 400))
        base = np.unique(random_.integers(0, 2**63, size).astype(np.uint64))
        drop = int(random_.integers(0, size // 4 + 1))
        new = random_.integers(0, 2**63, int(random_.integers(0, size // 4 + 1))).astype(np.uint64)
        other = np.unique(np.concatenate([base[drop:], new]))
        shared = len(np.intersect1d(base, other))
        union = len(base) + len(other) - shared
        if 100 * shared >= percent * union and union > shared:
            a, b = (set(J.boxes(x, bands.of(len(x), starts)).tolist()) for x in (base, other))
            assert a & b
            assert bands.needed(len(base), len(other)) <= shared
            sizes = [np.array([len(x)]) for x in (base, other)]
            for view in (J.counts, lambda x: J.coarse(J.counts(x))):
                v, w = (np.frombuffer(view(x), np.uint8)[None] for x in (base, other))
                assert J._passes(bands, sizes[0], v, sizes[1], w)[0, 0]


def test_linked_sets_with_counts_of_different_length_pass():
    """Counts of more groups are folded to those of fewer."""
    random_ = np.random.default_rng(8)
    bands = J.Bands(80)
    for size, larger in ((1000, 1200), (2000, 2400), (4090, 4112), (8000, 9000), (300_000, 310_000)):
        big = np.unique(random_.integers(0, 2**64, larger, np.uint64))
        sets = [np.sort(random_.permutation(big)[:size]), big]
        assert J._linked(bands, *sets)
        rows = [(i, i, len(x), 0, J.counts(x)) for i, x in enumerate(sets)]
        assert [(x, y.tolist()) for x, y in J._near(bands, rows, True)] == [(0, [1])]


def test_unrelated_large_sets_do_not_pass():
    """Over 256 groups any two sets of some thousand shingles passed, and made one large group."""
    random_ = np.random.default_rng(6)
    sets = [np.unique(random_.integers(0, 2**64, 9000, np.uint64)) for _ in range(4)]
    rows = [(i, i, len(x), 0, J.counts(x)) for i, x in enumerate(sets)]
    assert not sum(len(found) for _, found in J._near(J.Bands(80), rows, True))


def test_a_point_goes_only_to_tiles_of_sizes_that_fit(spark, monkeypatch):
    monkeypatch.setattr(J, "TILE", 4)
    rows = [(7, key, key, 10 * key) for key in range(1, 41)]
    boxes = spark.createDataFrame(rows, "box bigint, key bigint, label bigint, n bigint")
    vectors = boxes.select("key", F.lit("v").alias("vector"))
    tiles = {}
    for r in J._tiled(boxes, vectors, J.Bands(80)).collect():
        assert r.vector == "v" and r.tile in (r.low, r.high)
        tiles.setdefault(r.key, set()).add((r.low, r.high))
    for a in range(1, 41):
        for b in range(a + 1, 41):
            assert tiles[a] & tiles[b] or 100 * a < 80 * b, (a, b)
    assert max(map(len, tiles.values())) < 6 < len({t for own in tiles.values() for t in own})


def test_only_tables_that_the_result_reads_stay(spark):
    """All tables of the join stayed until the end, near four fifths of its input."""
    written = runtime._written.setdefault(spark.sparkContext.applicationId, [])
    before = len(written)
    rows = [(i, " ".join(f"w{j}" for j in range(i % 3, 40))) for i in range(9)]
    rows += [(9 + i, f"x{i} y z " + " ".join(f"v{i}{j}" for j in range(30))) for i in range(4)]
    out = J.join(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 80)
    left = {re.split("-[0-9a-f]{32}", path.rpartition("/")[2])[0] for path in written[before:]}
    assert left <= {"own", "components"}
    assert got(out) == brute(rows, 3, 80)


def test_minima_of_blocks_of_any_size():
    random_ = np.random.default_rng(5)
    for rows, others in ((1, 1), (3, 700), (90, 80), (512, 512)):
        a, b = (random_.integers(0, 256, (k, 64)).astype(np.uint8) for k in (rows, others))
        want = np.array([np.minimum(x, b).astype(int).sum(axis=1) for x in a])
        assert (J._minima(a, b) == want).all()


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_given_documents(spark, words, percent):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(J.join(df, words, percent)) == brute(rows, words, percent)


def test_copies_in_several_partitions_leave_boxes_apart(spark):
    rows = [(key, [10 * (key // 2), 1000]) for key in range(2, 8)]
    for copies in (1, 2, 3):
        sketch = spark.createDataFrame(rows * copies, "key bigint, boxes array<bigint>")
        filed = J._filed(sketch.repartition(copies)).collect()
        keys = {}
        for row in filed:
            keys.setdefault(row.box, []).append(row.key)
        assert sorted(map(sorted, keys.values())) == [[2, 3], [2, 3, 4, 5, 6, 7], [4, 5], [6, 7]]


def test_a_task_reads_one_bucket(spark, monkeypatch):
    """Several buckets in a task all came to Python at once."""
    monkeypatch.setattr(J, "BUCKET", 8)

    def buckets(batches):
        met = {b for batch in batches for b in batch.column("bucket").to_pylist()}
        if met:
            row = [pa.array([x]) for x in (len(met), min(met), 0)]
            yield pa.RecordBatch.from_arrays(row, ["box", "key", "pivot"])

    monkeypatch.setattr(J, "_shared_boxes", buckets)
    rows = [(key, list(range(4 * key, 4 * key + 4))) for key in range(40)]
    got = J._filed(spark.createDataFrame(rows, "key bigint, boxes array<bigint>")).collect()
    assert sorted((r.key, r.box) for r in got) == [(i, 1) for i in range(20)]


def test_pairs_are_packed_a_few_points_at_a_time(monkeypatch):
    monkeypatch.setattr(J, "BUCKET", 6)
    names = ["key", "boxes"]
    columns = [pa.array(range(10)), pa.array([[i, 20, 30] for i in range(10)])]
    whole = pa.RecordBatch.from_arrays(columns, names)
    packed = [b for batch in J._dealt(1)(iter([whole])) for b in batch.column("pairs").to_pylist()]
    assert len(packed) >= 5 and max(map(len, packed)) <= 13 * 9
    assert sum(map(len, packed)) == 13 * 30


def box_of(rows, vector):
    names = ["box", "low", "high", "key", "label", "n", "tile", vector, "shingles"]
    columns = [pa.array([0] * len(rows))] * 3 + [pa.array(c) for c in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


def test_a_box_sends_no_more_pairs_than_points():
    """Pairs that pass the bound grew with the square of a box's points."""
    rows = [(i, i, 64, 0, bytes([1] * 64), b"") for i in range(60)]
    out = list(J._forest(J.Bands(90), "coarse")(iter([box_of(rows, "coarse")])))
    pairs = [(a, b) for batch in out for a, b in zip(*batch.to_pydict().values(), strict=True)]
    assert len(pairs) == 59 and {k for pair in pairs for k in pair} == set(range(60))


def test_a_box_sends_links_that_join_different_labels():
    random_ = np.random.default_rng(9)
    bases = [np.unique(random_.integers(0, 2**63, 100).astype(np.uint64)) for _ in range(3)]
    rows = []
    for i in range(30):
        mine = np.sort(bases[i % 3][i // 3 % 5 :])
        label = 900 if i < 6 and i % 3 == 0 else i  # 0 and 3 are joined already
        rows.append((i, label, len(mine), 0, J.counts(mine), mine.tobytes()))
    out = list(J._forest(J.Bands(90), "counts", True)(iter([box_of(rows, "counts")])))
    pairs = [(a, b) for batch in out for a, b in zip(*batch.to_pydict().values(), strict=True)]
    assert all(a % 3 == b % 3 for a, b in pairs)
    assert len(pairs) == 27 - 1


def test_empty_table(spark):
    assert J.join(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
