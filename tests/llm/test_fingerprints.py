"""Fingerprints against a byte-by-byte gear hash and a plain walk over all documents."""

import hashlib
import random

import pytest

from tallyweave.llm import fingerprints as P


def plain_ends(data):
    ends, start = [], 0
    hashes, h = [], 0
    for byte in data:
        h = (2 * h + int(P.GEAR[byte])) % 2**32
        hashes.append(h)
    while start < len(data):
        end = min(start + P.MOST, len(data))
        for at in range(start + P.LEAST - 1, end):
            bits = P.STRICT_BITS if at + 1 <= start + P.WANTED else P.LOOSE_BITS
            if hashes[at] < 2 ** (32 - bits):
                end = at + 1
                break
        ends.append(end)
        start = end
    return ends


@pytest.mark.parametrize("size", [0, 1, 15, 16, 17, 31, 33, 64, 100, 257, 5000])
@pytest.mark.parametrize("letters", [b"ab", bytes(range(256)), b"x"])
def test_chunks(size, letters):
    random.seed(size)
    data = bytes(random.choices(letters, k=size))
    ends = P.chunk_ends(data)
    assert ends == plain_ends(data)
    chunks = P.chunk_set(data)
    assert P.parsed(P.written(chunks)) == chunks


def test_a_shift_moves_few_chunks():
    random.seed(4)
    data = bytes(random.choices(b"abcdefgh ", k=20_000))
    a, b = P.chunk_set(data), P.chunk_set(b"something new " + data)
    assert P.likeness(a, b) > 0.98
    assert P.likeness({}, {}) == 1 and P.likeness({}, a) == 0 and P.likeness(a, {}) == 0
    assert 0.4 < P.likeness(a, P.chunk_set(data[:10_000])) < 0.6


def test_beside_next_equals_a_plain_walk(spark):
    random.seed(9)
    texts = ["".join(random.choices("abcdé漢 \n", k=random.choice([0, 1, 2, 9, 80, 900]))) for _ in range(60)]
    rows = [(i * 7 % 64, t) for i, t in enumerate(texts)]
    rows += [(None, "n" * 50), (None, None), (20, "a"), (20, "b" * 300), (2**60, "z" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    docs = docs.selectExpr("*", "1 as target", "2 as place", "3 as first", "4 as range")
    ordered = sorted(
        ((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode())
    )
    want = []
    for (i, own), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        a, e, n = (P.chunk_set(t.encode()) for t in (own, edited, following))
        want.append(
            (i, len(own), hashlib.sha256(edited.encode()).hexdigest(), P.written(a),
             P.written(e), P.likeness(a, e), P.likeness(a, n))
        )
    for ranges in (1, 3, 40):
        got = [tuple(r) for r in P.beside_next(docs, ranges=ranges).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    alone = {r.fingerprint for r in P.fingerprints(docs).collect()}
    assert alone == {w[3] for w in want}


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")
    row = P.beside_next(docs).first()
    assert (row.edited_sha256, row.near_next) == (hashlib.sha256(b"abcabc").hexdigest(), 1.0)
    assert P.beside_next(docs.limit(0)).count() == 0 and P.fingerprints(docs.limit(0)).count() == 0
