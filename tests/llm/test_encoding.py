"""Encoding against the library's own on whole texts, decoding against the bytes."""

import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tallyweave.llm import encoding

ODD = [
    "", None, "a", " ", "it's we'll", "漢字😀 x", "no_space_" * 500, " " * 900, "a\n\n\n" * 200,
    "word " * 700, "a" * 70 + " " * 70 + "b" * 70, "x\t\ty " * 100, "é ñ  ß" * 90, "'s 'll" * 150,
]


@pytest.fixture(scope="module")
def library():
    ranks = {
        base64.b64decode(a): int(b)
        for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))
    }
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (100, 3), (1 << 15, 1 << 11)])
def test_equals_the_library(spark, library, chunk, overlap):
    random.seed(chunk)
    made = ["".join(random.choices("ab' s1\n\té漢", k=random.randrange(1, 600))) for _ in range(60)]
    rows = [*enumerate(ODD + made), (None, "no id " * 40), (500, "twice " * 50), (500, "twice " * 50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    docs = docs.selectExpr("*", "7 as row", "'x' as ids", "1 as chunk")
    got = encoding.decode(encoding.encode(docs, chunk=chunk, overlap=overlap)).collect()
    assert len(got) == len(rows)

    def key(r):
        return (r[0] is None, r[0] or 0)

    for row, (doc_id, text) in zip(sorted(got, key=key), sorted(rows, key=key), strict=True):
        assert row.doc_id == doc_id
        assert np.frombuffer(row.ids, "<u4").tolist() == library.encode_ordinary(text or "")
        assert bytes(row.bytes) == (text or "").encode()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert encoding.decode(encoding.encode(docs)).count() == 0
