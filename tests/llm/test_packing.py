"""Packing against a plain walk over the same stream."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyweave.llm import bytebpe, packing, queries

JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


ODD = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a\n b", "a \nb", "a\n\nb", "\ta\tb", "it's we'll I'D",
    "x<|endoftext|>y", "x <|endoftext|> y", "<|endoftext|>", "é<|endoftext|><|endoftext|>\n", "é è ñ ß", "漢字 かな 😀 ‍", "a  b", "　", "1 22 333", "a\r\nb",
    "loooong " * 3000, "\x1c\x1d a\x1fb", "ends\n", "  lead",
]


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_tokenizers(tokenizer, text):
    encode = bytebpe.encoder(JSON, public_tokenizers.PATTERN, added=True)
    got = np.frombuffer(encode.packed(text), encode.kind).tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sté 1.\n\t\r  !漢"), max_size=40))
def test_ids_of_any_text(tokenizer, text):
    encode = bytebpe.encoder(JSON, public_tokenizers.PATTERN, added=True)
    got = np.frombuffer(encode.packed(text), encode.kind).tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_added_tokens_as_plain_text():
    plain = Tokenizer.from_file(JSON)
    plain.encode_special_tokens = True
    encode = bytebpe.encoder(JSON, public_tokenizers.PATTERN)
    for text in ODD:
        got = np.frombuffer(encode.packed(text), encode.kind).tolist()
        assert got == plain.encode(text, add_special_tokens=False).ids


def test_pieces_tile_the_stream(spark, tokenizer):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "a"), (3, "a"), (99, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    docs = docs.selectExpr("*", "1 as length", "'x' as ids", "2 as part", "3 as offset")
    pieces = packing.pack(docs, length=64)
    got = pieces.orderBy("sequence_id", "offset").collect()
    at = 0
    for row in got:  # gapless, and cut at the windows only
        assert row.sequence_id * 64 + row.offset == at
        assert 0 < row.length <= 64 - row.offset
        assert len(row.ids) == 4 * row.length
        at += row.length
    whole = {}
    for row in got:
        whole.setdefault(row.doc_id, []).append((row.start, row.ids))
    for doc_id, text in rows:
        if doc_id != 3:
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
            packed = b"".join(ids for _, ids in sorted(whole[doc_id]))
            assert packed == np.array(ids, "<u4").tobytes()
    assert at == sum(
        len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows
    )
    crc = {(r.sequence_id, r.offset): r.ids_crc32 for r in queries.packing_digests(pieces).collect()}
    assert all(crc[r.sequence_id, r.offset] == zlib.crc32(r.ids) for r in got)
    full = packing.sequences(pieces, 64).collect()
    assert all(len(r.ids) == 256 for r in full)
    assert sorted(r.n_tokens for r in full)[1:] == [64] * (len(full) - 1)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(docs).count() == 0
