"""Token counts against the vocabulary's own library."""

import random

import public_tokenizers
import pytest
import sentencepiece

from tallyweave.llm import queries
from tallyweave.llm import token_counts as T

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def counter():
    return T.Counter(PATH)


def check(counter, library, texts):
    assert counter.counts(texts) == [len(library.encode(text)) for text in texts]


ALPHABETS = [
    "abcdefgh ", "the of and ing tion 123 ", "ACGT", "a", "ﬀ①é́ß中文字日本😀\x00\n\t▁ x", "aeiou▁ nrst", "<s></s><0x41> ",
]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_random_texts(counter, library, alphabet):
    choose = random.Random(alphabet)
    texts = ["".join(choose.choices(alphabet, k=choose.randrange(60))) for _ in range(1000)]
    check(counter, library, texts)


def test_texts_of_random_pieces(counter, library):
    choose = random.Random(2)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    check(counter, library, ["".join(choose.choices(pieces, k=choose.randrange(30))) for _ in range(4000)])


def test_runs_of_spaces(counter, library):
    check(counter, library, [" " * n + end for n in [*range(70), 129, 1000] for end in ("", "x", ".")])


def test_very_long_words(counter, library, monkeypatch):
    monkeypatch.setattr(T, "AT_ONCE", 500)
    choose = random.Random(3)
    words = ["a" * 20_000, "中文" * 3000, "".join(choose.choices("abcdefghijklmnop", k=20_000))]
    check(counter, library, [*words, " ".join(words), "  ".join(words) + "   "])


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 3)
    counter = T.Counter(PATH)
    for n in range(5):
        check(counter, library, [f"one two three {n}", "two three", "four " * n])


def test_rows(spark, library):
    rows = [(1, ""), (None, "no id"), (3, None), (4, "twice"), (4, "twice"), (5, "é" * 5000), (6, " ")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, T.count_tokens(frame).collect()), key=repr)
    want = []
    for i, text in rows:
        n = len(library.encode(text or ""))
        want.append((i, len((text or "").encode()), n, n > 4096))
    assert got == sorted(want, key=repr)
    assert any(row[3] for row in got)
    assert T.count_tokens(frame.limit(0)).count() == 0
    over = T.count_tokens(frame, limit=1).where("over_limit").count()
    assert over == sum(n > 1 for _, _, n, _ in want)


def test_query_counts_every_document(spark, library):
    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in queries.op13_token_counts(spark, folder).collect()}
    assert got == {d.doc_id: (len(d.text.encode()), len(library.encode(d.text))) for d in documents}
