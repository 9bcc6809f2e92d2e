"""Alignment of two tokenizers against all pairs of tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyweave.llm import alignment as A
from tallyweave.llm import queries
from tallyweave.llm.bytebpe import token_table

PATH_A = public_tokenizers.path("byte_bpe_50k.json")
PATH_B = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def brute():
    a_library = Tokenizer.from_file(PATH_A)
    a_library.encode_special_tokens = True
    b_library = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    bytes_a = token_table(PATH_A)
    pieces = [b_library.id_to_piece(i) for i in range(b_library.get_piece_size())]

    def bytes_b(i):
        return bytes([int(pieces[i][3:-1], 16)]) if b_library.is_byte(i) else pieces[i].replace("▁", " ").encode()

    def spans(tokens):
        at = 0
        for token in tokens:
            yield at, at + len(token)
            at += len(token)

    def run(text):
        """Counts, digest and links of one text."""
        nothing = (0, 0, 0, 0, "", {})
        if not text:
            return nothing
        given = (" " + text).encode()
        a, b = a_library.encode(" " + text, add_special_tokens=False).ids, b_library.encode(text)
        in_a, in_b = [bytes_a[i] for i in a], [bytes_b(i) for i in b]
        if b"".join(in_a) != given or b"".join(in_b) != given:
            return nothing
        in_a, in_b = list(spans(in_a)), list(spans(in_b))
        links = Counter(
            (a[i], b[j]) for i, (s, e) in enumerate(in_a) for j, (t, f) in enumerate(in_b) if s < f and t < e
        )
        groups, begin = [], 0
        for end in sorted({e for _, e in in_a} & {e for _, e in in_b}):
            sides = (
                ",".join(str(ids[i]) for i, (s, _) in enumerate(of) if begin <= s < end)
                for ids, of in ((a, in_a), (b, in_b))
            )
            groups.append("|".join(sides))
            begin = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        return len(a), len(b), len(groups), sum(links.values()), digest, dict(links)

    return run


def aligned(spark, texts, **options):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = A.align(frame, **options).orderBy("doc_id").collect()
    return [
        (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, dict(zip(zip(r.a, r.b), r.times)))
        for r in rows
    ]


def test_gallop_is_a_search():
    random_ = np.random.default_rng(1)
    for n, m in [(0, 0), (0, 5), (5, 0), (1, 1), (3, 1000), (1000, 3), (500, 500)]:
        short, long = (np.unique(random_.integers(0, 2000, k)) for k in (n, m))
        assert A.gallop(short, long).tolist() == np.searchsorted(long, short).tolist()
    clustered = np.append(np.arange(900), 10**6)
    assert A.gallop(np.array([0, 899, 900, 10**6]), clustered).tolist() == [0, 899, 900, 900]


ALPHABETS = [
    "abcdefgh  ", "the of and ing tion 123 ", "ﬀ①é́ß中文字日本😀\x00\n\t x", "<|endoftext|> </s>\n", " \n", "▁a ",
]


@pytest.mark.parametrize(("size", "at_once"), [(1 << 17, 1 << 17), (5, 50), (20, 7)])
def test_random_texts(spark, brute, size, at_once):
    choose = random.Random(4)
    texts = ["".join(choose.choices(a, k=choose.randrange(80))) for a in ALPHABETS for _ in range(60)]
    assert aligned(spark, texts, size=size, at_once=at_once) == [brute(text) for text in texts]


def test_slices_join_to_the_text():
    for text in ["a", " ", "a  b   c", "ab cd ef gh  ", " x" * 50, "x" * 50]:
        for size in (1, 3, 8, 100):
            parts = list(A.slices(text, size))
            assert "".join(parts) == " " + text
            assert all(part[0] == " " and part != " " or text == "" for part in parts[1:])


def test_rows(spark, brute):
    texts = [(1, ""), (None, "no id"), (3, None), (4, "again and again"), (4, "again and again"), (6, "a▁b")]
    texts.append((7, "antidisestablishmentarianism " * 3000))
    frame = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, n_a int")
    rows = A.align(frame).collect()
    got = sorted(((r.doc_id, r.n_a, r.n_links, r.groups_sha256) for r in rows), key=repr)
    made = [brute(t) if i != 7 else None for i, t in texts]
    want = [(i, m[0], m[3], m[4]) for (i, _), m in zip(texts, made) if m]
    assert [r for r in got if r[0] != 7] == sorted(want, key=repr)
    once = brute("antidisestablishmentarianism")
    assert [r[1:3] for r in got if r[0] == 7][0][1] >= once[3] * 3000
    none = A.align(frame.limit(0))
    assert A.weigh(none, A.link_counts(none)).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_counts_of_all_texts(spark, brute, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr("tallyweave.llm.common.BROADCAST_BYTES", 0)
    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    short = [d for d in documents if len(d.text) < 1500][:60]
    frame = spark.createDataFrame(short, "doc_id long, text string")
    every = A.align(frame)
    got = {r.doc_id: (r.n_best, r.count_sum) for r in A.weigh(every, A.link_counts(every)).collect()}
    links = {d.doc_id: brute(d.text)[5] for d in short}
    held = Counter(pair for of in links.values() for pair in of)
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    assert got == {
        i: (sum(n for p, n in of.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in of.items()))
        for i, of in links.items()
    }


def test_query_gives_a_row_per_document(spark):
    folder = "/root/testdata/sf0.001"
    rows = queries.op12_alignment(spark, folder)
    assert rows.columns == [
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum",
    ]
    assert rows.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
