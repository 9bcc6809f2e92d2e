"""The pipeline stage by stage against plain Python, and on odd tables."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from test_ngram_join import brute
from test_secret_scan import expected_base, expected_entropy
from tallyweave.llm import quality, secret_scan, toxicity

FOLDER = "/root/testdata/sf0.01"


def frame(df):
    return df.toPandas().sort_values("doc_id", ignore_index=True)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_filters_apply_their_scores(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = toxicity.fit(documents, labels)
    before = frame(documents)
    want = before[[model.score_text(t) < P.TOXIC for t in before.text]].reset_index(drop=True)
    kept = P.drop_toxic(spark, documents, FOLDER)
    assert frame(kept).equals(want) and 0.8 < len(want) / len(before) < 1
    good = quality.fit(documents, labels)
    scored = documents.select("*", good.score(F.col("text")).alias("_score")).toPandas()
    want = scored[scored._score >= P.GOOD].drop(columns="_score")
    assert frame(P.drop_poor(spark, documents, FOLDER)).equals(frame_of(want))


def frame_of(pandas):
    return pandas.sort_values("doc_id", ignore_index=True)


def test_one_of_each_group_stays(spark, documents):
    before = frame(documents)
    groups = brute(list(zip(before.doc_id.tolist(), before.text, strict=True)), 5, 80)
    first = {d for d, _, component in groups if d == component}
    kept = frame(P.drop_near_copies(spark, documents, FOLDER))
    assert kept.equals(before[before.doc_id.isin(first)].reset_index(drop=True))
    assert len(kept) < len(before)


def test_secrets_are_masked(spark, documents):
    before, after = frame(documents), frame(P.mask_secrets(spark, documents, FOLDER))
    assert list(after.columns) == list(before.columns)
    changed = 0
    for old, new, n in zip(before.text, after.text, after.n_chars, strict=True):
        base = expected_base(old)
        spans = base + expected_entropy(old, base, secret_scan.EntropyRules())
        made, at = "", 0
        for start, end, _ in sorted(spans):
            if start >= at:
                made += old[at:start] + "[SECRET]"
            at = max(at, end)
        assert new == made + old[at:]
        assert n == len(new)
        changed += bool(spans)
    assert changed > 5


def test_the_whole_run_packs_what_is_left(spark):
    pieces = P.run(spark, FOLDER).orderBy("sequence_id", "offset").collect()
    assert [r.sequence_id * 1024 + r.offset for r in pieces] == np.r_[
        0, np.cumsum([r.length for r in pieces])[:-1]
    ].tolist()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in pieces)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for r in sorted(pieces, key=lambda r: r.start):
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert 0.5 < len(ids) / len(texts) < 0.95
    for doc_id, found in ids.items():
        assert found[-1] == 0
        text = tokenizer.decode(found[:-1])
        if "[SECRET]" not in text:
            assert text == texts[doc_id]
        assert not re.search("password=[a-z0-9]{8}", text)


def test_odd_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (3, None), (None, ""),
            (1, "another text under the same id"), (4, None), (5, "x" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs = docs.selectExpr("*", "1 as score", "2 as row", "3 as own", "4 as spans", "5 as n_chars")
    for stage in (P.drop_toxic, P.drop_poor, P.mask_secrets):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == len(rows)
    out = P.drop_near_copies(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    want = [rows[0], *rows[3:]]
    assert left == sorted(want, key=repr)
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
