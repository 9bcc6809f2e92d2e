"""License scans against every window compared in plain Python."""

import math
import random
import re

import numpy as np

from tallyweave.llm import license_scan as L
from tallyweave.llm import notices, queries

FOLDER = "/root/testdata/sf0.01"


def words_of(text):
    return [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", text)]


def grams(words):
    return [tuple(w.encode() for w, *_ in words[i : i + 3]) for i in range(len(words) - 2)]


def brute(text, templates, least):
    words, matches = words_of(text or ""), []
    for name, template in templates.items():
        wanted = grams(words_of(template))
        for i in range(len(words) - len(wanted) - 1):
            held = set(grams(words[i : i + len(wanted) + 2])) & set(wanted)
            share = len(held) / len(set(wanted))
            if share >= least:
                matches.append((i, len(wanted) + 2, name, share))
    return [
        (words[i][1], words[i + n - 1][2], name, share) for i, n, name, share in L._best(matches)
    ]


def test_equals_brute_force(spark):
    random.seed(5)
    lines = list(L.TEMPLATES.values())
    texts = [None, "", "All rights", "ALL RIGHTS -- RESERVED!", "é漢😀 " + lines[0] + " end", lines[2] * 3]
    for _ in range(80):
        picked = [random.choice(lines).split() for _ in range(random.randrange(4))]
        for line in picked:
            if random.random() < 0.5:
                line[random.randrange(len(line))] = "other"
        filler = [random.choice(["the", "License", "under", "x é", "rights"]) for _ in range(30)]
        parts = [" ".join(p) for p in picked] + [" ".join(filler)]
        random.shuffle(parts)
        texts.append("\n".join(parts))
    rows = [*enumerate(texts), (None, lines[1]), (3, lines[1]), (999, "word " * 300_000 + lines[3])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    df = df.selectExpr("*", "1 as matches", "2 as license")
    got = [(r.doc_id, [tuple(m) for m in r.matches]) for r in L.scan(df, least=0.6).collect()]
    want = [(i, brute(t, L.TEMPLATES, 0.6)) for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_given_documents(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: [tuple(m) for m in r.matches] for r in L.scan(df).collect()}
    assert got == {i: brute(t, L.TEMPLATES, L.LEAST) for i, t in texts.items()}
    assert sum(map(bool, got.values())) > 20


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def fullest(text, template, least):
    """The largest share of the template in any span of up to its length over ``least``."""
    wanted, held = grams(words_of(template)), grams(words_of(text))
    reach = math.ceil(len(wanted) / least)
    return max(
        (len(set(held[i : i + reach]) & set(wanted)) / len(set(wanted)) for i in range(len(held))),
        default=0,
    )


def test_inserted_and_missing_words(spark):
    random.seed(8)
    long = " ".join(f"term{i}" for i in range(40))
    templates = {**L.TEMPLATES, "long": long}
    gpl = L.TEMPLATES["GPL-3.0"].replace("GNU", "well known GNU")
    texts = [gpl, "before " + gpl + " after", "Licensed under the Apache License, Version 2"]
    for _ in range(150):
        words = random.choice(list(templates.values())).split()
        for _ in range(random.randrange(4)):
            words.insert(random.randrange(len(words) + 1), random.choice(["Jane", "2020", "x y z"]))
        low = random.randrange(3)
        texts.append("start " * random.randrange(3) + " ".join(words[low : len(words) - random.randrange(3)]))
    df = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: {m.license: m.containment for m in r.matches} for r in L.scan(df, templates).collect()}
    for i, text in enumerate(texts):
        shares = {name: fullest(text, template, L.LEAST) for name, template in templates.items()}
        assert got[i] == {name: share for name, share in shares.items() if share >= L.LEAST}, text
    assert got[0].keys() == got[1].keys() == {"GPL-3.0"} and got[2].keys() == {"Apache-2.0"}


def test_the_query_finds_real_notices(spark, tmp_path):
    rows = [
        (name, f"/* {chr(10).join(text.split())} */ code follows")
        for name, texts in notices.NOTICES.items()
        for text in texts
    ]
    mit = notices.NOTICES["MIT"][0].replace("the Software is", "the Example Software is")
    rows += [("MIT", "Copyright 2020 Jane Doe " + mit), ("", "Permission is granted to walk the dog.")]
    df = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.licenses for r in queries.op7_licenses(spark, str(tmp_path)).collect()}
    assert got == {i: name for i, (name, _) in enumerate(rows)}


def test_the_query_finds_the_given_lines(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    lines = {r.doc_id: {m.license for m in r.matches} for r in L.scan(df).collect()}
    got = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in queries.op7_licenses(spark, FOLDER).collect()}
    assert all(names <= got[i] for i, names in lines.items())


def test_bands_reach_the_stated_probability():
    prepared = L._prepared(notices.NOTICES, L.LEAST)
    classes = L._classes(prepared, L.MISS)
    assert sorted(i for c in classes for i in c.members) == [*range(len(prepared))]
    for c in classes:
        length = c.stride * c.blocks
        for t in (prepared[i] for i in c.members):
            assert length >= t.reach + c.stride - 1
            assert t.need / (len(t.shingles) + length - t.need) >= c.similarity
        assert (1 - c.similarity**L.BAND_ROWS) ** len(c.keys) <= L.MISS


def test_bands_retrieve_what_barely_matches_and_little_else():
    random = np.random.default_rng(3)
    prepared = L._prepared({"long": " ".join(f"term{i}" for i in range(90)), **L.TEMPLATES}, L.LEAST)
    classes = L._classes(prepared, L.MISS)
    tried = 0
    for i, t in enumerate(prepared):
        found = random.integers(0, 1 << 64, 300_000, np.uint64)
        begins = np.arange(500, 299_000, 700) + random.integers(0, 64, 427)
        for begin in begins:
            held = random.permutation(t.shingles)[: t.need]
            found[begin + np.sort(random.permutation(t.reach)[: t.need])] = held
        retrieved, length = L._retrieved(found, classes), {j: c.stride * c.blocks for c in classes for j in c.members}
        near = L._around(retrieved[i], length[i], len(found))
        assert np.isin(begins + t.reach // 2, near).all()
        assert len(near) < 427 * 5 * length[i]
        assert not any(len(v) > 20 for j, v in retrieved.items() if j != i and prepared[j].size > 3)
        tried += len(begins)
    assert tried == 427 * 6
