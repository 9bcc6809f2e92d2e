"""URL parts and stated rules against plain Python; mined rules on planted tokens."""

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import url_filter as U

URLS = [
    "https://www.Example.NET/en/12?x=1#top", "http://example.net/de/1", "https://a.net", "x.net/",
    "ftp://example.com/de/5", "ftp://EXAMPLE.com/DE/5", "http://badexample.com/de/", "", None,
    "http://a.org/fr/", "http://org/fr/x", "http://a.org/fr", "http://net?/en/", "a://b://c.net/",
    "http://İ.net/", "://net/", "http://h#/de/", "http://example.com/de/?q\nz", "http://notnet/",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    end = min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))
    return host, rest[cut:end]


def stated(host, path):
    fits = [
        r for r in U.STATED
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_stated_rules(spark):
    rows = [*enumerate(URLS), (None, URLS[0]), (1, URLS[1])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    pages = pages.selectExpr("*", "'x' as host", "'y' as tokens", "1 as rule")
    got = sorted(map(tuple, U.judge(pages, U.MinedRules({})).collect()), key=repr)
    want = []
    for page_id, url in rows:
        host, path = parts(url)
        rule = stated(host, path)
        want.append(
            (page_id, host, path, rule and rule.name, rule.verdict if rule else "allow")
        )
    assert got == sorted(want, key=repr)


def test_tokens(spark):
    df = spark.createDataFrame([("http://A.b.com/en/12/x.html?p=2&q=Z#Top3",), (None,)], "u string")
    first, second = [r[0] for r in df.select(U.tokens_of(F.col("u"))).collect()]
    assert first == [
        "host:a", "host:b", "host:com", "path:en", "path:#", "path:x", "path:html",
        "query:p=#", "query:q=z", "fragment:top#",
    ]
    assert second == []


def test_rules_are_pruned_and_filed():
    a, b, c = "a", "b", "c"
    rules = [
        (frozenset([a]), 0.8), (frozenset([a, b]), 0.8), (frozenset([a, c]), 0.9),
        (frozenset([b, c]), 0.7),
    ]
    kept = {rule for filed in U.file_rules(rules, 10).index.values() for rule in filed}
    assert kept == {frozenset([a]), frozenset([a, c]), frozenset([b, c])}
    assert sum(map(len, U.file_rules(rules, 1).index.values())) == 1


@pytest.fixture(scope="module")
def planted(spark):
    rows = []
    for i in range(400):
        bad = i % 8 == 0
        rows.append((i, f"https://{'spam' if bad else 'fine'}.example.de/{'win' if bad else 'x'}/{i}"))
    rows.append((900, "https://spam.example.de/calm/7"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame(
        [(i, int(i % 8 != 0), int(i % 16 == 0)) for i in range(0, 400)] + [(None, 0, 1), (5, None, None)],
        "doc_id bigint, quality int, toxic int",
    )
    return pages, labels


def test_mined_rules(planted):
    pages, labels = planted
    mined = U.mine(pages, labels)
    assert mined.index
    got = {r.page_id: r.verdict for r in U.judge(pages, mined).collect()}
    assert all((got[i] == "block") == (i % 8 == 0) for i in range(400))
    assert got[900] == "block"


def test_every_mined_rule_counts(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    hosts = [f"q{a}{b}z" for a in letters for b in letters]  # 676
    rows = [(i, f"https://{hosts[i % 676]}.é.de/{i}") for i in range(2028)]
    rows += [(i, f"https://fine.é.de/{i}") for i in range(2028, 6000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame(
        [(i, int(i >= 2028), 0) for i, _ in rows], "doc_id bigint, quality int, toxic int"
    )
    mined = U.mine(pages, labels, least_support=0.0004)
    assert {r for filed in mined.index.values() for r in filed} == {
        frozenset([f"host:{h}"]) for h in hosts
    }
    got = {r.page_id: r.verdict for r in U.judge(pages, mined).collect()}
    assert got == {i: "block" if i < 2028 else "allow" for i, _ in rows}


def test_empty_tables(planted):
    pages, labels = planted
    assert U.mine(pages.limit(0), labels).index == {}
    assert U.mine(pages, labels.limit(0)).index == {}
    assert U.judge(pages.limit(0), U.MinedRules({})).count() == 0
