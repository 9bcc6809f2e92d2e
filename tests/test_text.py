import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.functions import text as X


def python_loose(title):
    title = re.sub(r"[^a-zA-Z0-9\s]", "", title.lower())
    return re.sub(r"\s+", " ", title).strip()


def test_clean_name(apply):
    assert apply(X.clean_name, ["  Ann LEE ", None, ""]) == ["ann lee", None, ""]


def test_title_forms(apply):
    rows = [" (A) - b - ", "Éa\tB  c", "a b", "...", None, ""]
    assert apply(X.strict_title, rows) == ["a b ", "a b c", "ab", "", None, ""]
    assert apply(X.loose_title, rows) == ["a b", "a b c", "a b", "", None, ""]


def test_loose_title_like_python(apply):
    everything = "".join(map(chr, [*range(1, 0x3100)]))
    rows = [everything[i : i + 40] for i in range(0, len(everything), 40)]
    assert apply(X.loose_title, rows) == [python_loose(r) for r in rows]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"], min_codepoint=1)), min_size=1))
def test_loose_title_is_idempotent(apply, rows):
    once = apply(X.loose_title, rows)
    assert apply(X.loose_title, once) == once == [python_loose(r) for r in rows]


def test_usable_keys(apply):
    assert apply(X.usable_keys, ["x", " ", "", None]) == [["x"], [], [], []]


def test_words(apply):
    assert apply(lambda a: X.words(a, 3), ["the gene gates a pathway"]) == [["gene", "gates", "pathway"]]


@pytest.mark.parametrize(
    "a, b, distance",
    [("abc", "abc", 0), ("abc", "abd", 1), ("a", "a" * 11, 10), ("a", "a" * 12, 999), (None, "a", None)],
)
def test_edit_distance(apply, a, b, distance):
    assert apply(X.edit_distance, [(a, b)], "a string, b string") == [distance]


def test_competition_codes(apply):
    codes = ["201709PJT", "20AB09", "2017", None, "201799X", "20.509X", "198701"]
    dates = ["2017-09", "2017-09", "2017-09", "2017-09", "2017-99", "2017-09", "1987-01"]
    assert apply(X.grant_date, codes) == dates
    assert tuple(apply(X.code_year_month, ["20AB01"])[0]) == (2017, 9)


def test_fiscal_years(apply):
    files = ["grants_x_201011.csv", "a_200001.tar.csv", "plain.csv"]
    assert apply(X.fiscal_year_of_file, files) == ["2010-11", "2000-01", "Unknown"]
    tables = ["grants_2010_11", "grants_201011", "grants", "a_1b_2"]
    assert apply(X.fiscal_year_of_table, tables) == ["2010-11", "201011", "Unknown", "2"]


def test_slug_and_record_id(apply):
    assert apply(X.file_slug, ["Doe, Jane Q"]) == ["Doe_Jane_Q"]
    out = apply(X.record_id, [("n", "t"), (None, "t"), ("n", None)], "a string, b string")
    assert out == ["n_t", "nan_t", "n_nan"]
