import pytest
from pyspark.sql import functions as F

from tallyweave import columns as C
from tallyweave.operators import schema as S
from tallyweave.plans.combine import combine_frames, combine_sources, combine_tables, stack_folder


def frame(spark, *columns):
    return spark.createDataFrame([tuple("v" for _ in columns)], list(columns))


def test_name_column(spark):
    first, second = C.NAME_CANDIDATES
    assert S.name_column(frame(spark, "surname", second, first)) == first
    assert S.name_column(frame(spark, "x", "Nominee", "name")) == "Nominee"
    assert S.name_column(frame(spark, "x", "y")) is None


def test_title_column(spark):
    assert S.title_column(frame(spark, "a", "Titre", "title")) == "Titre"
    assert S.title_column(frame(spark, "title", C.TITLE_COLUMN)) == C.TITLE_COLUMN


def test_targets_in_any_case(spark):
    rows = frame(spark, C.PRIMARY.upper(), "other").select(
        *S.select_targets(frame(spark, C.PRIMARY.upper(), "other"), C.NAME_ENRICHMENT)
    )
    assert rows.columns == [C.PRIMARY]


def test_required_columns(spark):
    assert S.missing_columns(frame(spark, "a"), ["a", "b"]) == ["b"]
    with pytest.raises(ValueError, match="missing"):
        S.require_columns(frame(spark, "a"), ["b"])


def test_available_enrichment(spark):
    assert S.available_enrichment(frame(spark, C.PRIMARY), C.TITLE_ENRICHMENT) == {
        C.PRIMARY: "Primary_Institute"
    }
    with pytest.raises(ValueError, match="none of"):
        S.available_enrichment(frame(spark, "a"), C.TITLE_ENRICHMENT)


def test_stack_fills_and_turns_mixed_types_to_text(spark):
    a = spark.createDataFrame([(1, "x")], "k int, only_a string")
    b = spark.createDataFrame([("one",)], "k string")
    c = spark.createDataFrame([(2.5,)], "k double")
    out = S.stack([a, b, c])
    assert sorted((r.k, r.only_a) for r in out.collect()) == [("1", "x"), ("2.5", None), ("one", None)]
    assert S.stack([]) is None


def test_stack_takes_letter_case_as_drift(spark):
    a = spark.createDataFrame([(1, "x")], "amount int, name string")
    b = spark.createDataFrame([("many", "y")], "Amount string, NAME string")
    out = S.stack([a, b])
    assert out.columns == ["amount", "name"]
    assert sorted(map(tuple, out.collect())) == [("1", "x"), ("many", "y")]


def test_odd_column_names(spark):
    odd = spark.createDataFrame([(" A ", 1)], ["full.name", "Primary`x"])
    out = S.align_by_name(odd, F.lit("y"), ["primary`X"]).collect()
    assert [tuple(r) for r in out] == [("a", "y", "1")]


def test_combine_frames(spark):
    frames = {
        "grants_2010_11": spark.createDataFrame([(" Ann ", 7)], [C.NAME_CANDIDATES[1], C.PRIMARY]),
        "grants_2011_12": spark.createDataFrame([("Bo", "w")], ["prenom", C.KEYWORDS.lower()]),
        "codes": spark.createDataFrame([(1,)], ["code"]),
    }
    rows, rejects = combine_frames(spark, frames)
    got = sorted(
        (r.clean_name, r.fiscal_year, r[C.PRIMARY], r[C.KEYWORDS]) for r in rows.collect()
    )
    assert got == [("ann", "2010-11", "7", None), ("bo", "2011-12", None, "w")]
    assert [tuple(r) for r in rejects.collect()] == [("codes", "no name column")]


def test_combine_folder(spark, tmp_path):
    (tmp_path / "grants_201011.csv").write_text(f"{C.NAME_CANDIDATES[0]},{C.PRIMARY}\nAnn,p\n")
    (tmp_path / "grants_201112.csv").write_text("Nominee,x\nBo,1\n")
    (tmp_path / "grants_201213.csv").write_text("x,y\n1,2\n")
    (tmp_path / "grants_201314.csv").write_text("")
    (tmp_path / "notes.txt").write_text("name\nno\n")
    rows, rejects = combine_sources(spark, str(tmp_path))
    got = sorted((r.clean_name, r.fiscal_year, r[C.PRIMARY], r.Source_File) for r in rows.collect())
    assert got == [
        ("ann", "2010-11", "p", "grants_201011.csv"),
        ("bo", "2011-12", None, "grants_201112.csv"),
    ]
    assert sorted((r.source.rsplit("/", 1)[-1], r.reason) for r in rejects.collect()) == [
        ("grants_201213.csv", "no name column"),
        ("grants_201314.csv", "no columns"),
    ]
    stacked = stack_folder(spark, str(tmp_path)).rows
    assert stacked.count() == 3
    assert set(stacked.columns) >= {"Source_File", "Nominee", "x", "y", C.PRIMARY}


def test_unreadable_file_is_reported(spark, tmp_path):
    spark.createDataFrame([("a",)], ["name"]).coalesce(1).write.parquet(str(tmp_path / "t"))
    (tmp_path / "bad.parquet").write_bytes(b"no parquet at all")
    rows, rejects = combine_sources(spark, str(tmp_path), ".parquet", "parquet")
    assert rows is None
    found = rejects.collect()
    assert [r.source.rsplit("/", 1)[-1] for r in found] == ["bad.parquet"]
    assert found[0].reason.startswith("unreadable")


def test_combine_tables(spark):
    frame(spark, "name").createOrReplaceTempView("zz_grants_2001_02")
    frame(spark, "name").createOrReplaceTempView("zz_other")
    rows, rejects = combine_tables(spark, "zz_grants")
    assert [(r.clean_name, r.fiscal_year) for r in rows.collect()] == [("v", "2001-02")]
    assert rejects.count() == 0
    assert combine_tables(spark, "no_such_table").rows is None


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_tables_of_several_files_in_a_folder(spark, tmp_path, kind):
    def write(name, values, columns):
        frame = spark.createDataFrame(values, columns).repartition(3)
        frame.write.option("header", True).format(kind).save(str(tmp_path / name))

    write(f"g_201011.{kind}", [("Ann", 1), ("Bo", 2), ("Cy", 3)], "name string, doc_id int")
    write(f"other.{kind}", [(1,), (2,)], "number int")
    write("not_a_table", [("Di", 4)], "name string, doc_id int")
    stacked = stack_folder(spark, str(tmp_path), f".{kind}", kind).rows
    assert {r.Source_File: r["count"] for r in stacked.groupBy("Source_File").count().collect()} == {
        f"g_201011.{kind}": 3,
        f"other.{kind}": 2,
    }
    assert {int(r.doc_id) for r in stacked.where("doc_id is not null").collect()} == {1, 2, 3}
    rows, rejects = combine_sources(spark, str(tmp_path), f".{kind}", kind, ["doc_id"])
    assert {(r.clean_name, r.fiscal_year) for r in rows.collect()} == {
        (name, "2010-11") for name in ("ann", "bo", "cy")
    }
    assert {r.reason for r in rejects.collect()} == {"no name column"}
