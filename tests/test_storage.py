import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import types as T

from tallyweave.functions.levels import OUTCOME_TYPE
from tallyweave.operators.fuzzy import best_edit_matches
from tallyweave.runtime import cut, release, scratch_dir
from tallyweave.sources import readers as R
from tallyweave.sources import writers as W


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([("a, b", 1), (None, 2)], "t string, n int")
    W.write_csv(rows, str(tmp_path / "x"))
    W.write_csv(rows, str(tmp_path / "x"))
    back = R.read_csv(spark, str(tmp_path / "x"), rows.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_bad_csv_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "x.csv").write_text("t,n\na,1\nb,two\n")
    schema = R.with_corrupt_column(T.StructType().add("t", T.StringType()).add("n", T.IntegerType()))
    good, bad = R.split_rejects(R.read_csv(spark, str(tmp_path / "x.csv"), schema).cache())
    assert [tuple(r) for r in good.collect()] == [("a", 1)]
    assert [r[0] for r in bad.collect()] == ["b,two"]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("b,a\nvb,1\n")
    (tmp_path / "b.csv").write_text("\nA,c,B,b\n2,x,3,4\n")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d e.csv").write_text("c\nonly\n")
    out = R.read_csv(spark, str(tmp_path), "a int, b string")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "vb"), (2, None), (None, None)], key=repr)
    assert out.dtypes == [("a", "int"), ("b", "string")]
    one = R.read_csv(spark, str(tmp_path / "a.csv"), "a string, b string")
    assert [tuple(r) for r in one.collect()] == [("1", "vb")]
    none = R.read_csv(spark, str(tmp_path / "c.csv"), "a string")
    assert none.columns == ["a"] and none.count() == 0


def test_bad_lines_of_files_with_turned_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,t\n1,a\ntwo,b\n")
    (tmp_path / "b.csv").write_text("t,more,n\nc,x,3\nd,y,four\n")
    schema = R.with_corrupt_column(T.StructType().add("t", T.StringType()).add("n", T.IntegerType()))
    good, bad = R.split_rejects(R.read_csv(spark, str(tmp_path), schema).cache())
    assert sorted(tuple(r) for r in good.collect()) == [("a", 1), ("c", 3)]
    assert sorted(r[0] for r in bad.collect()) == ["d,y,four", "two,b"]


def test_headers_take_as_many_jobs_for_many_files(spark, tmp_path):
    def jobs(n):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            names = "Name,a" if i % 2 else "b,Full Name"
            (folder / f"f_{i}.csv").write_text(f"{names}\n{i},{i}\n" if i else "")
        spark.sparkContext.setJobGroup(f"files-{n}", "")
        try:
            groups, rejects = R.read_folder(spark, str(folder), ".csv", "csv")
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert [r[1] for r in rejects] == [R.NO_COLUMNS]
        assert sorted(len(g.paths) for g in groups) == sorted([n // 2, (n - 1) // 2])
        assert sum(g.rows.count() for g in groups) == n - 1
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"files-{n}"))

    # above 32 paths Spark lists folders in a job of its own
    assert jobs(2000) == jobs(200)


def test_json_object_and_array(spark, tmp_path):
    one = {"researcher": "r", "data": {"level1_ip": [{"title": "t", "filing_year": 2001}]}}
    (tmp_path / "one.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "many.json").write_text(json.dumps([one, one], indent=2))
    out = R.read_json(spark, str(tmp_path), f"researcher string, data {OUTCOME_TYPE}", lines=False)
    assert [r.data.level1_ip[0].filing_year for r in out.collect()] == [2001] * 3


def test_json_per_person(spark, tmp_path):
    rows = spark.createDataFrame([("Doe, Jane", 1), ("Doe, Jane", 2), ("Bo", 3)], "name string, n int")
    W.write_json_per_person(rows, str(tmp_path / "x"), "name")
    assert {p.name for p in (tmp_path / "x").iterdir() if p.is_dir()} == {"slug=Doe_Jane", "slug=Bo"}
    back = R.read_json(spark, str(tmp_path / "x"), "name string, n int, slug string")
    assert sorted(r.n for r in back.collect()) == [1, 2, 3]
    W.write_json(rows, str(tmp_path / "all"))
    assert R.read_json(spark, str(tmp_path / "all"), rows.schema).count() == 3


def test_tables(spark):
    W.write_table(spark.range(3), "tw_saved_one")
    W.write_table(spark.range(4), "tw_saved_one")
    assert "tw_saved_one" in R.find_tables(spark, "saved", "default")
    assert R.read_table(spark, "tw_saved_one", "default").count() == 4


def test_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    W.write_run(spark.range(3), path, "20240101_000000")
    # reads the table it replaces
    W.write_run(W.read_latest_run(spark, path).limit(2), path, "20240102_000000")
    assert W.read_latest_run(spark, path).count() == 2
    wider = spark.range(3).selectExpr("id", "id * 2 as extra")
    W.write_run(wider, path, "20240103_000000")
    assert W.read_latest_run(spark, path).columns == ["id", "extra"]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no finished run"):
        W.read_latest_run(spark, str(tmp_path / "none"))
    assert W.run_stamp(datetime(2024, 5, 6, 7, 8, 9)) == "20240506_070809"
    W.write_parquet(spark.range(2), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_unfinished_runs_are_not_read(spark, tmp_path):
    path = str(tmp_path / "runs")
    W.write_run(spark.range(3), path, "1")
    # a run that only holds temporary files, one that stopped half way, and one that fails
    (tmp_path / "runs" / "run_id=2" / "_temporary" / "0").mkdir(parents=True)
    spark.range(5).write.parquet(f"{path}/run_id=0")
    failing = spark.range(4).selectExpr("id", "raise_error('stop') as extra")
    with pytest.raises(Exception, match="stop"):
        W.write_run(failing, path, "3")
    assert W.read_latest_run(spark, path).count() == 3
    assert [r.run_id for r in W.committed_runs(spark, path).collect()] == ["1"]
    # the finished runs are still one table, whose scan passes the log by
    assert spark.read.parquet(f"{path}/run_id=1").count() == 3
    assert W.drop_unfinished_runs(spark, path) == ["0"]
    assert not (tmp_path / "runs" / "run_id=0").exists() and (tmp_path / "runs" / "run_id=2").exists()
    W.write_run(spark.range(0), path, "4")
    assert W.read_latest_run(spark, path).count() == 0
    assert W.read_latest_run(spark, path).columns == ["id"]


def test_cut_uses_the_shared_folder(spark):
    rows = cut(spark.range(5), "five")
    assert rows.count() == 5
    assert all(scratch_dir(spark) in f for f in rows.inputFiles())


class Cluster:
    named = None

    class conf:
        get = staticmethod(lambda key, default=None: Cluster.named)

    class sparkContext:
        master = "yarn"


@pytest.mark.parametrize("named", [None, "file:/tmp/x", "file:///tmp/x"])
def test_a_cluster_needs_a_shared_folder(named, monkeypatch):
    monkeypatch.setattr(Cluster, "named", named)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Cluster)
    monkeypatch.setattr(Cluster, "named", "hdfs://store/scratch/")
    assert scratch_dir(Cluster) == "hdfs://store/scratch"


def test_a_finished_job_leaves_nothing_once_released(spark):
    release(spark)
    folder = Path(scratch_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    titles = spark.createDataFrame([("gene therapy one",)], "title string")
    grants = spark.createDataFrame([(1, "gene therapy two")], "grant_id int, title string")
    assert best_edit_matches(titles, grants).count() == 1
    assert set(folder.iterdir()) > before
    assert release(spark) > 0 and set(folder.iterdir()) == before
