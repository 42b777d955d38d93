"""Files in and out, run tables, statistics edge cases."""

import pytest
from pyspark.sql import functions as F

from tributary.operators import report, stats
from tributary.sources import runs, tables


def test_sorted_csv_and_sample(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}") for i in (5, 3, 9, 1)], "k int, v string").repartition(3)
    tables.write_sorted(df, str(tmp_path / "s"), ["k"])
    lines = [line for f in sorted((tmp_path / "s").glob("part-*")) for line in f.read_text().splitlines() if not line.startswith("k")]
    assert lines == ["1,v1", "3,v3", "5,v5", "9,v9"]
    tables.write_sample(df, str(tmp_path / "small"), [F.col("k")], 2)
    back = tables.read_events(spark, str(tmp_path / "small"), "csv", "k int, v string")
    assert [r["k"] for r in back.orderBy("k").collect()] == [1, 3]
    with pytest.raises(Exception, match="exists"):
        tables.write_sorted(df, str(tmp_path / "s"), ["k"])


def test_folders_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,z\n3,4\n")
    out = tables.read_csv_folders(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ["x int, y int", "y int, z int"])
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 2, None), (None, 3, 4)]


def test_empty_json_is_an_error(spark, tmp_path):
    (tmp_path / "e.json").write_text("")
    with pytest.raises(ValueError, match="no rows"):
        tables.read_json(spark, str(tmp_path / "e.json"), "a int")
    with pytest.raises(Exception):
        tables.read_json(spark, str(tmp_path / "none.json"), "a int")


def test_manifest_is_written_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "u int, split string")
    tables.write_split_manifest(df, str(tmp_path / "m"))
    with pytest.raises(Exception, match="exists"):
        tables.write_split_manifest(df, str(tmp_path / "m"))
    tables.write_run_settings(spark, {"seed": 1, "name": "x"}, str(tmp_path / "r"))
    assert tables.read_json(spark, str(tmp_path / "r"), "seed int, name string").first()["seed"] == 1


@pytest.mark.parametrize("name,want", [("run_always_x", (1.0, 0.0, False)), ("sometimes_randomize", (0.25, 0.25, True)), ("plain", (0.0, 0.0, False))])
def test_old_settings(spark, name, want):
    old = spark.createDataFrame([(["a"], ["b"])], "train array<string>, test array<string>")
    row = tables.complete_settings(old, name).first()
    assert (row["mask_all_pct"], row["mask_each_pct"], row["randomize_order"]) == want and row["saved_name"] == name
    assert sorted(map(tuple, tables.stored_manifest_ids(tables.complete_settings(old, name)).collect())) == [("a", "train"), ("b", "test")]
    many = tables.with_named_masking(spark.createDataFrame([(name, None), (name, 0.7)], "name string, mask_all_pct double"))
    assert [r["mask_all_pct"] for r in many.collect()] == [want[0], 0.7]


def test_metrics_grow_columns(spark, tmp_path):
    path = str(tmp_path / "metrics")
    runs.append_metrics(spark.createDataFrame([(1,)], "a int"), path)
    runs.append_metrics(spark.createDataFrame([(2, "x")], "a int, b string"), path)
    runs.append_json(spark.createDataFrame([(1,)], "a int"), path + "-json")
    runs.append_json(spark.createDataFrame([(2, "x")], "a int, b string"), path + "-json")
    assert sorted(map(tuple, tables.read_json(spark, path + "-json", "a int, b string").collect())) == [(1, None), (2, "x")]
    assert sorted(map(tuple, runs.read_metrics(spark, path).select("a", "b").collect())) == [(1, None), (2, "x")]


def test_latest_results(spark, tmp_path):
    for name, value in [("table-final_bank_x_big-2024-01-01-10-00-eval_stats.csv", 1), ("table-final_bank_x_big-2024-02-01-10-00-eval_stats.csv", 2),
                        ("table-final_bank_x-2023-01-01-10-00-eval_stats.csv", 3), ("table-final_bank_x-2025-01-01-10-00-train_stats.csv", 4),
                        ("notes.csv", 5)]:
        (tmp_path / name).write_text(f"name\tauc\nfinal_bank_x{'_big' if 'big' in name else ''}\t{value}\n")
    out = runs.latest_results(spark, str(tmp_path), "eval")
    assert sorted((r["auc"], r["experiment_name"]) for r in out.collect()) == [("2", "big"), ("3", "Base")]
    assert runs.read_results(spark, str(tmp_path / "notes.csv")).first()["filename"] == "notes.csv"


def test_results_with_different_headers(spark, tmp_path):
    """Columns by name, whatever their place; ragged rows, repeated and quoted names, empty files; other files of the folder stay closed."""
    files = {"a.csv": "x\ty\n1\t2\n3\n4\t5\t6\n", "b.csv": "y\t x \tx\n7\t\"8\t9\"\t0\n", "c.csv": "", "d.csv": "\"z\tz\"\tx\n", "e.csv": "y\nx\ny\n"}
    for name, content in files.items():
        (tmp_path / name).write_text(content)
    out = runs.read_results(spark, str(tmp_path))
    assert out.columns == ["x", "y", "z\tz", "filename"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("1", "2", None, "a.csv"), ("3", None, None, "a.csv"), ("4", "5", None, "a.csv"),
                                                                ("8\t9", "7", None, "b.csv"), (None, "x", None, "e.csv"), (None, "y", None, "e.csv")], key=str)
    few = runs.read_results(spark, str(tmp_path), chosen=spark.createDataFrame([("a.csv",), ("none.csv",)], "filename string"))
    assert few.columns == ["x", "y", "filename"] and few.count() == 3
    with pytest.raises(ValueError, match="no eval results"):
        runs.latest_results(spark, str(tmp_path), "eval")


@pytest.mark.parametrize("listed", [1_000, 0])
def test_chosen_files_are_named_in_the_scan_or_joined(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(runs, "LISTED_FILES", listed)
    rows = spark.createDataFrame([(f"f{i % 3}.csv", i, None if i == 4 else f"v\t{i}") for i in range(9)], "file string, n int, v string")
    runs.write_results(rows, str(tmp_path), "file")
    chosen = spark.createDataFrame([("f0.csv",), ("f1.csv",), ("f1.csv",)], "filename string")
    out = runs.read_results(spark, str(tmp_path), chosen=chosen)
    assert sorted((r.filename, int(r.n), r.v) for r in out.collect()) == sorted((f"f{i % 3}.csv", i, None if i == 4 else f"v\t{i}") for i in range(9) if i % 3 < 2)
    with pytest.raises(FileExistsError):
        runs.write_results(rows, str(tmp_path), "file")


def test_settings_of_many_runs_in_one_scan(spark, tmp_path):
    """Old and new files side by side; ids lie in several lines; a stored share wins over the name; a run may lack a side."""
    rows = [("always_x", i, "test" if i < 3 else "train") for i in range(25)] + [("plain", 7, "train")]
    users = spark.createDataFrame(rows, "run string, u int, split string")
    tables.write_stored_split(users, str(tmp_path / "r"), "u", 4, old_names=True)
    tables.write_stored_split(spark.createDataFrame([("sometimes_y", 1, "test", 0.75)], "run string, u int, split string, mask_all_pct double"), str(tmp_path / "r"), "u")
    found = tables.read_run_settings(spark, str(tmp_path / "r"))
    assert found.where("run = 'always_x'").count() > 3
    assert {(r.run, r.mask_all_pct, r.mask_each_pct, r.randomize_order) for r in found.collect()} == {
        ("always_x", 1.0, 0.0, False), ("plain", 0.0, 0.0, False), ("sometimes_y", 0.75, 0.25, False)}
    ids = tables.stored_manifest_ids(found, ["run"]).collect()
    assert sorted((r.run, int(r["key"]), r.split) for r in ids) == sorted(rows + [("sometimes_y", 1, "test")])


def test_run_file_names(spark):
    names = ["table-a_b_c_d_e-2024-07-07-02-01-eval_stats.csv", "table-a_b_c-2024-07-07-02-01-train_stats.csv", "other.csv",
             "table-a_b_c_d-2024-07-07-02-01-test_stats.csv"]
    df = spark.createDataFrame([(n,) for n in names], "filename string")
    assert [(r["task_name"], r["experiment_name"], r["train_eval"]) for r in report.parse_run_files(df).collect()] == [
        ("a_b_c", "d_e", "eval"), ("a_b_c", "base", "train")]


def test_pivot_refuses_duplicates(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.25)], "i int, c string, m double")
    assert tuple(report.metric_pivot(df, "i", "c", ["a", "b"], "m").first()) == (1, 0.5, 0.25)
    with pytest.raises(Exception, match="pivot cell"):
        report.metric_pivot(df.union(df), "i", "c", ["a", "b"], "m").collect()


def test_summary_drops_null_keys_and_bad_numbers(spark):
    df = spark.createDataFrame([("k", "1.0"), ("k", "bad"), (None, "3.0")], "k string, m string")
    row = report.metric_summary(df, ["k"], ["m"]).collect()
    assert len(row) == 1 and (row[0]["m_mean"], row[0]["m_std"], row[0]["m_count"]) == (1.0, None, 1)


def test_mode_takes_the_smallest_and_one_row_takes_the_table_deviation(spark):
    rows = [(1, 2.0, v) for v in "babac"] + [(2, 5.0, None)]
    df = spark.createDataFrame(rows, "u int, x double, c string")
    got = {r["u"]: r for r in stats.join_entity_stats(df, df, ["u"], "x", {"top": "c"}).collect()}
    assert got[1]["top"] == "a" and got[1]["std_dollar_amt"] == 0.0
    assert got[2]["std_dollar_amt"] == pytest.approx(1.2247448713915892) and got[2]["top"] == "a"


def test_profile_reports_the_deviation_and_distinct_counts(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("b", 3)], "x string, y int")
    assert {r["column"]: r["n_distinct"] for r in stats.distinct_counts(df).collect()} == {"x": 2, "y": 2}
    assert {r["column"]: r["n_distinct"] for r in stats.distinct_counts(df, approximate=True).collect()} == {"x": 2, "y": 2}
    assert [r["column"] for r in stats.binary_violations(df, ["x", "y"]).collect()] == ["y"]


def test_keep_first(spark):
    df = spark.createDataFrame([(1, 3, None), (1, 2, "b"), (2, 1, "c")], "k int, t int, v string")
    assert sorted(map(tuple, report.keep_first(df, ["k"], [F.col("t")]).collect())) == [(1, 2, "b"), (2, 1, "c")]
