"""Sources, single-file reports and the posts that a service starts with."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics, startup
from tessera.sources import scans, sinks


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_nested_tree_is_one_pool(spark):
    got = scans.scan_nested(paths(spark, "/raw/C/train/REAL/a.png", "/raw/C/test/FAKE/deep/b.JPEG", "/raw/C/train/real/c.png", "/raw/C/val/REAL/d.png", "/raw/C/test/FAKE/e.txt"))
    assert sorted(tuple(r) for r in got.collect()) == [("/raw/C/test/FAKE/deep/b.JPEG", 1, "cifake"), ("/raw/C/train/REAL/a.png", 0, "cifake")]


def test_folders_are_relabelled(spark):
    assert sorted(tuple(r) for r in scans.relabel_folders(paths(spark, "/x/FAKE/a.png", "/x/Real/b.png")).collect()) == [("/x/FAKE/a.png", 1), ("/x/Real/b.png", 0)]
    with pytest.raises(ValueError, match="dogs"):
        scans.relabel_folders(paths(spark, "/x/dogs/a.png"))


def test_a_split_is_read_on_demand(spark):
    rows = spark.createDataFrame([("train", "a.parquet", 1, 0), ("train", "a.parquet", 2, 2), ("val", "b.parquet", 3, 1)], "split string, parquet_file string, row_index long, source_label int")
    got = scans.scan_split(rows, "train", "parquet_file", "row_index", "sidset-parquet").collect()
    assert [tuple(r) for r in got] == [("sidset-parquet://a.parquet#1", 0)]
    with pytest.raises(ValueError, match="'test'"):
        scans.scan_split(rows, "test", "parquet_file", "row_index", "sidset-parquet")


def test_sources_are_capped_evenly_and_missing_ones_warn(spark):
    many = spark.createDataFrame([(f"m{i}", int(i % 5 == 0), "a") for i in range(100)], "path string, label int, generator string")
    few = spark.createDataFrame([("f", 1, "b", 9)], "path string, label int, generator string, extra int")
    with pytest.warns(UserWarning, match="gone"):
        got = scans.union_sources({"many": many, "gone": None, "few": few}, most=20)
    counts = {(r["generator"], r["label"]): r["count"] for r in got.groupBy("generator", "label").count().collect()}
    assert counts == {("a", 0): 10, ("a", 1): 10, ("b", 1): 1}
    assert scans.union_sources({"many": many}).count() == 100
    with pytest.raises(ValueError), pytest.warns(UserWarning):
        scans.union_sources({"gone": None})


def test_a_report_is_one_file_in_order(spark, tmp_path):
    path = tmp_path / "out" / "report.csv"
    df = spark.createDataFrame([(3, "c,\"x\""), (1, None), (2, "line\nbreak")], "n long, text string").repartition(3)
    sinks.write_report(df, f"file://{path}", "n")
    read = spark.read.schema("n long, text string").option("header", "true").option("multiLine", "true").option("escape", '"').csv(f"file://{path}").collect()
    assert [tuple(r) for r in read] == [(1, None), (2, "line\nbreak"), (3, 'c,"x"')]
    sinks.write_report(df.where("false"), f"file://{path}", "n")  # in place of the former
    assert path.read_text().strip() == '"n","text"' and [p.name for p in path.parent.iterdir()] == ["report.csv"]


def test_a_failed_report_leaves_the_former_one(spark, tmp_path):
    path = tmp_path / "report.csv"
    sinks.write_report(spark.range(3), f"file://{path}", "id")
    former = path.read_text()
    wrong = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_report(wrong, f"file://{path}")
    spark.dataSource.register(sinks.ReportFile)
    with pytest.raises(Exception, match="one writer"):
        spark.range(8).repartition(4).write.format("report_file").mode("append").option("path", f"file://{path}").save()
    assert path.read_text() == former and not [p for p in tmp_path.iterdir() if p.name.endswith(".part") and "one" in p.name]


def test_error_report(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.9, 0), ("b", 0.7, 0), ("c", 0.2, 1), ("d", 0.9, 1), ("e", 0.1, 0)], "image_id string, p double, y int")
    lines = sinks.error_lines(metrics.error_topk(rows, 10), metrics.error_topk(rows.where("image_id = 'b'"), 10))
    sinks.write_report(lines.orderBy("part", "at").select("line"), str(tmp_path / "errors.md"), text=True)
    assert (tmp_path / "errors.md").read_text().splitlines() == [
        "## False positives", "| Image | Score |", "|---|---|", "| `a` | 0.90 |", "| `b` | 0.70 |", "## False negatives", "| Image | Score |", "|---|---|", "| `c` | 0.20 |",
        "## False positives among filtered originals", "| Image | Score |", "|---|---|", "| `b` | 0.70 |",
    ]


def test_seeds_from_a_list_or_an_object(spark, tmp_path):
    posts = [{"image_id": "a", "handle": "@x", "ai_probability": 0.4, "similarity_cluster": 3, "created_at": "2024-01-01T00:00:00Z", "more": 1}, {"image_id": "b"}, {"handle": "no id"}]
    for name, payload in (("list", posts), ("object", {"posts": posts}), ("empty", {})):
        (tmp_path / f"{name}.json").write_text(json.dumps(payload, indent=1))
    read = lambda n: sorted((r["image_id"], r["similarity_cluster"]) for r in startup.read_seeds(spark, f"file://{tmp_path}/{n}.json").collect())
    assert read("list") == read("object") == [("a", 3), ("b", None)] and read("empty") == []


def test_seeds_of_files_and_near_copies(spark, tmp_path):
    (tmp_path / "dupes.csv").write_text("image_path,similarity_cluster\nnear_dupes/2 b.png,4\nnear_dupes/1.png,4\nnear_dupes/gone.png,4\nnear_dupes/3.png,7\n")
    files = spark.createDataFrame([("r1", False, "REAL/r1.jpg", "h1"), ("f1", True, "FAKE/f1.jpg", "h2"), *[(n, None, f"near_dupes/{n}", n) for n in ("1.png", "2 b.png", "3.png")]], "name string, is_fake boolean, path string, image_sha256 string")
    got = {r["image_id"]: r for r in startup.seeds_of_files(files, startup.read_dupes(spark, f"file://{tmp_path}/dupes.csv"), "2024-01-01").collect()}
    assert set(got) == {"demo_creator_real_1", "demo_ai_1", "demo_dupe_0004_1", "demo_dupe_0004_2", "demo_dupe_0007_3"}
    assert got["demo_dupe_0004_2"]["thumbnail_url"] == "/static/demo/near_dupes/2%20b.png"
    assert [got[f"demo_dupe_{i}"]["repetition_score"] for i in ("0004_1", "0004_2", "0007_3")] == [0.5, 0.5, 0.0]
    assert got["demo_ai_1"]["image_sha256"] == "h2" and got["demo_dupe_0007_3"]["similarity_cluster"] == 1007 and got["demo_dupe_0007_3"]["account_id"] == "demo-dupe-1007"
