import pytest
from pyspark.sql import functions as F

from tessera.operators import dedup, report, splits, validate
from tessera.plans.ordinals import number_rows


def policy(spark, rows):
    df = spark.createDataFrame(rows, "path string, key string, label int, split string")
    rank = F.struct(F.when(F.col("split").isin("validation", "test"), 0).otherwise(1).alias("s"), F.col("path").alias("p"))
    return {r["path"]: r for r in dedup.exact_dup_policy(df, "key", "label", rank).collect()}


def test_evaluation_copy_is_kept(spark):
    got = policy(spark, [("a", "k", 0, "train"), ("b", "k", 0, "test"), ("c", "x", 1, "train")])
    assert [got[p]["include"] for p in "abc"] == [False, True, True]
    assert got["a"]["exclusion_reason"] == dedup.DUPLICATE and got["a"]["exact_duplicate_group"] == "exact_000001" and got["c"]["exact_duplicate_group"] is None


def test_label_conflict_drops_the_group(spark):
    got = policy(spark, [("a", "k", 0, "train"), ("b", "k", 1, "test")])
    assert not any(r["include"] for r in got.values()) and {r["exclusion_reason"] for r in got.values()} == {dedup.CONFLICT}


def test_stats_are_zero_without_duplicates(spark):
    df = spark.createDataFrame([("a", 0, "train")], "key string, label int, split string")
    assert tuple(dedup.dup_stats(df, "key", "label", "split").first()) == (0, 0, 0, 0)


def test_review_needs_different_pixels(spark):
    df = spark.createDataFrame([("f", "x"), ("f", "x"), ("g", "x"), ("g", "y")], "fp string, px string")
    assert {r["fp"] for r in dedup.near_dup_review(df, "fp", "px").collect()} == {"g"}
    assert dedup.near_dup_review(df, "fp", "px", require_distinct_pixels=False).count() == 4


def test_rejects_have_the_first_reason(spark):
    rows = [(1, 1, 1, 1, 1), (9, 1, 1, 1, 1), (0, 0, 1, 1, 1), (0, 2, 1, 1, 1), (0, 1, 1, None, None)]
    df = spark.createDataFrame(rows, "source_label int, width int, height int, decoded_width int, decoded_height int")
    got = [r["reason"] for r in validate.validate_rows(df, with_label=True).collect()]
    assert got == [None, "invalid_label", "invalid_metadata_dimensions", "dimension_mismatch", "unreadable"]


def test_report_adds_up(spark):
    df = spark.createDataFrame([("train", 0, "1x1", None, True), ("test", 1, "1x1", None, False), ("test", 1, None, "bad", None)], "split string, label int, dims string, reason string, include boolean")
    got = {(r["section"], r["name"]): r["n"] for r in report.cleaning_report(df).collect()}
    assert got == {("total", "discovered"): 3, ("total", "valid"): 2, ("total", "included"): 1, ("total", "rejected"): 1, ("included", "train/0"): 1, ("dims", "1x1"): 2, ("reason", "bad"): 1}


def samples(spark, n=20, holdout=4):
    rows = [(f"p{i:03d}", i % 2, "real") for i in range(n)] + [(f"h{i}", 1, "unseen") for i in range(holdout)]
    return spark.createDataFrame(rows, "path string, label int, generator string")


def test_split_ignores_row_order_and_holds_out(spark):
    df = samples(spark)
    a = {r["path"]: r["split"] for r in splits.seeded_split(df, holdout="unseen").collect()}
    b = {r["path"]: r["split"] for r in splits.seeded_split(df.orderBy(F.desc("path")), holdout="unseen").collect()}
    counts = {s: list(a.values()).count(s) for s in set(a.values())}
    assert a == b and counts == {"train": 16, "val": 2, "test": 2, "unseen_generator": 4}


def test_fingerprint_follows_the_paths(spark):
    a, b = samples(spark), samples(spark, 19)
    for f in (splits.fingerprint, splits.fingerprint_scalable):
        assert f(a).first() == f(a.orderBy(F.rand())).first() != f(b).first()


@pytest.mark.parametrize(("n", "most"), [(10, 3), (7, 7), (399, 57), (5, 9)])
def test_systematic_sample_follows_the_formula(spark, n, most):
    df = spark.range(n)
    want = list(range(n)) if n <= most else sorted({min(int(i * (n / most)), n - 1) for i in range(most)})
    assert sorted(r["id"] for r in splits.systematic_sample(df, most, "id").collect()) == want


def test_numbers_are_gapless(spark):
    got = [r["ordinal"] for r in number_rows(spark.range(100), F.col("id")).orderBy("id").collect()]
    assert got == list(range(100)) and number_rows(spark.range(0), F.col("id")).count() == 0


def test_upsert_takes_the_latest(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, x int")
    got = {r["k"]: r["x"] for r in dedup.latest_wins(old, spark.createDataFrame([("a", 2, 5), ("c", 1, 7)], old.schema), "k", "v").collect()}
    assert got == {"a": 5, "b": 1, "c": 7}


def test_update_and_delete_of_posts(spark):
    old = spark.createDataFrame([("a", 1, True), ("b", 2, False), (None, 3, None)], "k string, x int, seed boolean")
    changes = spark.createDataFrame([("a", 5), ("a", 4), ("b", None), ("z", 9), (None, 8)], "k string, x int")
    got = {r["k"]: r["x"] for r in dedup.update_rows(old, changes, "k", ["x"]).collect()}
    assert got == {"a": 5, "b": None, None: 3}
    assert {r["k"] for r in dedup.delete_rows(old, ~F.col("seed")).collect()} == {"a", None}
    assert dedup.update_rows(old.limit(0), changes, "k", ["x"]).count() == 0


def test_paths_whose_folders_agree_are_valid(spark):
    rows = [("train/train/real/a.png",), ("x/validation/fake/ai/b.png",), ("train/test/real/c.png",), ("test/ai/real/d.png",)]
    out = validate.infer_path_metadata(spark.createDataFrame(rows, "path string")).collect()
    assert [(r["split"], r["label"], r["reason"]) for r in out] == [("train", 0, None), ("val", 1, None), (None, 0, "ambiguous_split"), ("test", None, "ambiguous_label")]


def test_holdout_archives_never_come_in(spark):
    names = ["Images/Real/coco_val2017/x.zip", "Images/Real/dall-e.zip", "Images/Diffusion_based/DALLE3_more.zip", "Images/Real/afhq.zip"]
    out = validate.archive_source_info(spark.createDataFrame([(n,) for n in names], "archive_path string")).collect()
    assert [r["reason"] for r in out] == ["holdout", "holdout", "holdout", None] and out[3]["source"] == "wildfake_real_afhq"


def test_generators_keep_their_names(spark):
    from tessera.sources import scans

    manifest = spark.createDataFrame([("a.zip", "m.png", "DDIM", 1, "True"), ("b.zip", "n.png", "X", 0, "True"), ("a.zip", "o.png", "DDIM", 1, "False")], "archive_path string, member_path string, generator string, source_label int, include string")
    files = spark.createDataFrame([("a.zip",)], "archive_path string")
    got = [tuple(r) for r in scans.scan_manifest(manifest, files, "archive_path", "member_path", "wildfake-zip", generator="generator").collect()]
    assert got == [("wildfake-zip://a.zip#m.png", 1, "wildfake_DDIM")]
    shards = manifest.withColumnRenamed("archive_path", "parquet_file")
    assert {r["generator"] for r in scans.scan_manifest(shards, files.withColumnRenamed("archive_path", "parquet_file"), "parquet_file", "member_path", "sidset-parquet").collect()} == {"sid_set"}
    paths = spark.createDataFrame([("raw/wildfake/ai/DDIM/a.png",), ("raw/wildfake/ai/b.png",), ("raw/Own/real/c.png",), ("raw/none/d.png",)], "path string")
    assert [tuple(r)[1:] for r in scans.scan_dataset(paths).collect()] == [(1, "wildfake_DDIM"), (1, "wildfake_unknown"), (0, "Own")]


def test_shards_of_other_names_are_rejected(spark, tmp_path):
    from tessera.sources import scans

    rows = spark.createDataFrame([("i", bytearray(b"x"), 1, 1, 0)], "img_id string, image binary, width int, height int, label int")
    for name in ("Train-0.parquet", "test-0.parquet"):
        rows.coalesce(1).write.parquet(f"file://{tmp_path}/{name}")
    parts = {n: f"file://{tmp_path}/{n}" for n in ("Train-0.parquet", "test-0.parquet")}
    _, rejected = scans.scan_parquet_shards(spark, list(parts.values()))
    assert [r["parquet_file"] for r in rejected.collect()] == [parts["test-0.parquet"]]
