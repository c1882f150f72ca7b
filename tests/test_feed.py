import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import images
from tessera.operators import feed, ranker
from tessera.sources import scans
from tessera.streaming import uploads

POSTS = "image_id string, handle string, ai_probability double, similarity_cluster long, similarity_score double, repetition_score double, diversity_label string, created_at timestamp, embedding array<double>, image_sha256 string"


def posts(spark):
    import datetime as dt

    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    return spark.createDataFrame([("a", "@x", 0.9, 1, 0.0, 0.0, "unique_ai", t(0), [1.0, 0.0], "h1"), ("b", "@y", 0.1, 2, 0.0, 0.0, "original", t(1), [0.0, 1.0], "h2")], POSTS)


def batch(spark, rows):
    return spark.createDataFrame(rows, "image_id string, handle string, ai_probability double, created_at timestamp, embedding array<double>, image_sha256 string, mime string, size long")


def test_uploads_join_clusters(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 2)
    ups = batch(spark, [("u1", "@z", 0.2, t, None, "h1", "image/png", 5), ("u2", "@z", 0.2, t, [0.0, 1.0], "h9", "image/png", 5), ("u3", "@z", 0.2, t, [0.6, 0.8], "h8", None, 5), ("u4", "@z", 0.2, t, None, "h7", "text/html", 5), ("u5", "@z", 0.2, t, None, "h6", "image/png", 0)])
    got = {r["image_id"]: r for r in uploads.apply_batch(ups, posts(spark), 0.9).collect()}
    assert set(got) == {"a", "b", "u1", "u2", "u3"}
    assert got["u1"]["similarity_cluster"] == 1 and got["u1"]["ai_probability"] == 0.9 and got["u1"]["diversity_label"] == "repeated_synthetic" and got["a"]["repetition_score"] == 0.7
    assert got["u2"]["similarity_cluster"] == 2 and got["u2"]["similarity_score"] == 1.0 and got["u2"]["diversity_label"] == "original"
    assert got["u3"]["similarity_cluster"] == 3 and got["u3"]["similarity_score"] == 0.0


def test_stream_equals_replay(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2024, 1, 2)
    rows = [[("u1", "@z", 0.2, t, [1.0, 0.0], "h1", "image/png", 5)], [("u2", "@z", 0.2, t, [1.0, 0.0], "h5", "image/png", 5)]]
    folder = f"file://{tmp_path}/in"
    for i, r in enumerate(rows):
        batch(spark, r).coalesce(1).write.mode("append").parquet(folder)
    store = uploads.PostsStore(spark, f"file://{tmp_path}/posts", 0.9, buckets=4)
    store.create(posts(spark))
    stream = spark.readStream.schema(batch(spark, rows[0]).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = uploads.run_stream(stream, store, f"file://{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    now = posts(spark)
    for r in rows:
        now = uploads.apply_batch(batch(spark, r), now, 0.9)
    key = lambda df: sorted((r["image_id"], r["similarity_cluster"], r["diversity_label"]) for r in df.collect())
    assert key(store.posts(2)) == key(now) and len(key(now)) == 4


def test_feed_has_ten_columns(spark):
    view = feed.feed_view(posts(spark).withColumn("thumbnail_url", F.lit("/a.jpg")))
    assert view.columns == ["image_id", "thumbnail_url", "handle", "ai_probability", "repetition_score", "diversity_label", "similarity_cluster", "cluster_size", "similarity_score", "uploaded_at"]
    assert [r["cluster_size"] for r in view.collect()] == [1, 1]


def test_simulation_never_grows(spark):
    df = spark.createDataFrame([(1, "a", "repeated_synthetic"), (2, "a", "repeated_synthetic"), (3, "a", "original"), (4, "b", "repeated_synthetic")], "image_id int, handle string, diversity_label string")
    assert [r["kept"] for r in feed.simulate_feed(df.withColumn("t", F.col("image_id")), ["t"]).orderBy("image_id").collect()] == [True, False, True, True]


def test_hue_wraps_like_32_bits(spark):
    def want(key):
        h = 0
        for c in key:
            h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
        return abs(h) % 8

    for key in ("", "sim:12", "flood:@synthetic.flood.and.more"):
        assert spark.range(1).select(feed.hue(F.lit(key))).first()[0] == want(key)


def test_ranking_is_a_permutation_without_neighbours(spark):
    rng = np.random.default_rng(0)
    rows = [{"feed_id": 1, "image_id": f"p{i}", "handle": f"@{i % 7}", "ai_probability": float(rng.random()), "repetition_score": float(rng.random()), "diversity_label": ["original", "unique_ai", "repeated_synthetic"][i % 3], "cluster_key": f"c{i % 9}"} for i in range(60)]
    got = ranker.rank_posts(rows)
    keys = [p["cluster_key"] for p in got]
    assert sorted(p["image_id"] for p in got) == sorted(p["image_id"] for p in rows) and all(a != b for a, b in zip(keys, keys[1:]))
    assert got == ranker.rank_posts(rows) and ranker.rank_posts([]) == []
    assert [r["position"] for r in ranker.rank_feed(spark.createDataFrame(rows)).orderBy("position").collect()] == list(range(60))


def test_images_round_trip_and_hash(spark):
    rng = np.random.default_rng(0)
    p = rng.integers(0, 256, (24, 31, 3), np.uint8)
    assert (images.decode_png(images.encode_png(p)) == p).all()
    bright = np.tile(np.linspace(0, 250, 36).astype(np.uint8)[None, :, None], (32, 1, 3))
    assert images.dhash(bright) == "0" * 16 and images.dhash(bright[:, ::-1]) == "f" * 16
    for name in images.TRANSFORMS:
        out = images.named_transform(name, p)
        assert out.shape == p.shape and out.dtype == np.uint8
    with pytest.raises(ValueError):
        images.named_transform("none", p)
    df = spark.createDataFrame([("a", bytearray(images.encode_png(p))), ("b", bytearray(b"not an image"))], "path string, content binary")
    got = {r["path"]: r for r in images.describe_images(df).collect()}
    assert got["a"]["decoded_width"] == 31 and got["a"]["pixel_sha256"] == images.pixel_sha256(p) and got["b"]["decode_error"]
    variants = images.make_variants(df.where("path = 'a'"), 3).collect()
    assert len(variants) == 4 and sum(v["is_original"] for v in variants) == 1


def test_archives_and_shards(spark, tmp_path):
    p = images.encode_png(np.zeros((4, 4, 3), np.uint8))
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z/afhq.zip", "w") as z:
        for name in ("afhq/train/a.png", "afhq/b.txt", "afhq/test/c.PNG"):
            z.writestr(name, p)
    (tmp_path / "z/bad.zip").write_bytes(b"no zip")
    got = scans.scan_zip_archives(spark, f"file://{tmp_path}/z").collect()
    assert sorted(r["member_path"] for r in got if r["member_path"]) == ["afhq/test/c.PNG", "afhq/train/a.png"] and sum(r["error"] is not None for r in got) == 1
    spark.createDataFrame([("i", (bytearray(p), "x"), 4, 4, 1)], "img_id string, image struct<bytes:binary,path:string>, width int, height int, label int").coalesce(1).write.parquet(f"file://{tmp_path}/s")
    part = next((tmp_path / "s").glob("part-*.parquet"))
    shard = part.rename(tmp_path / "train-00000-of-00001.parquet")
    bad = tmp_path / "validation-0.parquet"
    spark.range(1).coalesce(1).write.parquet(f"file://{tmp_path}/b")
    next((tmp_path / "b").glob("part-*.parquet")).rename(bad)
    rows, rejected = scans.scan_parquet_shards(spark, [f"file://{shard}", f"file://{bad}"])
    row = rows.first()
    assert (row["split"], row["row_index"]) == ("train", 0) and bytes(row["content"]) == p and rejected.count() == 1
    tree = scans.scan_image_tree(spark, f"file://{tmp_path}/z")
    assert tree.count() == 0
