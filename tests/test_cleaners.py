"""The three cleaners, end to end."""

import csv
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tessera.functions.images import encode_png
from tessera.operators import cleaners


def png(color, side=8):
    return encode_png(np.broadcast_to(np.array(color, np.uint8), (side, side, 3)).copy())


def save(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def read_csv(folder):
    out = []
    for file in sorted(folder.glob("*.csv")):
        with file.open(newline="", encoding="utf-8") as f:
            out += list(csv.DictReader(f))
    return out


def report(cleaned):
    return {(r["section"], r["name"]): r["n"] for r in cleaned.report().collect()}


def test_an_image_tree_keeps_the_test_copy_and_reports(spark, tmp_path):
    raw = tmp_path / "raw"
    save(raw / "train/REAL/real.png", png((10, 20, 30)))
    save(raw / "train/FAKE/fake.png", png((100, 110, 120)))
    save(raw / "test/FAKE/duplicate.png", png((100, 110, 120)))
    save(raw / "test/REAL/broken.png", b"not an image")
    save(raw / "elsewhere/real.png", png((1, 1, 1)))
    done = cleaners.clean_image_tree(spark, f"file://{raw}")
    done.write(f"file://{tmp_path}/out")
    job = {k: done.metrics[k] for k in ("discovered", "valid", "included", "rejected", "cross_split_groups", "cross_label_groups", "exact_duplicate_groups", "exact_duplicate_images")}
    assert job == {"discovered": 5, "valid": 3, "included": 2, "rejected": 2, "cross_split_groups": 1, "cross_label_groups": 0, "exact_duplicate_groups": 1, "exact_duplicate_images": 2}
    assert {r["relative_path"] for r in read_csv(tmp_path / "out/clean_manifest")} == {"train/REAL/real.png", "test/FAKE/duplicate.png"}
    assert len(read_csv(tmp_path / "out/manifest")) == 3
    assert {r["relative_path"]: r["reason"] for r in read_csv(tmp_path / "out/rejected")} == {"test/REAL/broken.png": "unreadable", "elsewhere/real.png": "ambiguous_split"}
    told = report(done)
    assert told["included", "train/0"] == told["included", "test/1"] == 1 and told["dims", "8x8"] == 3 and told["reason", "unreadable"] == 1
    assert {(r["section"], r["name"]): int(r["n"]) for r in read_csv(tmp_path / "out/cleaning_report")} == told
    # Flat images share a difference hash: a review group of different pixels.
    assert {r["relative_path"] for r in read_csv(tmp_path / "out/near_duplicate_review")} == {"train/REAL/real.png", "train/FAKE/fake.png", "test/FAKE/duplicate.png"} and done.metrics["review_groups"] == 1


def test_copies_across_labels_all_go(spark, tmp_path):
    save(tmp_path / "train/REAL/same.png", png((5, 6, 7)))
    save(tmp_path / "train/FAKE/same.png", png((5, 6, 7)))
    done = cleaners.clean_image_tree(spark, f"file://{tmp_path}")
    assert done.metrics["cross_label_groups"] == 1 and done.metrics["included"] == 0 and done.clean().count() == 0


def shard(path, rows, columns=("img_id", "image", "mask", "width", "height", "label")):
    path.parent.mkdir(parents=True, exist_ok=True)
    table = pa.table({"img_id": [r[0] for r in rows], "image": [{"bytes": r[1], "path": None} for r in rows], "mask": [{"bytes": None, "path": None} for _ in rows], "width": pa.array([r[3] if len(r) > 3 else 8 for r in rows], pa.int64()), "height": [8 for _ in rows], "label": [r[2] for r in rows]})
    pq.write_table(table.select(list(columns)), path)
    return f"file://{path}"


def test_shards_keep_labels_and_the_validation_copy(spark, tmp_path):
    image = png((10, 20, 30))
    paths = [shard(tmp_path / "train-00000-of-00001.parquet", [("real", image, 0), ("fake", png((100, 110, 120)), 1)]), shard(tmp_path / "validation-00000-of-00001.parquet", [("real-copy", image, 0)])]
    done = cleaners.clean_shards(spark, paths)
    assert (done.metrics["discovered"], done.metrics["valid"], done.metrics["included"], done.metrics["cross_split_groups"]) == (3, 3, 2, 1)
    assert {(r["label"], r["split"], r["img_id"]) for r in done.clean().collect()} == {(1, "train", "fake"), (0, "validation", "real-copy")}


def test_shards_with_bad_rows_and_columns(spark, tmp_path):
    paths = [
        shard(tmp_path / "train-00000-of-00001.parquet", [("bad-bytes", b"not an image", 0), ("bad-label", png((1, 2, 3)), 9), ("bad-width", png((1, 2, 3)), 0, 0), ("other-width", png((1, 2, 3)), 0, 9), ("none", None, 0)]),
        shard(tmp_path / "train-00001-of-00001.parquet", [("x", png((1, 2, 3)), 0)], ("img_id", "image")), shard(tmp_path / "other.parquet", [("x", png((1, 2, 3)), 0)]),
    ]
    done = cleaners.clean_shards(spark, paths)
    assert (done.metrics["discovered"], done.metrics["valid"], done.metrics["rejected"], done.metrics["rejected_containers"]) == (5, 0, 5, 2)
    assert {r["img_id"]: r["reason"] for r in done.rejected().collect()} == {"bad-bytes": "unreadable", "bad-label": "invalid_label", "bad-width": "invalid_metadata_dimensions", "other-width": "dimension_mismatch", "none": "unreadable"}


def pack(path, members):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)


def test_archives_are_validated_and_deduplicated(spark, tmp_path):
    payload = png((10, 20, 30))
    pack(tmp_path / "Images/Real/afhq.zip", {"afhq/train/a.png": payload, "afhq/test/a_copy.png": payload, "afhq/train/b.txt": b"ignored", "afhq/train/bad.png": b"not an image"})
    pack(tmp_path / "Images/Real/coco.zip", {"coco/train/a.png": png((1, 2, 3))})
    save(tmp_path / "Images/GAN_based/broken.zip", b"no archive")
    names = ["Images/Real/afhq.zip", "Images/Real/coco.zip", "Images/Diffusion_based/DDIM.zip", "Images/GAN_based/broken.zip"]
    done = cleaners.clean_archives(spark, f"file://{tmp_path}", names)
    got = {k: done.metrics[k] for k in ("valid", "included", "exact_duplicate_groups", "rejected", "rejected_containers")}
    assert got == {"valid": 2, "included": 1, "exact_duplicate_groups": 1, "rejected": 1, "rejected_containers": 3}
    assert [(r["member_path"], r["source"], r["generator"], r["label"], r["split"]) for r in done.clean().collect()] == [("afhq/test/a_copy.png", "wildfake_real_afhq", "afhq", 0, "test")]
    reasons = {r["archive_path"]: r["reason"] for r in done.containers.collect()}
    assert reasons["Images/Real/coco.zip"] == "holdout" and reasons["Images/Diffusion_based/DDIM.zip"] == "archive_not_found" and reasons["Images/GAN_based/broken.zip"].startswith("invalid_zip")


def test_only_a_missing_archive(spark, tmp_path):
    done = cleaners.clean_archives(spark, f"file://{tmp_path}", ["Images/Diffusion_based/DDIM.zip"])
    assert done.metrics["valid"] == 0 and done.metrics["rejected_containers"] == 1 and report(done)["job", "valid"] == 0


def test_a_cap_takes_every_nth_member(spark, tmp_path):
    pack(tmp_path / "Images/Real/afhq.zip", {f"m{i:02}.png": png((i, i, i)) for i in range(11)})
    pack(tmp_path / "Images/Real/tiny.zip", {f"t{i}.png": png((i, 0, 0)) for i in range(3)})
    done = cleaners.clean_archives(spark, f"file://{tmp_path}", ["Images/Real/afhq.zip", "Images/Real/tiny.zip"], most=4)
    got = sorted(r["member_path"] for r in done.manifest().collect())
    assert got == [f"m{int(i * 11 / 4):02}.png" for i in range(4)] + ["t0.png", "t1.png", "t2.png"]
