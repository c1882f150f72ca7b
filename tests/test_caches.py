"""Results computed once: splits and features; training that goes on from its last step."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import caches, training
from tessera.operators.splits import seeded_split


def samples(spark, n, generator="cifake", rows=()):
    own = [(f"/data/img_{i}.jpg", i % 2, generator) for i in range(n)] + list(rows)
    random.Random(n).shuffle(own)
    return spark.createDataFrame(own, "path string, label int, generator string")


def by_split(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["split"], set()).add(r["path"])
    return out


KNOWN = {"holdout": "none", "train": 0.6, "val": 0.2, "seed": 42}


def folders(path):
    return sorted(p.name for p in path.iterdir() if p.name.startswith("split-"))


def test_a_split_is_used_again_whatever_the_order(spark, tmp_path):
    folder = f"file://{tmp_path}/cache"
    first = by_split(caches.cached_split(samples(spark, 20), folder, **KNOWN))
    made = folders(tmp_path / "cache")
    second = by_split(caches.cached_split(samples(spark, 20).orderBy(F.desc("path")).repartition(3), folder, **KNOWN))
    assert first == second == by_split(seeded_split(samples(spark, 20), **KNOWN)) and folders(tmp_path / "cache") == made and len(made) == 1
    assert {k: len(v) for k, v in first.items()} == {"train": 12, "val": 4, "test": 4}


def test_a_split_is_computed_again_when_inputs_change(spark, tmp_path):
    folder = f"file://{tmp_path}/cache"
    caches.cached_split(samples(spark, 20), folder, **KNOWN)
    made = folders(tmp_path / "cache")
    grown = by_split(caches.cached_split(samples(spark, 20, rows=[("/data/img_new.jpg", 0, "cifake")]), folder, **KNOWN))
    assert set().union(*grown.values()) == {f"/data/img_{i}.jpg" for i in range(20)} | {"/data/img_new.jpg"}
    again = folders(tmp_path / "cache")
    assert len(again) == 1 and again != made  # the former split is replaced
    caches.cached_split(samples(spark, 20, rows=[("/data/img_new.jpg", 0, "cifake")]), folder, **(KNOWN | {"seed": 43}))
    assert folders(tmp_path / "cache") != again


@pytest.mark.parametrize("damage", ["bytes", "rows", "record", "gone"])
def test_a_damaged_split_is_computed_again(spark, tmp_path, damage):
    folder = f"file://{tmp_path}/cache"
    first = by_split(caches.cached_split(samples(spark, 20), folder, **KNOWN))
    place = tmp_path / "cache" / folders(tmp_path / "cache")[0]
    if damage == "rows":
        spark.createDataFrame([("/data/img_1.jpg", "train")], "path string, split string").write.mode("overwrite").parquet(f"file://{place}")
    for file in [*(place if damage in ("bytes", "gone") else tmp_path / "cache/records" if damage == "record" else tmp_path / "none").rglob("*.parquet")]:
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
        file.unlink() if damage == "gone" else file.write_bytes(b"damaged")
    assert by_split(caches.cached_split(samples(spark, 20), folder, **KNOWN)) == first
    assert by_split(caches.cached_split(samples(spark, 20), folder, **KNOWN)) == first


def test_holdout_stays_apart_and_nothing_is_written_without_a_folder(spark, tmp_path):
    rows = [(f"/data/holdout_{i}.jpg", i % 2, "wildfake_gan") for i in range(4)]
    out = by_split(caches.cached_split(samples(spark, 16, rows=rows), f"file://{tmp_path}/cache", holdout="wildfake_gan", train=0.5, val=0.25))
    assert out["unseen_generator"] == {r[0] for r in rows} and len(out["train"]) == 8 and len(out["val"]) == 4
    plain = tmp_path / "plain"
    plain.mkdir()
    assert len(by_split(caches.cached_split(samples(spark, 10), None, **KNOWN))["train"]) == 6 and list(plain.iterdir()) == []
    assert caches.cached_split(samples(spark, 4).limit(0), f"file://{tmp_path}/none", **KNOWN).collect() == []


def test_features_are_computed_once(spark, tmp_path):
    table = caches.FeatureTable(spark, f"file://{tmp_path}/f", ["id", "condition"], "id long, condition string, features array<double>", runs=2)
    asked = []

    def compute(rows):
        asked.append(sorted((r["id"], r["condition"]) for r in rows.collect()))
        return rows.withColumn("features", F.array(F.col("id") * 1.0, F.length("condition") * 1.0))

    rows = lambda ids, *cs: spark.createDataFrame([(i, c) for i in ids for c in cs], "id long, condition string")
    assert table.read().collect() == []
    assert table.ensure(rows([1, 2, 2], "clean"), compute) == 2
    assert table.ensure(rows([1, 2], "clean"), compute) == 0 and len(asked) == 1
    assert table.ensure(rows([1, 2, 3], "clean", "blur"), compute) == 4
    assert asked[1] == [(1, "blur"), (2, "blur"), (3, "blur"), (3, "clean")]
    assert len(list((tmp_path / "f").glob("run-*"))) == 2
    out = caches.with_features(rows([3, 4], "clean"), table, compute).collect()  # a third run: merged
    assert sorted((r["id"], r["run"], r["features"]) for r in out) == [(3, 1, [3.0, 5.0]), (4, 2, [4.0, 5.0])]
    assert len(list((tmp_path / "f").glob("run-*"))) == 1
    have = {(r["id"], r["condition"]): r["run"] for r in table.read().collect()}
    assert have == {(1, "clean"): 0, (2, "clean"): 0, (1, "blur"): 1, (2, "blur"): 1, (3, "blur"): 1, (3, "clean"): 1, (4, "clean"): 2}


def test_a_run_without_a_record_does_not_count(spark, tmp_path):
    table = caches.FeatureTable(spark, f"file://{tmp_path}/f", ["id"], "id long, x double")
    compute = lambda rows: rows.withColumn("x", F.lit(1.0))
    ids = lambda *i: spark.createDataFrame([(k,) for k in i], "id long")
    table.ensure(ids(1), compute)
    spark.createDataFrame([(2, 9.0, 1)], "id long, x double, run int").write.parquet(f"file://{tmp_path}/f/run-1-lost")  # a job that died
    assert table.ensure(ids(1, 2), compute) == 1
    assert sorted((r["id"], r["x"]) for r in table.read().collect()) == [(1, 1.0), (2, 1.0)]


def trained(x, y, head, steps, rate, decay):
    """The same training on one matrix."""
    flat, m, v, losses = head.flat.copy(), np.zeros_like(head.flat), np.zeros_like(head.flat), []
    for step in range(1, steps + 1):
        loss, g = training.loss_and_gradient(training.Head(head.dims, head.hidden, flat), x, y)
        losses.append(loss / len(x))
        flat, m, v = training.adam(flat, g / len(x), m, v, step, rate, decay)
    return flat, losses


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    head, x, y = training.Head.drawn(5, 3, 4), rng.normal(size=(20, 5)), rng.integers(0, 2, 20).astype(float)
    _, g = training.loss_and_gradient(head, x, y)
    for i in range(len(head.flat)):
        step = np.zeros_like(head.flat)
        step[i] = 1e-6
        slope = (training.loss_and_gradient(training.Head(5, 3, head.flat + step), x, y)[0] - training.loss_and_gradient(training.Head(5, 3, head.flat - step), x, y)[0]) / 2e-6
        assert abs(slope - g[i]) < 1e-5


def test_training_equals_one_matrix_and_goes_on_after_a_stop(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(training, "BLOCK", 7)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    df = spark.createDataFrame([([float(c) for c in r], int(t)) for r, t in zip(x, y)] + [(None, 1), ([0.0] * 6, None)], "x array<double>, y int").repartition(5)
    head = training.Head.drawn(6, 4, 9)
    want, losses = trained(x, y, head, 6, 0.05, 0.01)
    folder = f"file://{tmp_path}/head"
    training.train_head(df, head, 3, 0.05, 0.01, folder)
    got, seen = training.train_head(df, head, 6, 0.05, 0.01, folder)  # goes on with the fourth step
    assert np.allclose(seen, losses, atol=1e-9) and np.allclose(got.flat, want, atol=1e-6) and seen[-1] < seen[0]
    with pytest.raises(ValueError, match="no rows"):
        training.train_head(df.limit(0), head, 1)
