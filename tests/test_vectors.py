import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import scoring
from tessera.functions.significance import correlation_p
from tessera.operators import clusters, metrics, vectors
from tessera.operators.components import connected_components


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(0)
    base = unit(rng.normal(size=(1, 64)))
    return unit(np.vstack([base + 0.01 * rng.normal(size=(3, 64)), rng.normal(size=(2, 64))]))


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (200, 200)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_near_copies_are_one_cluster(spark, points):
    for method in ({"method": "threshold", "threshold": 0.9}, {"method": "dbscan", "eps": 0.05}):
        got = {r["vec_id"]: r["similarity_cluster"] for r in clusters.cluster_images(frame(spark, points), **method).collect()}
        assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2}
    with pytest.raises(ValueError):
        clusters.cluster_images(frame(spark, points), method="other")


def test_dbscan_border_and_noise(spark):
    angle = np.deg2rad([0, 10, 20, 31, 90])
    x = np.stack([np.cos(angle), np.sin(angle)], 1)
    got = {r["vec_id"]: r["component"] for r in clusters.cluster_dbscan(frame(spark, x), eps=1 - np.cos(np.deg2rad(11.5)), min_samples=3).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 4} or got[4] == 4 and len({got[i] for i in range(4)}) == 1


def test_blocks_give_the_same_pairs(spark, monkeypatch):
    x = unit(np.random.default_rng(1).normal(size=(60, 8)))
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    got = {(r["src"], r["dst"]) for r in vectors.similar_pairs(frame(spark, x), 0.5).collect()}
    sims = x @ x.T
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if sims[i, j] >= 0.5}
    best = vectors.annotate_similarity(frame(spark, x).withColumn("image_id", F.col("vec_id")).withColumn("similarity_cluster", F.col("vec_id") % 2)).toPandas()
    for r in best.itertuples():
        other = [sims[r.vec_id, j] for j in range(60) if j != r.vec_id and j % 2 == r.vec_id % 2]
        assert abs(r.similarity_score - round(max(0, *other), 4)) < 2e-4


def test_repetition_and_precision(spark):
    df = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate([(0, 0), (0, 0), (0, 1), (1, 1), (2, None)])], "vec_id long, component int, truth int")
    assert [r["repetition_score"] for r in clusters.corpus_repetition(df).orderBy("vec_id").collect()] == [0.4, 0.4, 0.4, 0.0, 0.0]
    row = clusters.pairwise_pr(df, "component", "truth").first()
    assert (row["tp"], row["predicted"], row["actual"], row["n_pairs"]) == (1, 3, 2, 6)


def test_assignment_of_uploads(spark):
    posts = spark.createDataFrame([(4, [1.0, 0.0, 0.0], 1), (6, [0.0, 1.0, 0.0], 2)], "similarity_cluster long, embedding array<double>, created_at int")
    ups = spark.createDataFrame([("a", [0.99, 0.14, 0.0]), ("b", [0.0, 0.0, 1.0]), ("c", None)], "image_id string, embedding array<double>")
    got = {r["image_id"]: (r["similarity_cluster"], round(r["similarity_score"], 2)) for r in vectors.assign_cluster(ups, posts, 0.9).collect()}
    assert got == {"a": (4, 0.99), "b": (7, 0.0), "c": (8, 0.0)}


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([("x", 0.5, 1), ("x", 0.5, 0), ("x", 0.9, 1), ("x", 0.1, 1), ("y", 0.3, 0)], "g string, p double, y int")
    got = {r["g"]: r["auc"] for r in metrics.roc_auc(df, ["g"]).collect()}
    assert got["y"] is None and abs(got["x"] - (0.5 + 1 + 0) / 3) < 1e-12


def test_temperature_recovers_the_scale(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=4000) * 2
    y = (rng.random(4000) < 1 / (1 + np.exp(-z / 2.5))).astype(int)
    assert abs(metrics.temperature_fit(spark.createDataFrame(pd.DataFrame({"logit": z, "y": y}))) - 2.5) < 0.35


@pytest.mark.parametrize("r, n, p", [(0.5, 20, 0.02476956), (-0.5, 20, 0.02476956), (0.1, 11, 0.769875), (0.9, 5, 0.03738607), (0.01, 100_000, 0.00156518975), (0.02, 100_000, 2.5303e-10), (0.0, 50, 1.0), (1.0, 9, 0.0), (None, 20, None), (float("nan"), 20, None), (0.3, 2, None)])
def test_p_of_a_correlation(spark, r, n, p):
    got = spark.createDataFrame([(r, n)], "r double, n long").select(correlation_p(F.col("r"), F.col("n")).alias("p")).first()["p"]
    assert got is None if p is None else abs(got - p) <= 1e-4 * p + 1e-15


def test_p_equals_a_numeric_integral(spark):
    rng = np.random.default_rng(3)
    rows = [(float(r), int(n)) for r, n in zip(rng.uniform(-0.95, 0.95, 40), rng.integers(3, 400, 40))]
    for row in spark.createDataFrame(rows, "r double, n long").withColumn("p", correlation_p(F.col("r"), F.col("n"))).collect():
        # The density of r under no correlation is proportional to cos(u)^(n - 3) with r = sin(u).
        u = np.linspace(-np.pi / 2, np.pi / 2, 200_001)
        density = np.cos(u) ** (row["n"] - 3)
        assert abs(row["p"] - np.trapezoid(np.where(np.abs(np.sin(u)) >= abs(row["r"]), density, 0), u) / np.trapezoid(density, u)) < 2e-4



def test_heads_agree(spark, points):
    w1, b1, w2 = [[0.1] * 64, [-0.2] * 64], [0.0, 0.3], [1.0, -2.0]
    df = scoring.mlp_head_batch(frame(spark, points).withColumn("a", scoring.mlp_head(F.col("embedding"), w1, b1, w2, 0.1, 2.0)), "embedding", w1, b1, w2, 0.1, 2.0).toPandas()
    assert np.allclose(df["a"], df["p"])


@pytest.mark.parametrize(("p", "repeated", "label"), [(0.5, True, "repeated_synthetic"), (0.5, False, "unique_ai"), (0.49, True, "original")])
def test_labels(spark, p, repeated, label):
    assert spark.range(1).select(scoring.label_for(F.lit(p), F.lit(repeated))).first()[0] == label


def test_pairwise_stats_expand_no_pairs(spark, monkeypatch):
    def expanded(*_):
        raise AssertionError("pairs left their tasks")

    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vectors, "cosine_matrix", expanded)
    for n in (2, 3, 41, 60):
        x = np.random.default_rng(n).normal(size=(n, 8))
        x[: n // 3] = x[0]  # cosines that occur many times
        sims = (x @ x.T)[np.triu_indices(n, 1)]
        row = vectors.pairwise_stats(frame(spark, x)).first()
        assert np.allclose(row[:4], [sims.min(), np.median(sims), sims.mean(), sims.max()], rtol=1e-12, atol=1e-14) and row["n_pairs"] == len(sims)
    assert tuple(vectors.pairwise_stats(frame(spark, x[:1])).first()) == (None, None, None, None, 0)


def test_ordered_bits_of_doubles():
    x = np.sort(np.r_[np.random.default_rng(0).normal(size=100), 0.0, 1e-320, -1e-320, -np.inf, np.inf])
    bits = vectors._ordered(x)
    assert (np.diff(bits.astype(object)) > 0).all() and [vectors._double(int(b)) for b in bits] == list(x)
    assert vectors._ordered(np.array([-0.0])) == vectors._ordered(np.array([0.0]))


def test_pairs_come_in_strips(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 32)
    monkeypatch.setattr(vectors, "STRIP_CELLS", 64)
    x = unit(np.random.default_rng(1).normal(size=(60, 8)))

    def keep(a_keys, a, b_keys, b, same):
        assert len(a) * len(b) <= max(64, len(b)), "more than a strip at once"
        return pd.DataFrame({"n": [len(a) * len(b)]})

    got = vectors.all_pairs(frame(spark, x), "vec_id", "embedding", keep, "n long").toPandas()["n"]
    assert len(got) > 60 / 32 * 3
    assert vectors.cosine_matrix(frame(spark, x)).count() == 60 * 59 // 2


def test_copies_of_a_vector_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 2)
    monkeypatch.setattr(vectors, "BLOCKS", 5)
    x = unit(np.random.default_rng(1).normal(size=(60, 8)))
    assert vectors._blocks(frame(spark, x), "vec_id", "embedding")[1] <= 5  # 30 before
    sims = x @ x.T
    got = {(r["src"], r["dst"]): r["sim"] for r in vectors.cosine_matrix(frame(spark, x)).collect()}
    assert len(got) == 60 * 59 // 2 and all(abs(s - sims[p]) < 1e-12 for p, s in got.items())
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 8 * 8 * 4)  # four vectors
    assert vectors._blocks(frame(spark, x), "vec_id", "embedding")[1] == 15


@pytest.mark.parametrize("kind", ["normal", "copies", "ties", "doubles", "keys", "nan", "huge", "crowded"])
def test_pairwise_stats_in_two_passes(spark, monkeypatch, kind):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vectors, "STRIP_CELLS", 100)
    monkeypatch.setattr(vectors, "READ", 8)
    passes, pairs = [], vectors.all_pairs
    monkeypatch.setattr(vectors, "all_pairs", lambda *a, **k: (passes.append(1), pairs(*a, **k))[1])
    x, keys = unit(np.random.default_rng(5).normal(size=(61, 8))), list(range(61))
    if kind == "copies":
        x = x[np.arange(61) % 7]
    elif kind == "ties":
        x = np.eye(8)[np.arange(61) % 8]
    elif kind == "doubles":  # cosines that single precision cannot tell apart
        x = unit(np.ones((61, 8)) + 1e-9 * x)
    elif kind == "keys":
        keys = [k // 2 for k in keys]
    elif kind == "nan":
        x[3, 2] = np.nan
    elif kind == "huge":
        x = x * 1e20
    elif kind == "crowded":
        monkeypatch.setattr(vectors, "MIDDLE", 0)
    rows = [(k, [float(c) for c in v]) for k, v in zip(keys, x)]
    got = vectors.pairwise_stats(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).first()
    sims = np.array([x[i] @ x[j] for i in range(61) for j in range(61) if keys[i] < keys[j]])
    sims = sims[~np.isnan(sims)]
    assert np.allclose(got[:4], [sims.min(), np.median(sims), sims.mean(), sims.max()], rtol=1e-12, atol=1e-14) and got["n_pairs"] == len(sims)
    assert len(passes) == 2 or kind in ("nan", "huge", "crowded")  # 3 before
