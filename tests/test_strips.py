"""What a task holds while it compares blocks of vectors: strips of their product, not the whole of it."""

import datetime as dt
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql.pandas.group_ops import PandasCogroupedOps, PandasGroupedOpsMixin

from tessera.operators import vectors
from tessera.streaming import uploads

ROWS = 3000  # their product has 72 MB
PEAK = 48 << 20
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def functions(monkeypatch):
    """The functions given to applyInPandas, in order."""
    seen = []
    for kind in (PandasCogroupedOps, PandasGroupedOpsMixin):
        monkeypatch.setattr(kind, "applyInPandas", lambda self, f, schema, put=kind.applyInPandas: (seen.append(f), put(self, f, schema))[1])
    return seen


@pytest.fixture(scope="module")
def units():
    v = np.random.default_rng(0).normal(size=(2 * ROWS, 8))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def peak(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def posts(spark):
    rows = [(f"p{i}", i, [1.0, 0.0], START) for i in range(3)]
    return spark.createDataFrame(rows, "image_id string, similarity_cluster long, embedding array<double>, created_at timestamp")


def test_best_matches(spark, functions, units):
    p = posts(spark)
    vectors.best_matches(p, p, "image_id", "embedding", "created_at")
    a = pd.DataFrame({"k": [f"u{i}" for i in range(ROWS)], "v": list(units[:ROWS])})
    b = pd.DataFrame({"best_cluster": range(ROWS), "_at": pd.Timestamp(START) + pd.to_timedelta(range(ROWS), "s"), "v": list(units[ROWS:])})
    got, most = peak(lambda: functions[-1](a, b))
    assert most < PEAK and (got["best_cluster"].to_numpy() == (units[:ROWS] @ units[ROWS:].T).argmax(1)).all()


def test_best_matches_are_those_of_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 8)
    monkeypatch.setattr(vectors, "STRIP_CELLS", 20)
    rng = np.random.default_rng(1)
    rows = [(f"p{i:02d}", i % 7, rng.integers(-2, 3, 3).astype(float).tolist(), START + dt.timedelta(minutes=i)) for i in range(40)]
    p = spark.createDataFrame(rows, "image_id string, similarity_cluster long, embedding array<double>, created_at timestamp")
    got = {r["image_id"]: (r["best_sim"], r["best_cluster"]) for r in vectors.best_matches(p.where("similarity_cluster < 3"), p.where("similarity_cluster >= 3"), "image_id", "embedding", "created_at").collect()}
    for name, cluster, v, _ in rows:
        if cluster < 3:
            best = max((float(np.dot(v, w)), at, c) for _, c, w, at in rows if c >= 3)
            assert got.get(name) == ((best[0], best[2]) if best[0] > 0 else None)


def test_annotate_similarity(spark, functions, units):
    vectors.annotate_similarity(posts(spark))
    part = pd.DataFrame({"k": [f"p{i:05d}" for i in range(2 * ROWS)], "c": 1, "v": list(units), "chunk": [0] * ROWS + [1] * ROWS, "i": 0, "j": 1})
    got, most = peak(lambda: functions[-1](part))
    sims = units[:ROWS] @ units[ROWS:].T
    assert most < PEAK and np.allclose(got.groupby("k")["s"].max().to_numpy(), np.concatenate([sims.max(1), sims.max(0)]))


def test_open_clusters(spark, functions, units):
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "at long, vec array<double>")
    known = spark.createDataFrame([(4, [1.0, 0.0], 0.1, 1.0), (5, [0.0, 1.0], 0.1, 1.0)], "similarity_cluster long, pivot array<double>, angle double, length double")
    assert [tuple(r) for r in uploads.open_clusters(asked, known, 0.9).collect()] == [(1, 4)]
    side = lambda asks, v, angle: pd.DataFrame({"asks": asks, "key": range(ROWS), "v": list(v), "angle": angle, "length": 1.0, "i": 0, "j": 0})
    both = [side(True, units[:ROWS], np.nan), side(False, units[ROWS:], 0.0)]
    n, most = peak(lambda: sum(len(f) for f in functions[-1](iter(both))))
    assert most < PEAK and n >= int((units[:ROWS] @ units[ROWS:].T >= 0.9).sum()) > 0


def test_nearest_members(spark, functions, units):
    asked = spark.createDataFrame([(1, [1.0, 0.0], 1)], "at long, vec array<double>, similarity_cluster long")
    uploads.nearest_members(asked, posts(spark))
    a = pd.DataFrame({"at": range(ROWS), "vec": list(units[:ROWS]), "similarity_cluster": 1})
    b = pd.DataFrame({"similarity_cluster": 1, "embedding": list(units[ROWS:]), "created_at": pd.Timestamp(START), "image_id": [f"p{i:05d}" for i in range(ROWS)]})
    got, most = peak(lambda: functions[-1](a, b))
    assert most < PEAK and np.allclose(got["sim"], (units[:ROWS] @ units[ROWS:].T).max(1))
