import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann_hnsw

NAN, INF = float("nan"), float("inf")


def exact(rows, k, asked):
    """All of the best ``k`` by brute force in double precision, ties to the smaller id."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dims = max(len(v) for _, v in good)
    good = [(i, np.pad(v, (0, dims - len(v)))) for i, v in good]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in sorted({i for i in ids if asked(i)}):
        own = min((tuple(v) for j, v in good if j == i))
        s = unit @ (np.array(own) / np.linalg.norm(own))
        out[int(i)] = sorted(((-s[j], int(ids[j])) for j in range(len(ids)) if ids[j] != i))[:k]
    return out


def recall(found, want):
    hits = sum(len({i for _, i in best} & {r["vec_id"] for r in found if r["query_id"] == q}) for q, best in want.items())
    return hits / sum(map(len, want.values()))


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2.0, "y", 3) for i, v in rows], "vec_id long, embedding array<double>, shard int, id string, v double, mark string, kind int")


def unit_rows(x, start=0):
    return [(start + i, [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("shape", ["spread", "clusters", "near copies"])
def test_recall_over_several_shards(spark, monkeypatch, shape):
    monkeypatch.setattr(ann_hnsw, "rows_per_shard", lambda n, dims: 700)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2500, 24))
    if shape == "clusters":
        x = rng.normal(size=(30, 24))[rng.integers(0, 30, 2500)] + 0.05 * x
    if shape == "near copies":
        x[:900] = x[0] + 0.001 * x[:900]
    rows = unit_rows(x[rng.permutation(2500)])
    found = ann_hnsw.nearest_neighbours(table(spark, rows), F.col("vec_id") % 50 == 0).collect()
    want = exact(rows, 5, lambda i: i % 50 == 0)
    assert recall(found, want) >= 0.95
    score = {(q, i): -s for q, best in exact(rows, 2500, lambda i: i % 50 == 0).items() for s, i in best}
    by = {}
    for r in found:
        assert abs(r["score"] - score[r["query_id"], r["vec_id"]]) < 1e-12
        by.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    assert len(by) == 50
    for best in by.values():
        best.sort()
        assert [b[0] for b in best] == [1, 2, 3, 4, 5] and best == sorted(best, key=lambda b: b[1:])


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    copies = [(1000 + i, [3.0, 4.0, 0.0]) for i in range(400)]  # one vector, many rows: ties go to the smaller id
    rows = unit_rows(rng.normal(size=(60, 3))) + copies
    rows += [(2000, None), (2001, []), (2002, [0.0, 0.0, 0.0]), (2003, [1.0, None, 0.0]), (2004, [NAN, 1.0, 1.0]), (2005, [INF, 1.0, 1.0]), (None, [1.0, 0.0, 0.0])]
    rows += [(2050, [1e300, 1e300, 0.0]), (2051, [1e-300, 0.0, 0.0]), (2052, [2.0, 1.0]), (1000, [3.0, 4.0, 0.0]), (50, [0.0, 1.0, 0.5])]
    found = ann_hnsw.nearest_neighbours(table(spark, rows), F.col("vec_id") % 50 == 0).collect()
    scaled = [(i, [c / 1e300 for c in v] if i == 2050 else [c * 1e300 for c in v] if i == 2051 else v) for i, v in rows]
    want = exact(scaled, 5, lambda i: i % 50 == 0)
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]], q
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], atol=1e-12)


def test_few_rows_and_empty_table(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])]
    found = ann_hnsw.nearest_neighbours(table(spark, rows), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert ann_hnsw.nearest_neighbours(table(spark, rows[:1]), F.lit(True)).collect() == []
    assert ann_hnsw.nearest_neighbours(table(spark, rows).limit(0), F.lit(True)).collect() == []


def test_query_finds_the_nearest(spark):
    sf = "/root/testdata/sf0.001"
    found = ann_hnsw.op13_ann(spark, sf).collect()
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = exact(rows, 5, lambda i: i % 50 == 0)
    assert recall(found, want) >= 0.9 and len(found) == sum(map(len, want.values()))


def test_shards_grow_with_the_table_within_bounds():
    assert [ann_hnsw.rows_per_shard(n, 64) for n in (0, 10**4, 10**6, 10**9)] == [4096, 4096, 62500, 131072]
    assert ann_hnsw.rows_per_shard(10**9, 4096) * 4096 <= ann_hnsw.HELD
