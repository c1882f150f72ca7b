"""Uploads against a replay that takes one row after the other."""

import datetime as dt
import random

import numpy as np

from tessera.functions import images
from tessera.streaming import uploads
from tessera.streaming.store import BucketStore

START = dt.datetime(2024, 1, 1)
BATCH = "image_id string, handle string, ai_probability double, created_at timestamp, embedding array<double>, image_sha256 string, mime string, size long"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def post(i, cluster, vector, sha, p=0.3, minutes=0):
    return {"image_id": i, "handle": "@x", "ai_probability": p, "similarity_cluster": cluster, "similarity_score": 0.0, "repetition_score": 0.0, "diversity_label": "original", "created_at": at(minutes), "embedding": vector, "image_sha256": sha}


def upload(i, vector, sha, p=0.3, minutes=0, mime="image/png", size=5):
    return (i, "@z", p, at(minutes), vector, sha, mime, size)


def unit(*v):
    return [float(x) for x in np.array(v) / np.linalg.norm(v)]


def replay(stored, batch, threshold):
    """The posts after uploads that come one at a time."""
    posts, last = [dict(p) for p in stored], max((p["similarity_cluster"] for p in stored), default=-1)
    touched = set()
    for i, handle, p, created, vector, sha, mime, size in sorted(batch, key=lambda u: (u[3], u[0])):
        if mime and mime not in uploads.MIME_TYPES or not size or size > uploads.MAX_BYTES or any(q["image_id"] == i for q in posts):
            continue
        newest = lambda q: (q["created_at"], q["image_id"])
        same = max((q for q in posts if sha is not None and q["image_sha256"] == sha), key=newest, default=None)
        if same:
            cluster, score, vector = same["similarity_cluster"], 1.0, same["embedding"]
        else:
            seen = [(round(float(np.dot(vector, q["embedding"])), 12), *newest(q), q["similarity_cluster"]) for q in posts if vector and q["embedding"]]
            best = max(seen, default=(0.0, None, None, None))
            cluster, score = (best[3], best[0]) if best[0] > 0 and best[0] >= threshold else (None, max(0.0, best[0]))
            if cluster is None:
                last += 1
                cluster = last
        p = max([p] + [q["ai_probability"] for q in posts if q["similarity_cluster"] == cluster])
        posts.append(post(i, cluster, vector, sha, p) | {"handle": handle, "created_at": created, "similarity_score": round(score, 4)})
        touched.add(cluster)
    for cluster in touched:
        members = [q for q in posts if q["similarity_cluster"] == cluster]
        ai = any(q["ai_probability"] >= 0.5 for q in members)
        for q in members:
            n = len(members)
            q["repetition_score"] = 0.0 if n <= 1 else round(min(0.99, 0.7 + 0.1 * (n - 2)), 2)
            q["diversity_label"] = "original" if q["ai_probability"] < 0.5 else "repeated_synthetic" if n > 1 and ai else "unique_ai"
            if q["embedding"]:
                q["similarity_score"] = round(max([0.0] + [float(np.dot(q["embedding"], o["embedding"])) for o in members if o is not q and o["embedding"]]), 4)
    return posts


def facts(rows):
    return sorted((r["image_id"], r["similarity_cluster"], round(r["ai_probability"], 9), r["repetition_score"], r["diversity_label"], round(r["similarity_score"] or 0.0, 3), r["image_sha256"] or "") for r in rows)


def table(spark, rows):
    return spark.createDataFrame(rows, BATCH)


def stored_table(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in uploads.COLUMNS) for r in rows], uploads.POSTS)


def test_equal_new_uploads_of_a_batch_share_a_cluster(spark):
    stored = [post("a", 5, unit(1, 0, 0), "h1")]
    batch = [upload("u1", unit(0, 1, 0), "same", minutes=1), upload("u2", unit(0, 1, 0), "same", minutes=2), upload("u3", None, "alone", minutes=3), upload("u4", None, "alone", 0.9, minutes=4)]
    got = {r["image_id"]: r for r in uploads.apply_batch(table(spark, batch), stored_table(spark, stored), 0.9).collect()}
    assert got["u1"]["similarity_cluster"] == got["u2"]["similarity_cluster"] == 6 and got["u2"]["similarity_score"] == 1.0
    assert got["u3"]["similarity_cluster"] == got["u4"]["similarity_cluster"] == 7 and got["u4"]["similarity_score"] == 1.0
    assert got["u3"]["diversity_label"] == "original" and got["u4"]["diversity_label"] == "repeated_synthetic"


def draw(seed, n_stored, n_batch, prefix="u", start=1000):
    rng = random.Random(seed)
    vectors = [unit(*v) for v in np.random.default_rng(seed).normal(size=(6, 3))]
    near = lambda: None if rng.random() < 0.15 else unit(*(np.array(rng.choice(vectors)) + 0.25 * np.array([rng.gauss(0, 1) for _ in range(3)])))
    stored = [post(f"s{i}", i // 2, near(), f"h{rng.randrange(40)}", rng.random(), i) for i in range(n_stored)]
    batch = [upload(f"{prefix}{i}", near(), rng.choice([None, f"h{rng.randrange(40)}", f"n{rng.randrange(20)}"]), rng.random(), start + rng.randrange(30), rng.choice(["image/png", None, "", "text/html"]), rng.choice([5, 5, 5, 0, None, 99_999_999])) for i in range(n_batch)]
    return stored, batch


def test_a_batch_equals_a_replay_row_by_row(spark, monkeypatch, seed=2, blocks=5):
    from tessera.operators import vectors

    monkeypatch.setattr(uploads, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", blocks)
    stored, batch = draw(seed, 30, 60)
    batch += [batch[0], batch[1]]  # delivered twice
    got = uploads.apply_batch(table(spark, batch), stored_table(spark, stored), 0.9).collect()
    assert facts(got) == facts(replay(stored, batch, 0.9))


def test_a_chain_is_followed_to_its_end(spark):
    steps = [unit(np.cos(i * 0.2), np.sin(i * 0.2)) for i in range(14)]  # each is near its neighbours only
    batch = [upload(f"u{i:02}", v, f"h{i}", i / 20, minutes=i) for i, v in enumerate(steps)]
    got = uploads.apply_batch(table(spark, batch), stored_table(spark, [post("s", 3, unit(0, -1), "x")]), 0.97).collect()
    assert facts(got) == facts(replay([post("s", 3, unit(0, -1), "x")], batch, 0.97))
    assert {r["similarity_cluster"] for r in got if r["image_id"] != "s"} == {4}


def test_store_writes_touched_buckets_only_and_replays_count_once(spark, tmp_path):
    stored, first = draw(3, 24, 6, "a")
    second = draw(4, 0, 10, "b", 2000)[1] + first
    store = uploads.PostsStore(spark, f"file://{tmp_path}/store", 0.95, buckets=16)
    store.create(stored_table(spark, stored))
    store.apply(table(spark, first), 0)
    before, after = store.versions(0), store.versions(1)
    new = {r["image_id"]: r["similarity_cluster"] for r in store.posts(1).collect()}
    changed = {b for (t, b), v in after.items() if t == "posts" and v == 1}
    valid = {new[u[0]] for u in first if u[0] in new}
    assert valid and len(changed) <= len(valid) and any(before.get(k) == v for k, v in after.items())
    store.apply(table(spark, second), 1)  # holds the first batch once more
    once = facts(store.posts(2).collect())
    store.apply(table(spark, second), 1)  # the same batch again
    assert facts(store.posts(2).collect()) == once
    expected = replay(replay(stored, first, 0.95), second, 0.95)
    assert once == facts(expected)
    kept = {r["similarity_cluster"]: (r["n"], r["top"]) for r in store.read("clusters", 2).collect()}
    assert kept == {c: (sum(q["similarity_cluster"] == c for q in expected), max(q["ai_probability"] for q in expected if q["similarity_cluster"] == c)) for c in {q["similarity_cluster"] for q in expected}}
    for n in range(2):
        store.forget(n, n + 1)
    assert facts(store.posts(2).collect()) == once
    listed = {(t, b, v) for (t, b), v in store.versions(2).items()}
    there = {(p.parts[-3], int(p.parts[-1][7:]), int(p.parts[-2][2:])) for p in (tmp_path / "store").glob("*/v=*/bucket=*")}
    assert there == listed


def test_empty_batches_and_an_empty_store(spark, tmp_path):
    store = uploads.PostsStore(spark, f"file://{tmp_path}/store", 0.9, buckets=2)
    store.create(stored_table(spark, [post("a", 1, None, None)]).limit(0))
    nothing = table(spark, [upload("u", None, "h")])
    store.apply(nothing.limit(0), 0)
    store.apply(nothing.where("false"), 1)
    store.apply(table(spark, [upload("u", None, "h"), upload("w", unit(1, 0), None)]), 2)
    assert [(r["image_id"], r["similarity_cluster"]) for r in sorted(store.posts(3).collect())] == [("u", 0), ("w", 1)]


def test_buckets_keep_other_versions(spark, tmp_path):
    store = BucketStore(spark, f"file://{tmp_path}/b", {"t": ("k long, v string", "k")}, buckets=4)
    store.publish(0, {"t": spark.createDataFrame([(i, "old") for i in range(20)], "k long, v string")})
    touched = store.touched(spark.createDataFrame([(3,)], "k long"), "t")
    rows = store.read("t", 0, touched)
    store.publish(1, {"t": rows.withColumn("v", uploads.F.lit("new"))}, before=0)
    have = {r["k"]: r["v"] for r in store.read("t", 1).collect()}
    assert len(touched) == 1 and set(have) == set(range(20)) and {k for k, v in have.items() if v == "new"} == {r["k"] for r in rows.collect()}
    assert {r["v"] for r in store.read("t", 0).collect()} == {"old"}


def test_files_become_uploads(spark):
    png = bytearray(images.encode_png(np.zeros((4, 5, 3), np.uint8)))
    rows = [("a", "@x", "my_fake.png", "image/png", png, at(0), None, None), ("b", "@x", "cat.png", "image/png", png, at(0), 0.7, None), ("c", "@x", None, "image/png", bytearray(b"no image"), at(0), None, None), ("d", "@x", "x.gif", "text/plain", None, at(0), None, None), ("e", "@x", "x.png", None, None, at(0), None, None)]
    got = {r["image_id"]: r for r in uploads.prepare_uploads(spark.createDataFrame(rows, "image_id string, handle string, filename string, mime string, content binary, created_at timestamp, score double, embedding array<double>")).collect()}
    assert [(got[i]["ai_probability"], got[i]["analysis_mode"], got[i]["reason"]) for i in "abcde"] == [(0.82, "mock", None), (0.7, "model", None), (0.15, "mock", "unreadable"), (0.15, "mock", "unsupported_type"), (0.15, "mock", "empty")]
    assert got["a"]["image_sha256"] == got["b"]["image_sha256"] and got["a"]["size"] == len(png)
