import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing, sharding


def padding(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_boundaries_are_optimal(histogram, k):
    lengths, counts = list(histogram), list(histogram.values())
    ends = packing.optimal_boundaries(lengths, counts, k)
    top = max(lengths)
    best = min(padding(lengths, counts, [*c, top]) for r in range(min(k, len(lengths))) for c in itertools.combinations([x for x in lengths if x != top], r))
    assert ends == sorted(set(ends)) and len(ends) <= k and ends[-1] == top and padding(lengths, counts, ends) == best


def test_packing_covers_whole_texts(docs, cases):
    out = packing.pack(docs(cases), buckets=4, max_length=1000, budget=4000).collect()
    words = defaultdict(list)
    for i, t in cases:
        words[i].append(len((t or "").encode().split()))
    for i, ns in words.items():
        own = [r for r in out if r["id"] == i]
        assert sum(r["length"] for r in own) == sum(ns) and all(r["length"] <= r["boundary"] for r in own)
    batches = defaultdict(list)
    for r in out:
        batches[r["bucket"], r["pack_group"], r["batch"]].append(r)
    for rows in batches.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and (len(rows) == 1 or len(rows) * rows[0]["boundary"] <= 4000)
    assert packing.pack(docs([])).count() == 0


def test_shards_balance_and_keep_groups(docs):
    rng = np.random.default_rng(0)
    rows = [(i, f"t{i % 300} " + "w " * int(rng.integers(1, 200) if i % 300 > 5 else 3)) for i in range(600)] + [(1000 + i, "copy") for i in range(50)]
    out = sharding.assign(docs(rows), shards=4, parcels=64).collect()
    assert len(out) == len(rows)
    shards, text = defaultdict(list), dict(rows)
    where = defaultdict(set)
    for r in out:
        shards[r["shard"]].append(r)
        where[text[r["id"]]].add(r["shard"])
        assert r["size"] == len(text[r["id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["id"]].encode())
    assert all(len(s) == 1 for s in where.values())
    sizes = [sum(r["size"] for r in s) for s in shards.values()]
    assert max(sizes) <= 1.05 * min(sizes) and all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in shards.values())


def test_a_group_too_large_for_a_shard_is_spread(docs):
    out = sharding.assign(docs([(i, "same") for i in range(400)] + [(1000 + i, f"other {i}") for i in range(400)]), shards=4, parcels=64).collect()
    counts = np.bincount([r["shard"] for r in out], minlength=4)
    assert counts.max() - counts.min() <= 40


def test_hostile_rows(docs, cases):
    out = sharding.assign(docs(cases), shards=3).collect()
    assert len(out) == len(cases) and sharding.assign(docs([])).count() == 0
    assert {r["size"] for r in out if r["id"] in (3, 4)} == {1}


def test_written_shards_hold_all_rows(spark, docs, tmp_path):
    rows = [(i, f"t {i}") for i in range(50)]
    sharding.write_shards(docs(rows).drop("shard"), f"file://{tmp_path}/out", shards=3)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 50


@pytest.mark.parametrize("shards", [1, 5])
def test_place_is_deterministic(shards):
    v = np.random.default_rng(1).random((100, 3))
    assert (sharding.place(v, shards) == sharding.place(v, shards)).all()


def test_a_group_that_fits_into_a_shard_is_not_split():
    import pandas as pd

    # Of 1,600 rows in 16 shards, one group has 80.
    heavy = [(True, 1, c, 10, 10, 10) for c in range(8)]
    units = pd.DataFrame(heavy + [(False, u, 0, 10, 10, 10) for u in range(152)], columns=["heavy", "unit", "chunk", "size", "tokens", "rows"])
    placed = sharding._place_units(units, 16)
    assert placed[placed["heavy"]]["shard"].nunique() == 1 and (units.groupby(placed["shard"])["rows"].sum() == 100).all()


def test_written_shards_with_repeated_ids_and_any_columns(spark, docs, tmp_path):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, None), (None, ""), (2, "c d"), (2, "c d")]
    df = docs(rows)
    for name in ("_mark", "_at", "_own_id", "_slot", "_shard", "slot", "at"):
        df = df.withColumn(name, df["n"] + 4)
    sharding.write_shards(df, f"file://{tmp_path}/out", shards=3)
    out = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(rows, key=str)
    assert set(df.drop("shard").columns) <= set(out.columns)


def test_packed_ids_are_whole(spark):
    rows = [(1, list(range(25))), (2, []), (3, None), (4, [7] * 10)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    out = packing.pack(df, buckets=2, max_length=10, budget=40, tokens_col="ids").collect()
    for i, ids in rows:
        own = sorted((r["segment"], r["tokens"]) for r in out if r["id"] == i)
        assert sum((t for _, t in own), []) == (ids or []) and all(len(t) <= 10 for _, t in own)
    assert all(r["length"] == len(r["tokens"]) for r in out)


def test_letters_without_spaces_are_tokens(docs):
    out = packing.pack(docs([(1, "漢字 and かな"), (2, "plain words")])).collect()
    assert {r["id"]: r["length"] for r in out} == {1: 5, 2: 2}
