import random

import numpy as np
import pytest

from tessera.llm import ngram_join


def brute(rows, k, threshold):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus(seed, n=90):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choices(words, k=30))
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            text = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((i, " ".join(text)))
        else:
            rows.append((i, " ".join(rng.choices(words, k=rng.choice([2, 3, 20, 60, 120]))) + (" " + shared if rng.random() < 0.4 else "")))
    return rows


@pytest.mark.parametrize(("seed", "k", "threshold", "long_list"), [(1, 4, 85, 16), (2, 5, 80, 2)])
def test_against_brute_force(docs, monkeypatch, seed, k, threshold, long_list):
    monkeypatch.setattr(ngram_join, "LONG_LIST", long_list)
    rows = corpus(seed)
    got = [(r["id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs(rows), k=k, threshold=threshold).collect()]
    assert sorted(got, key=str) == brute(rows, k, threshold)


def test_hostile_rows(docs, cases):
    got = [(r["id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs(cases), k=4, threshold=85).collect()]
    assert sorted(got, key=str) == brute(cases, 4, 85)


def test_empty_table(docs):
    assert ngram_join.near_duplicates(docs([])).count() == 0


def test_keep_one(docs):
    base = " ".join(f"w{i}" for i in range(100))
    df = docs([(3, base), (1, base + " more"), (2, "quite another text that stands alone"), (None, base)])
    out = ngram_join.keep_one(df)
    assert out.columns == df.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "2", "None"]


def test_keep_one_decides_by_row(docs):
    base = " ".join(f"w{i}" for i in range(100))
    alone = " ".join(f"v{i}" for i in range(50))
    df = docs([(1, base), (1, base), (1, base + " more"), (None, base), (2, base), (None, alone), (None, alone + " more"), (5, None), (5, ""), (None, "")])
    out = ngram_join.keep_one(df, keep_unknown=False)
    kept = sorted((str(r["doc_id"]), (r["text"] or "")[:2]) for r in out.collect())
    assert kept == [("1", "w0"), ("5", ""), ("5", ""), ("None", ""), ("None", "v0")]


def test_keep_one_takes_any_column_names(docs):
    base = " ".join(f"w{i}" for i in range(100))
    df = docs([(3, base), (1, base + " more")])
    for name in ("_mark", "_maybe", "_maybe_at", "_maybe_block", "_gone_id", "_gone_mark", "stay", "component", "mark", "sig"):
        df = df.withColumn(name, df["n"] + 4)
    out = ngram_join.keep_one(df)
    assert out.columns == df.columns and [(r["doc_id"], r["_maybe"], r["stay"]) for r in out.collect()] == [(1, 5, 5)]


def test_parities_never_rule_out_linked_sets():
    rng = np.random.default_rng(0)
    for n in (5, 40, 300):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 10], rng.integers(0, 1 << 63, n // 8, dtype=np.uint64)]))
        bits = sum(bin((x ^ y) & ((1 << 64) - 1)).count("1") for x, y in zip(ngram_join.parity(a), ngram_join.parity(b)))
        assert bits <= len(np.setxor1d(a, b)) and (bits - len(np.setxor1d(a, b))) % 2 == 0


def test_counts_are_added_over_tasks(spark):
    df = spark.createDataFrame([(" ".join(f"w{i % 7}" for i in range(400)),)] * 6 + [("a b c d",), (None,)], "text string").repartition(4)
    rank = ngram_join.count_cells(df, "text", 4, 1 << 10)
    words = ngram_join._Words()
    want = np.zeros(1 << 10, np.int64)
    for t in [r["text"] for r in df.collect()]:
        want += np.bincount(ngram_join._cell(ngram_join.shingle_set(t, 4, words), 1 << 10), minlength=1 << 10)
    assert (rank == np.round(256 * np.log2(1 + want))).all()
