import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import fill_middle


def expected(doc_id, text, seed=1, percent=90, spm_percent=20):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(s in text for s in fill_middle.SENTINELS) or h[2] % 100 >= percent:
        return (doc_id, len(text), "plain", None, None, text)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < spm_percent else "psm"
    return (doc_id, len(text), form, a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}")


ODD = [(20, "x<P>y"), (21, "<" * 64 + "S" + "\r\n" * 64), (22, "é" * 63), (23, "z" * 64), (24, "q" * 65), (25, "a\0b" * 50), (26, "\U0001f600́" * 200), (-27, "P>S>M>" * 30)]


def test_equals_brute_force(docs, cases):
    rows = cases + ODD + [(100 + i, "αβ<" * i + "S>") for i in range(90)]
    out = fill_middle.fill_in_middle(docs(rows)).withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[-1])
    assert sorted((tuple(r)[:6] for r in out), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert sorted(r["back"] for r in out) == sorted(t or "" for _, t in rows)


@pytest.mark.parametrize("percent, spm_percent, forms", [(0, 50, {"plain"}), (100, 100, {"spm"}), (100, 0, {"psm"})])
def test_shares_are_parameters(docs, percent, spm_percent, forms):
    rows = [(i, f"text number {i}") for i in range(40)]
    out = fill_middle.fill_in_middle(docs(rows), seed=7, percent=percent, spm_percent=spm_percent).collect()
    assert {r["form"] for r in out} == forms
    assert sorted(tuple(r) for r in out) == sorted(expected(*r, 7, percent, spm_percent) for r in rows)


def test_parts_are_bounded_and_whole(docs, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fill_middle, "PART_BYTES", 100)
    sizes = [0, 60, 60, 500, 1, 1, 99]
    batch = pa.RecordBatch.from_pydict({"id": list(range(7)), "text": ["x" * n for n in sizes], "bytes": sizes})
    parts = [p["id"].to_pylist() for p in fill_middle._parts(batch)]
    assert sum(parts, []) == list(range(7)) and all(len(p) == 1 or sum(sizes[i] for i in p) <= 100 for p in parts)


def test_empty_table(docs):
    assert fill_middle.fill_in_middle(docs([]).limit(0)).collect() == []
