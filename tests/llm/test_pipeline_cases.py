"""Every stage on empty, long, repeated and clashing rows."""

import pytest

import corpus_pipeline
from corpus_pipeline import STAGES

CLASHES = "_toxicity string, score string, kind string, unit string, token string, digest string, component_id string, id string, ids string, bucket string, shard string, text_ string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
N = len(CLASHES.split(", "))
TEXTS = [(1, "Same Text of a page"), (2, "same text of a page"), (2, "same text of a page"), (3, None), (4, ""), (None, "no id here"), (None, None), (5, "word " * 60_000), (6, " \n\t"), (7, "é" * 300_000)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", len(t) if t else None, *(["x"] * N)) for i, t in rows], SCHEMA)


@pytest.fixture
def folder(spark, tmp_path):
    def make(labels):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"file://{tmp_path}/labels.parquet")
        return f"file://{tmp_path}"

    return make


def test_stages_on_an_empty_table(spark, folder):
    sf = folder([])
    empty = table(spark, TEXTS).limit(0)
    for name, step in STAGES:
        out = step(spark, empty, sf)
        assert out.collect() == [], name
        if name != STAGES[-1][0]:
            assert out.columns == empty.columns, name


def test_stages_on_odd_rows(spark, folder):
    sf = folder([])
    kept = {"toxicity": 10, "exact_dedup": 6, "ngram_join": 10, "pii": 10}
    docs = table(spark, TEXTS)
    for name, step in STAGES[:-1]:
        out = step(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        if name == "ngram_join":  # equal word sequences are near copies too
            assert {r["doc_id"] for r in rows} >= {3, 4, 5, 6, 7}, name
        else:
            assert len(rows) == kept[name], name
        assert all(r["score"] == "x" and r["unit"] == "x" for r in rows)
    packed = STAGES[-1][1](spark, docs.where("length(text) < 1000 or text is null"), sf).select("doc_id").collect()
    assert {r["doc_id"] for r in packed} == {1, 2, 3, 4, 6, None}


@pytest.mark.parametrize("toxic", [0, 1])
def test_labels_of_one_class_drop_nothing(spark, folder, toxic):
    docs = table(spark, TEXTS)
    assert corpus_pipeline.drop_toxic(spark, docs, folder([(i, 1, toxic) for i in range(9)])).count() == len(TEXTS)
