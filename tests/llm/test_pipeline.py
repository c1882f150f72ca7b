import corpus_pipeline


def test_stages_keep_clean_documents(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, base, "en", "s", 1), (2, base.upper(), "en", "s", 2), (3, base + " tail", "en", "s", 3), (4, "mail jo.1@a.example.com please now ok", "en", "s", 4), (5, None, None, None, None), (6, "quite clean and alone here", "en", "s", 6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = []
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        docs = step(spark, docs, f"file://{tmp_path}")
        docs.write.parquet(f"file://{tmp_path}/out{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/out{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        kept.append(sorted(r["doc_id"] for r in docs.select("doc_id").distinct().collect()))
    assert kept == [[1, 2, 3, 4, 5, 6], [1, 3, 4, 5, 6], [1, 4, 5, 6], [1, 4, 5, 6], [1, 4, 5, 6]]
    assert "jo.1@a" not in spark.read.parquet(f"file://{tmp_path}/out3").where("doc_id = 4").first()["text"]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()) == [1, 4, 5, 6]
