"""Queries whose SQL gives another result once keys or counts have more digits than the small tables show."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tessera.operators import feed
from tessera.plans.queries import QUERIES, SQL


def test_near_dupe_posts_equals_sql_with_five_digits(spark, tmp_path):
    rows = [{"vec_id": k, "embedding": [1.0 if i == k % 5 else 0.0 for i in range(5)], "label": 0} for k in (7, 9998, 9999, 10_000, 10_001, 12_345, 12_347, 123_450)]
    kind = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])
    pq.write_table(pa.Table.from_pylist(rows, kind), tmp_path / "embeddings.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet')")
    got = QUERIES["near_dupe_posts"](spark, f"file://{tmp_path}")
    want = duck.sql(SQL["near_dupe_posts"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())


def test_near_dupe_posts_tell_clusters_apart(spark):
    manifest = spark.createDataFrame([("a", 1014), ("b", 10143), ("c", 3)], "image_path string, similarity_cluster long")
    assert {r["handle"] for r in feed.near_dupe_posts(manifest, "2024-01-01").collect()} == {"@reposter1014", "@reposter10143", "@reposter0003"}


def test_p_of_a_correlation_over_many_rows(spark):
    from pyspark.sql import functions as F

    from tessera.functions.significance import correlation_p

    # Exact sums of Student's series in extended precision; the SQL of shortcut_check stops at 20,000 terms.
    known = [(0.005663812961273187, 102239, 0.07014283832200109), (0.001090756911118737, 102239, 0.7272668303263484), (0.002509525873917309, 20598, 0.7187379942868304)]
    rows = spark.createDataFrame([k[:2] for k in known], "r double, n long").withColumn("p", correlation_p(F.col("r"), F.col("n"))).collect()
    assert all(abs(r["p"] - k[2]) < 1e-9 for r, k in zip(rows, known))
