"""Domain views over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scoring import label_for
from tessera.operators.clusters import cluster_threshold
from tessera.operators.splits import hash_split

#: Cosine at which the driver's vectors have clusters.
THRESHOLD = 0.40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as media records: content key, label, split, path."""
    d = table(spark, sf_dir, "documents")
    path = F.col("doc_id").cast("string")
    return d.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), (F.substring("source", 4, 9).cast("int") % 2).alias("label"), hash_split(path).alias("split"), "source", "lang", "n_chars")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("path"), (F.substring("source", 4, 9).cast("int") % 2).alias("label"), F.col("source").alias("generator"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a score table with many ties."""
    p = (F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), 16, 10).cast("long") % 100) / 100
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("generator"), "n_chars")
    return table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"), p.alias("p")).join(d, "doc_id")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as posts of the account that their label names."""
    v = vectors(spark, sf_dir)
    c = cluster_threshold(v, THRESHOLD).select("vec_id", F.col("component").alias("similarity_cluster"))
    p = F.round(1 / (1 + F.exp(-8 * F.col("embedding")[0].cast("double"))), 6)
    rows = v.join(c, "vec_id").withColumn("ai_probability", p)
    return rows.select(
        F.format_string("post_%06d", "vec_id").alias("image_id"), "vec_id", F.concat(F.lit("acct"), F.col("label").cast("string")).alias("account_id"), F.concat(F.lit("@u"), F.col("label").cast("string")).alias("handle"),
        F.concat(F.lit("/static/demo/"), F.when(F.col("vec_id") % 2 == 0, "REAL/").otherwise("FAKE/"), F.col("vec_id").cast("string"), F.lit(".png")).alias("thumbnail_url"),
        "ai_probability", F.round((F.col("vec_id") % 7) / 10, 2).alias("repetition_score"), label_for(F.col("ai_probability"), F.col("vec_id") % 3 == 0).alias("diversity_label"),
        "similarity_cluster", F.round((F.col("vec_id") % 11) / 10, 4).alias("similarity_score"),
        F.timestamp_micros(F.lit(1704067200_000000) + F.col("vec_id") * 60_000_000).alias("created_at"), "embedding", F.sha2(F.col("vec_id").cast("string"), 256).alias("image_sha256"),
    )


def feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("event_type") == "error", "repeated_synthetic").when(F.col("event_type").isin("purchase", "signup"), "unique_ai").otherwise("original")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("image_id"), F.col("user_id").cast("string").alias("handle"), label.alias("diversity_label"), F.col("ts").cast("timestamp").alias("ts"))
