"""The posts that a service starts with: seeds, their vectors and scores, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scoring import ROBUST_SEED, attach_embeddings, attach_scores, confidence, robustness
from tessera.operators.feed import near_dupe_posts, recalculate_clusters, seed_posts
from tessera.operators.vectors import annotate_similarity

SEED = "image_id string, account_id string, handle string, thumbnail_url string, ai_probability double, similarity_cluster long, repetition_score double, diversity_label string, created_at timestamp, image_sha256 string"
DUPES = "image_path string, similarity_cluster long"


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seeds from a JSON file that holds a list of posts, or an object with the list as ``posts``; posts without an id are left out."""
    raw = spark.read.schema(f"{SEED}, posts array<struct<{SEED}>>").option("multiLine", "true").json(path)
    listed = raw.select(F.explode("posts").alias("s")).select("s.*")
    return raw.drop("posts").unionByName(listed).where("image_id is not null")


def read_dupes(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of near copies: image_path, similarity_cluster."""
    return spark.read.schema(DUPES).option("header", "true").csv(path).where("image_path is not null and similarity_cluster is not null")


def seeds_of_files(files: DataFrame, dupes: DataFrame, start: str) -> DataFrame:
    """``SEED`` columns of seeds from ``files`` (name, is_fake, path, image_sha256) and of near copies in ``dupes`` whose file is among them."""
    url = lambda c: F.concat(F.lit("/static/demo/"), F.replace(F.replace(F.call_function("url_encode", c), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")))
    by_name = files.select("name", "path", "image_sha256")
    made = seed_posts(files.where("is_fake is not null").select("name", "is_fake"), start).join(by_name, "name", "left").withColumn("thumbnail_url", url(F.col("path")))
    known = files.select(F.col("path").alias("image_path"), "image_sha256")
    copies = near_dupe_posts(dupes.join(known.select("image_path"), "image_path", "left_semi"), start).join(known, "image_path", "left")
    copies = copies.withColumn("thumbnail_url", url(F.col("image_path"))).withColumn("account_id", F.concat(F.lit("demo-dupe-"), F.col("similarity_cluster").cast("string")))
    names = [c.split()[0] for c in SEED.split(", ")]
    return made.select(names).unionByName(copies.select(names))


def start_posts(seeds: DataFrame, vectors: DataFrame, scores: DataFrame, overrides: DataFrame, score_seeds: bool = True, threshold: float = 0.5) -> DataFrame:
    """``seeds`` as the first state: vectors and scores attached from the caches (key, ...), overrides last, then every cluster recalculated and annotated.

    Without a vector a post keeps the similarity it came with, or 0.
    """
    rows = attach_embeddings(seeds, vectors).withColumn("confidence", confidence(F.col("ai_probability"))).withColumn("analysis_mode", F.lit("demo_fixture"))
    if score_seeds:
        rows = attach_scores(rows, scores, overrides)
    rows = rows.withColumn("robustness", robustness(F.col("ai_probability"), ROBUST_SEED))
    return annotate_similarity(recalculate_clusters(rows, threshold)).withColumn("is_seed", F.lit(True))
