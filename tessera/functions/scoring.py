"""Scores of single rows: the small head, labels, confidence, heuristics, attached caches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the score falls by under each perturbation, and the words of the file-name rule.
ROBUST_SEED = {"compressed": 0.02, "cropped": 0.05, "blurred": 0.08, "recolored": 0.03}
ROBUST_UPLOAD = {"compressed": 0.0, "cropped": 0.03, "blurred": 0.06, "recolored": 0.02}
FILENAME_WORDS = ("fake", "synthetic", "generated", "ai")
FILENAME_HIT, FILENAME_MISS = 0.82, 0.15
REPEATED, UNIQUE, ORIGINAL = "repeated_synthetic", "unique_ai", "original"


def mlp_head(vector: Column, w1: list[list[float]], b1: list[float], w2: list[float], b2: float, temperature: float = 1.0) -> Column:
    """sigmoid(linear(relu(linear(vector))) / temperature) as one SQL expression, for small heads."""
    total = F.lit(float(b2))
    for row, bias, out in zip(w1, b1, w2):
        weights = F.array(*[F.lit(float(x)) for x in row])
        hidden = F.aggregate(F.zip_with(vector, weights, lambda x, w: x.cast("double") * w), F.lit(float(bias)), lambda s, x: s + x)
        total = total + F.greatest(hidden, F.lit(0.0)) * F.lit(float(out))
    return 1 / (1 + F.exp(-total / F.lit(float(temperature))))


def mlp_head_batch(df: DataFrame, vector: str, w1, b1, w2, b2: float, temperature: float = 1.0, out: str = "p") -> DataFrame:
    """The same head for wide layers: matrix products over Arrow batches, weights sent once."""
    kept = df.sparkSession.sparkContext.broadcast(tuple(np.asarray(x, float) for x in (w1, b1, w2)))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a, c, w = kept.value
        for x in batches:
            z = np.maximum(np.stack(x.to_numpy()).astype(float) @ a.T + c, 0) @ w + b2 if len(x) else np.zeros(0)
            yield pd.Series(1 / (1 + np.exp(-z / temperature)))

    return df.withColumn(out, score(F.col(vector)))


def label_for(p: Column, repeated: Column, threshold: float = 0.5) -> Column:
    return F.when(p >= threshold, F.when(repeated, F.lit(REPEATED)).otherwise(F.lit(UNIQUE))).otherwise(F.lit(ORIGINAL))


def confidence(p: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(p - 0.5) * 2)


def robustness(p: Column, falls: dict[str, float] | None = None) -> Column:
    return F.struct(*[F.greatest(F.lit(0.0), p - fall).alias(name) for name, fall in (falls or ROBUST_SEED).items()])


def filename_heuristic(name: Column) -> Column:
    hit = F.lit(False)
    for word in FILENAME_WORDS:
        hit = hit | F.lower(name).contains(word)
    return F.when(hit, F.lit(FILENAME_HIT)).otherwise(F.lit(FILENAME_MISS))


def local_key(url: Column, prefix: str = "/static/demo/") -> Column:
    """The decoded path behind the static prefix; null for other addresses."""
    return F.when(url.startswith(prefix), F.call_function("url_decode", F.replace(F.substring(url, len(prefix) + 1, 1 << 20), F.lit("+"), F.lit("%2B"))))


def attach_scores(posts: DataFrame, cache: DataFrame, overrides: DataFrame) -> DataFrame:
    """``posts`` with scores from ``cache`` (key, score; for REAL/ and FAKE/ keys only), then ``overrides`` (image_id, score)."""
    keyed = posts.withColumn("_key", local_key(F.col("thumbnail_url")))
    keyed = keyed.withColumn("_key", F.when(F.col("_key").startswith("REAL/") | F.col("_key").startswith("FAKE/"), F.col("_key")))
    joined = keyed.join(cache.select(F.col("key").alias("_key"), F.col("score").alias("_cached")), "_key", "left").join(overrides.select("image_id", F.col("score").alias("_forced")), "image_id", "left")
    new = F.coalesce("_forced", "_cached")
    return (
        joined.withColumn("ai_probability", F.when(new.isNotNull(), F.round(new, 6)).otherwise(F.col("ai_probability")))
        .withColumn("confidence", F.when(new.isNotNull(), confidence(new)).otherwise(F.col("confidence")))
        .withColumn("analysis_mode", F.when(new.isNotNull(), F.lit("model")).otherwise(F.col("analysis_mode")))
        .drop("_key", "_cached", "_forced")
    )


def attach_embeddings(posts: DataFrame, cache: DataFrame) -> DataFrame:
    """``posts`` with ``embedding`` from ``cache`` (key, embedding); null where it has none."""
    return posts.withColumn("_key", local_key(F.col("thumbnail_url"))).join(cache.select(F.col("key").alias("_key"), "embedding"), "_key", "left").drop("_key")
