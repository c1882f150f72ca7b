"""Clusters from similarity edges, repetition scores, and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.operators.vectors import similar_pairs
from tessera.plans.ordinals import number_rows
from tessera.plans.scratch import stage


def label_components(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``key, component``: the smallest key each node is linked with, itself included."""
    found = connected_components(edges)
    joined = nodes.select(key).join(found, F.col(key) == F.col("node"), "left")
    return joined.select(key, F.coalesce("component", F.col(key)).alias("component"))


def dense_ids(labelled: DataFrame, component: str = "component", name: str = "similarity_cluster") -> DataFrame:
    """Components as 0, 1, 2 ... in the order of their smallest key."""
    ids = number_rows(labelled.select(component).distinct(), F.col(component), name=name)
    return labelled.join(ids, component)


def cluster_threshold(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, component, similarity_cluster`` by connected components of pairs at ``threshold``."""
    return dense_ids(label_components(vectors, similar_pairs(vectors, threshold, key, vector), key))


def cluster_dbscan(vectors: DataFrame, eps: float = 0.15, min_samples: int = 2, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, component``: DBSCAN on cosine distance; noise points are clusters of their own.

    A point is core with ``min_samples`` points within ``eps``, itself counted. A
    border point joins the lowest cluster of a core neighbour.
    """
    pairs = stage(similar_pairs(vectors, 1 - eps, key, vector).select("src", "dst"), "pairs")
    if min_samples <= 2:
        return label_components(vectors, pairs, key)
    both = pairs.union(pairs.select(F.col("dst"), F.col("src")))
    core = both.groupBy("src").agg((F.count(F.lit(1)) + 1).alias("n")).where(F.col("n") >= min_samples).select(F.col("src").alias("core"))
    core = stage(core, "core")
    inner = pairs.join(core, F.col("src") == F.col("core"), "left_semi").join(core, F.col("dst") == F.col("core"), "left_semi")
    labels = label_components(core.select(F.col("core").alias(key)), inner, key)
    border = both.join(core, F.col("src") == F.col("core"), "left_anti").join(labels, F.col("dst") == F.col(key)).groupBy("src").agg(F.min("component").alias("component"))
    known = labels.unionByName(border.select(F.col("src").alias(key), "component")).select(F.col(key).alias("_k"), "component")
    return vectors.select(key).join(known, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("component", F.col(key)).alias("component"))


def cluster_images(vectors: DataFrame, method: str = "threshold", threshold: float = 0.9, eps: float = 0.15, min_samples: int = 2, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Either method, with dense cluster ids."""
    if method == "threshold":
        return cluster_threshold(vectors, threshold, key, vector)
    if method == "dbscan":
        return dense_ids(cluster_dbscan(vectors, eps, min_samples, key, vector))
    raise ValueError(f"unknown clustering method: {method}")


def corpus_repetition(labelled: DataFrame, cluster: str = "component") -> DataFrame:
    """``repetition_score``: the cluster's other members as a share of the corpus."""
    n = labelled.count()
    sizes = labelled.groupBy(cluster).agg(F.count(F.lit(1)).alias("_m"))
    return labelled.join(sizes, cluster).withColumn("repetition_score", (F.col("_m") - 1) / F.lit(float(max(1, n)))).drop("_m")


def cluster_repetition(size: Column) -> Column:
    """0 for a cluster of one, else 0.7 and 0.1 more for each member beyond two, up to 0.99."""
    return F.when(size <= 1, F.lit(0.0)).otherwise(F.round(F.least(F.lit(0.99), F.lit(0.7) + F.lit(0.1) * (size - 2)), 2))


def group_repetition(size: Column) -> Column:
    return F.when(size > 0, F.round((size - 1) / size, 2)).otherwise(F.lit(0.0))


def ramp_repetition(k: Column) -> Column:
    return F.least(F.lit(0.94), F.lit(0.35) + F.lit(0.12) * k)


def _choose2(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


def pairwise_pr(labelled: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Precision and recall of "same cluster" over all pairs whose rows have a truth, 0 where undefined, from a contingency table."""
    cells = labelled.where(F.col(truth).isNotNull()).groupBy(predicted, truth).agg(F.count(F.lit(1)).alias("n"))
    cells = stage(cells, "cells")
    total = lambda by: cells.groupBy(by).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(_choose2(F.col("n"))), F.lit(0)).alias("x"))
    tp = cells.agg(F.coalesce(F.sum(_choose2(F.col("n"))), F.lit(0)).alias("tp"), _choose2(F.coalesce(F.sum("n"), F.lit(0))).alias("n_pairs"))
    both = tp.crossJoin(total(predicted).withColumnRenamed("x", "predicted")).crossJoin(total(truth).withColumnRenamed("x", "actual"))  # three single rows
    ratio = lambda d: F.when(F.col(d) > 0, F.col("tp") / F.col(d)).otherwise(F.lit(0.0))
    return both.select("tp", "predicted", "actual", "n_pairs", ratio("predicted").alias("precision"), ratio("actual").alias("recall"))


def threshold_sweep(vectors: DataFrame, thresholds: list[float], truth: str | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``threshold, n_clusters, tp, predicted, precision, recall`` from one pair join at the least threshold."""
    spark = vectors.sparkSession
    pairs = stage(similar_pairs(vectors, min(thresholds), key, vector), "pairs")
    # Nodes of each threshold are told apart by it, so one run labels all of them.
    levels = F.explode(F.array(*[F.lit(float(t)) for t in sorted(thresholds)]))
    node = lambda c: F.struct("t", F.col(c).alias("k"))
    edges = pairs.withColumn("t", levels).where("sim >= t").select(node("src").alias("src"), node("dst").alias("dst"))
    found = connected_components(edges)
    grid = vectors.select(F.col(key).alias("k"), *([F.col(truth).alias("y")] if truth else []), levels.alias("t"))
    labelled = grid.join(found, F.struct("t", "k") == F.col("node"), "left").withColumn("c", F.coalesce("component.k", "k"))
    labelled = stage(labelled.drop("node", "component"), "sweep")
    counts = labelled.groupBy("t").agg(F.count_distinct("c").alias("n_clusters"))
    if not truth:
        return counts.withColumnRenamed("t", "threshold")
    cells = labelled.where("y is not null").groupBy("t", "c", "y").agg(F.count(F.lit(1)).alias("n"))
    tp = cells.groupBy("t").agg(F.sum(_choose2(F.col("n"))).alias("tp"))
    side = lambda by, name: cells.groupBy("t", by).agg(F.sum("n").alias("n")).groupBy("t").agg(F.sum(_choose2(F.col("n"))).alias(name))
    joined = counts.join(tp, "t", "left").join(side("c", "predicted"), "t", "left").join(side("y", "actual"), "t", "left").fillna(0)
    ratio = lambda d: F.when(F.col(d) > 0, F.col("tp") / F.col(d)).otherwise(F.lit(0.0))
    return joined.select(F.col("t").alias("threshold"), "n_clusters", "tp", "predicted", ratio("predicted").alias("precision"), ratio("actual").alias("recall"))
