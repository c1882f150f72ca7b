"""Exact duplicates under a leakage-aware policy, their statistics, and review groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.ordinals import number_rows

CONFLICT, DUPLICATE = "exact_duplicate_label_conflict", "exact_duplicate"


def group_having(df: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Keys with ``least`` rows or more, and their counts."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def exact_dup_policy(df: DataFrame, key: str, label: str, rank: Column, order_by: str = "key", prefix: str = "exact_") -> DataFrame:
    """``df`` with ``exact_duplicate_group``, ``include`` and ``exclusion_reason``.

    ``rank`` is a struct that orders the rows of a group totally; the least stays. A
    group with several labels is dropped whole. Groups are numbered from 1 by key or,
    with ``order_by="first_seen"``, by their least rank. Group facts come from one
    aggregation with map-side combine, joined back; a hot group is never windowed.
    """
    facts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(label).alias("_a"), F.max(label).alias("_b"), F.min(rank).alias("_first")).where("_n > 1")
    first = F.col(key) if order_by == "key" else F.col("_first")
    facts = number_rows(facts, first, name="_g").select(
        F.col(key).alias("_key"), (F.col("_a") != F.col("_b")).alias("_conflict"), "_first", F.concat(F.lit(prefix), F.lpad((F.col("_g") + 1).cast("string"), 6, "0")).alias("exact_duplicate_group")
    )
    joined = df.join(facts, F.col(key) == F.col("_key"), "left")
    reason = F.when(F.col("_conflict"), F.lit(CONFLICT)).when(F.col("_key").isNotNull() & (rank != F.col("_first")), F.lit(DUPLICATE))
    out = joined.withColumn("exclusion_reason", reason).withColumn("include", F.col("exclusion_reason").isNull())
    return out.drop("_key", "_conflict", "_first")


def dup_stats(df: DataFrame, key: str, label: str, split: str) -> DataFrame:
    """One row: groups, images in them, groups across labels, groups across splits only. Counts are 0, never absent."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.min(label) != F.max(label)).alias("labels"), (F.min(split) != F.max(split)).alias("splits")).where("n > 1")
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return groups.agg(
        F.count(F.lit(1)).alias("exact_duplicate_groups"), total(F.col("n")).alias("exact_duplicate_images"),
        total(F.col("labels")).alias("cross_label_groups"), total(F.col("splits") & ~F.col("labels")).alias("cross_split_groups"),
    )


def near_dup_review(df: DataFrame, fingerprint: str, pixels: str, require_distinct_pixels: bool = True) -> DataFrame:
    """Rows that share a fingerprint with others of different pixels, with ``review_group`` in fingerprint order."""
    groups = df.where(F.col(fingerprint).isNotNull()).groupBy(fingerprint).agg(F.count(F.lit(1)).alias("_n"), (F.min(pixels) != F.max(pixels)).alias("_distinct"))
    groups = groups.where("_n > 1 and _distinct" if require_distinct_pixels else "_n > 1")
    numbered = number_rows(groups, F.col(fingerprint), name="_g").select(F.col(fingerprint), F.concat(F.lit("review_"), F.lpad((F.col("_g") + 1).cast("string"), 6, "0")).alias("review_group"))
    return df.join(numbered, fingerprint)


def latest_wins(stored: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Upsert: of all rows of a key the one with the greatest version, changes before stored rows at a tie."""
    names = stored.columns
    both = stored.withColumn("_new", F.lit(0)).unionByName(changes.select(*names).withColumn("_new", F.lit(1)))
    best = both.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(version, "_new")).alias("row"))
    return best.select("row.*")


def delete_rows(stored: DataFrame, condition: Column) -> DataFrame:
    """``stored`` without the rows for which the condition holds; where it is null the row stays."""
    return stored.where(~F.coalesce(condition, F.lit(False)))


def update_rows(stored: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``stored`` with ``columns`` taken from the change of the same key, nulls too; keys that are not stored are ignored.

    Of several changes of a key the one with the greatest values counts. A null key is never changed.
    """
    one = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*columns)).alias("_change"))
    joined = stored.join(one, key, "left")
    return joined.select(*[F.when(F.col("_change").isNotNull(), F.col(f"_change.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns])
