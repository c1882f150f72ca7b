"""Views of the feed: posts, clusters, accounts, simulation, labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scoring import REPEATED, label_for
from tessera.operators.clusters import cluster_repetition
from tessera.operators.dedup import delete_rows
from tessera.operators.splits import top_in_group
from tessera.plans.ordinals import number_rows


def _sizes(posts: DataFrame) -> DataFrame:
    return posts.groupBy("similarity_cluster").agg(F.count(F.lit(1)).alias("cluster_size"))


def feed_view(posts: DataFrame) -> DataFrame:
    """The ten public columns. Sort by ``uploaded_at`` descending, ``image_id`` to show."""
    sized = posts.join(_sizes(posts), "similarity_cluster")
    return sized.select(
        "image_id", "thumbnail_url", "handle", "ai_probability", "repetition_score", "diversity_label", "similarity_cluster", "cluster_size",
        F.round(F.coalesce("similarity_score", F.lit(0.0)), 4).alias("similarity_score"), F.unix_timestamp("created_at").alias("uploaded_at"),
    )


def cluster_rollup(posts: DataFrame) -> DataFrame:
    """Each cluster's newest post, count, ids newest first, and mean similarity to 4 places."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct((-F.unix_micros("created_at")).alias("t"), "image_id"))), lambda s: s["image_id"])
    grouped = posts.groupBy("similarity_cluster").agg(F.count(F.lit(1)).alias("count"), ids.alias("image_ids"), F.round(F.avg(F.coalesce("similarity_score", F.lit(0.0))), 4).alias("average_similarity"))
    return grouped.withColumn("representative_image_id", F.col("image_ids")[0])


def cluster_detail(posts: DataFrame, keep: str = "newest") -> DataFrame:
    """``similarity_cluster, image_id, kept``: one post stays, the newest or the least repeated."""
    best = F.min(F.struct((-F.unix_micros("created_at")).alias("t") if keep == "newest" else F.col("repetition_score"), F.col("image_id").alias("id"))).alias("_best")
    chosen = posts.groupBy("similarity_cluster").agg(best).select("similarity_cluster", F.col("_best.id").alias("_kept"))
    return posts.join(chosen, "similarity_cluster").select("similarity_cluster", "image_id", (F.col("image_id") == F.col("_kept")).alias("kept"))


def account_summary(posts: DataFrame) -> DataFrame:
    """Totals, flagged share in percent to 2 places, and the trend in time order."""
    flagged = F.sum((F.col("diversity_label") == REPEATED).cast("long"))
    trend = F.sort_array(F.collect_list(F.struct("created_at", "image_id", "repetition_score")))
    shown = F.transform(trend, lambda t: F.struct(F.date_format(t["created_at"], "yyyy-MM-dd").alias("date"), t["repetition_score"].alias("repetition_score")))
    return posts.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("total_uploads"), flagged.alias("repeated_synthetic_count"), F.round(flagged / F.count(F.lit(1)) * 100, 2).alias("flagged_percentage"), shown.alias("repetition_trend")
    )


def simulate_feed(feed: DataFrame, order: list[str], key: str = "image_id") -> DataFrame:
    """``feed`` with ``kept``: of the repeated posts of a handle the first stays, all others stay anyway."""
    first = feed.where(F.col("diversity_label") == REPEATED).groupBy("handle").agg(F.min(F.struct(*order, F.col(key))).alias("_first"))
    joined = feed.join(first, "handle", "left")
    kept = (F.col("diversity_label") != REPEATED) | (F.struct(*order, F.col(key)) == F.col("_first"))
    return joined.withColumn("kept", F.coalesce(kept, F.lit(True))).drop("_first")


def recalculate_clusters(posts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``posts`` with the repetition score of their cluster's size and a label by their own score."""
    facts = posts.groupBy("similarity_cluster").agg(F.count(F.lit(1)).alias("_n"), F.max("ai_probability").alias("_top"))
    joined = posts.join(facts, "similarity_cluster")
    repeated = (F.col("_n") > 1) & (F.col("_top") >= threshold)
    out = joined.withColumn("repetition_score", cluster_repetition(F.col("_n"))).withColumn("diversity_label", label_for(F.col("ai_probability"), repeated, threshold))
    return out.drop("_n", "_top")


def cluster_key(label: Column, cluster: Column, handle: Column) -> Column:
    return F.coalesce(F.concat(F.lit("sim:"), cluster.cast("string")), F.when(label == REPEATED, F.concat(F.lit("flood:"), handle)))


def feed_cluster_key(df: DataFrame, key: str = "image_id") -> DataFrame:
    """``df`` with ``cluster_key``: by cluster, else by handle for repeated posts, else alone."""
    return df.withColumn("cluster_key", F.coalesce(cluster_key(F.col("diversity_label"), F.col("similarity_cluster"), F.col("handle")), F.concat(F.lit("solo:"), F.col(key).cast("string"))))


def repeated_counts(posts: DataFrame) -> DataFrame:
    """Repeated posts by cluster key."""
    return feed_cluster_key(posts).where(F.col("diversity_label") == REPEATED).groupBy("cluster_key").agg(F.count(F.lit(1)).alias("n"))


def sheet_group(posts: DataFrame) -> DataFrame:
    """``similarity_cluster, kept_image_id, n, average_similarity``: the least repeated post stays."""
    best = F.min(F.struct("repetition_score", "image_id"))
    return posts.groupBy("similarity_cluster").agg(best["image_id"].alias("kept_image_id"), F.count(F.lit(1)).alias("n"), F.round(F.avg("similarity_score"), 4).alias("average_similarity"))


def hue(key: Column) -> Column:
    """A stable colour 0 to 7 of a key: 31 h + c in 32 bits, absolute, modulo 8."""
    wrap = lambda v: F.pmod(v + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    total = F.aggregate(F.split(key, ""), F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + F.ascii(c)))
    return (F.abs(total) % 8).cast("int")


def seed_posts(files: DataFrame, start: str) -> DataFrame:
    """Seed posts from ``files`` (name, is_fake): originals first, then generated ones, each in name order, a minute apart.

    Seven tenths of the generated ones (one at least) flood from one account and
    cluster; their repetition score rises with each.
    """
    numbered = number_rows(files, F.col("is_fake"), F.col("name"), name="i")
    n_real = numbered.where("not is_fake").count()
    n_fake = numbered.count() - n_real
    flood = max(1, min(n_fake, round(n_fake * 0.7)))
    k = F.col("i") - n_real
    is_flood = F.col("is_fake") & (k < flood)
    rep = F.when(is_flood, F.least(F.lit(0.94), F.lit(0.35) + k * F.lit(0.12))).when(F.col("is_fake"), F.lit(0.08)).otherwise(F.lit(0.05))
    label = F.when(is_flood & (rep >= 0.75), F.lit(REPEATED)).when(F.col("is_fake"), F.lit("unique_ai")).otherwise(F.lit("original"))
    return numbered.select(
        F.when(F.col("is_fake"), F.concat(F.lit("demo_ai_"), (k + 1).cast("string"))).otherwise(F.concat(F.lit("demo_creator_real_"), (F.col("i") + 1).cast("string"))).alias("image_id"),
        F.when(is_flood, "demo-flood").otherwise("demo-creator").alias("account_id"),
        F.when(is_flood, "@synthetic.flood").otherwise("@oneoff.studio").alias("handle"),
        "name", F.when(F.col("is_fake"), F.lit(0.94)).otherwise(F.lit(0.08)).alias("ai_probability"), F.round(rep, 2).alias("repetition_score"), label.alias("diversity_label"),
        F.when(is_flood, F.lit(200)).when(F.col("is_fake"), 400 + k).otherwise(300 + F.col("i")).cast("long").alias("similarity_cluster"),
        F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + F.col("i") * 60_000_000).alias("created_at"),
    )


def four_digits(number: Column) -> Column:
    """``number`` with zeros before it, four digits at least."""
    return F.format_string("%04d", number)


def near_dupe_posts(manifest: DataFrame, start: str, offset: int = 1000, tag: Callable[[Column], Column] = four_digits) -> DataFrame:
    """Posts of ``manifest`` (image_path, similarity_cluster): one account for each cluster, a minute apart.

    ``tag`` writes a cluster's number in ids and handles.
    """
    sizes = manifest.groupBy("similarity_cluster").agg(F.count(F.lit(1)).alias("g"))
    numbered = number_rows(manifest.join(sizes, "similarity_cluster"), F.col("similarity_cluster"), F.col("image_path"), name="i")
    return numbered.select(
        F.concat(F.lit("demo_dupe_"), tag(F.col("similarity_cluster")), F.lit("_"), (F.col("i") + 1).cast("string")).alias("image_id"), F.concat(F.lit("@reposter"), tag(F.col("similarity_cluster"))).alias("handle"),
        "image_path", F.lit(0.9).alias("ai_probability"), F.round((F.col("g") - 1) / F.col("g"), 2).alias("repetition_score"),
        F.when(F.col("g") > 1, REPEATED).otherwise("unique_ai").alias("diversity_label"), (F.col("similarity_cluster") + offset).cast("long").alias("similarity_cluster"),
        F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + F.col("i") * 60_000_000).alias("created_at"),
    )


def embedding_audit(posts: DataFrame) -> DataFrame:
    """Whether each post has a vector, of what size, and the first 12 characters of its hash."""
    has = F.coalesce(F.size("embedding") > 0, F.lit(False))
    return posts.select("image_id", has.alias("has_embedding"), F.when(has, F.size("embedding")).otherwise(0).cast("long").alias("embedding_dim"), F.substring(F.coalesce("image_sha256", F.lit("")), 1, 12).alias("sha_prefix"))


def newest(posts: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The ``k`` newest posts, of all or of each group."""
    return top_in_group(posts, by or [], [F.col("created_at").desc(), F.col("image_id")], k) if by else posts.orderBy(F.desc("created_at"), "image_id").limit(k)


def embedding_totals(posts: DataFrame) -> DataFrame:
    """One row: posts in all, with a vector and without."""
    has = F.coalesce(F.size("embedding") > 0, F.lit(False))
    n = F.count(F.lit(1))
    return posts.agg(n.alias("total"), F.count(F.when(has, 1)).alias("with_embedding"), (n - F.count(F.when(has, 1))).alias("without_embedding"))


def reset_posts(posts: DataFrame, seeds: DataFrame) -> DataFrame:
    """The state after a reset: uploads go, ``seeds`` replace stored seeds of the same id, other stored seeds stay.

    A post whose ``is_seed`` is null stays, since only what is known to be an upload goes.
    """
    kept = delete_rows(posts, ~F.col("is_seed")).join(seeds.select("image_id"), "image_id", "left_anti")
    return kept.unionByName(seeds.withColumn("is_seed", F.lit(True)).select(*posts.columns))
