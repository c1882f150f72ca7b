"""Splits and samples: deterministic, keyed by hashes, independent of row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.ordinals import number_rows


def hash_split(path: Column) -> Column:
    """A split folder in the path wins, validation before test before train; else eight tenths train, one each for the others."""
    parts = F.split(F.lower(path), "/")
    has = lambda *names: F.exists(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1)), lambda p: p.isin(*names))
    k = F.conv(F.substring(F.sha2(path, 256), 1, 8), 16, 10).cast("long") % 10
    hashed = F.when(k < 8, "train").when(k == 8, "validation").otherwise("test")
    return F.when(has("val", "validation"), "validation").when(has("test"), "test").when(has("train"), "train").otherwise(hashed)


def seeded_order(key: Column, seed: int = 42) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def seeded_split(samples: DataFrame, path: str = "path", generator: str = "generator", holdout: str | None = None, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """``samples`` with ``split``: the holdout generator apart, the rest cut at floor counts in hash order."""
    apart = F.coalesce(F.col(generator) == F.lit(holdout), F.lit(False)) if holdout is not None else F.lit(False)
    unseen, rest = samples.where(apart).withColumn("split", F.lit("unseen_generator")), samples.where(~apart)
    numbered = number_rows(rest, seeded_order(F.col(path), seed), F.col(path), name="_at")
    n = rest.count()
    a, b = int(n * train), int(n * train) + int(n * val)
    split = F.when(F.col("_at") < a, "train").when(F.col("_at") < b, "val").otherwise("test")
    return numbered.withColumn("split", split).drop("_at").unionByName(unseen)


def fingerprint(samples: DataFrame, path: str = "path") -> DataFrame:
    """SHA-256 over the sorted paths, each followed by a line feed, in one row.

    The digest is defined over the whole list, so it needs it in one place. For
    lists too long for that use :func:`fingerprint_scalable`.
    """
    joined = F.concat(F.array_join(F.sort_array(F.collect_list(path)), "\n"), F.when(F.count(path) > 0, "\n").otherwise(""))
    return samples.agg(F.sha2(joined, 256).alias("fingerprint"), F.count(path).alias("n"))


def fingerprint_scalable(samples: DataFrame, path: str = "path") -> DataFrame:
    """A fingerprint of the same multiset of paths from sums of hashes; of fixed size and combined before the shuffle."""
    part = lambda seed: F.coalesce(F.sum(F.xxhash64(F.col(path), F.lit(seed)).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return samples.agg(F.sha2(F.concat_ws(":", F.count(path).cast("string"), part(1), part(2), part(3)), 256).alias("fingerprint"), F.count(path).alias("n"))


def top_in_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; the window's partial limit runs before the shuffle."""
    keys = {f"_k{i}": c for i, c in enumerate(order)}
    by = ", ".join(keys)
    over = f"row_number() over (partition by {', '.join(group) or 'true'} order by {by})"
    return df.withColumns(keys).withColumn("_rn", F.expr(over)).where(f"_rn <= {k}").drop("_rn", *keys)


def stratified_cap(samples: DataFrame, most: int, path: str = "path", label: str = "label", seed: int = 42) -> DataFrame:
    """All rows if there are at most ``most``; else ``most // labels`` of each label in hash order."""
    facts = samples.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("k")).first()
    if facts["n"] <= most:
        return samples
    return top_in_group(samples, [label], [seeded_order(F.col(path), seed), F.col(path)], most // max(1, facts["k"]))


def stratified_per_class(samples: DataFrame, k: int | None, path: str = "path", label: str = "label", seed: int = 42) -> DataFrame:
    """Up to ``k`` of each class in hash order; all for None."""
    return samples if k is None else top_in_group(samples, [label], [seeded_order(F.col(path), seed), F.col(path)], k)


def systematic_sample(df: DataFrame, most: int, key: str) -> DataFrame:
    """All rows if at most ``most``; else those at floor(i * n / most), in the order of ``key``."""
    n = df.count()
    if n <= most:
        return df
    stride = n / most
    at = F.least(F.floor(F.col("id") * F.lit(stride)), F.lit(n - 1))
    picks = df.sparkSession.range(most).select(at.alias("_at"))
    return number_rows(df, F.col(key), name="_at").join(picks, "_at").drop("_at")


def random_sample(df: DataFrame, k: int, key: str, seed: int = 42) -> DataFrame:
    """``k`` rows in hash order."""
    return df.orderBy(seeded_order(F.col(key), seed), key).limit(k)
