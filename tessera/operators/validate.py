"""Validation with explicit reasons, path metadata, labels and gatekeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder names that give a split or a label, archives kept out.
SPLIT_DIRS = {"train": "train", "test": "test", "val": "val", "valid": "val", "validation": "val"}
LABEL_DIRS = {"real": 0, "fake": 1, "ai": 1}
HOLDOUT_ARCHIVES, HOLDOUT_PARTS = ("coco", "dalle", "dall-e", "dalle3"), ("coco", "dalle")


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that holds, in the order given; null if none does."""
    out = F.lit(None).cast("string")
    for failed, reason in reversed(checks):
        out = F.when(F.coalesce(failed, F.lit(False)), F.lit(reason)).otherwise(out)
    return out


def validate_rows(images: DataFrame, with_label: bool = False) -> DataFrame:
    """``images`` (width, height as declared; decoded_width, decoded_height; source_label) with ``reason``, null for valid rows."""
    checks = [
        (F.col("decoded_width").isNull() | F.col("decoded_height").isNull(), "unreadable"),
        ((F.col("decoded_width") < 1) | (F.col("decoded_height") < 1), "invalid_dimensions"),
    ]
    if with_label:
        checks = [
            (F.col("source_label").isNull() | ~F.col("source_label").isin(0, 1, 2), "invalid_label"),
            (F.col("width").isNull() | F.col("height").isNull() | (F.col("width") < 1) | (F.col("height") < 1), "invalid_metadata_dimensions"),
            *checks,
            ((F.col("width") != F.col("decoded_width")) | (F.col("height") != F.col("decoded_height")), "dimension_mismatch"),
        ]
    return images.withColumn("reason", first_reason(*checks))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows without ``reason``, and rejected rows."""
    return df.where("reason is null").drop("reason"), df.where("reason is not null")


def _one_of(parts: Column, names: dict) -> Column:
    value = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    known = F.array_distinct(F.transform(F.filter(parts, lambda p: p.isin(*names)), lambda p: value[p]))
    return F.when(F.size(known) == 1, F.get(known, F.lit(0)))


def infer_path_metadata(df: DataFrame, path_col: str = "path") -> DataFrame:
    """``split`` and ``label`` from the folders that name one, and ``reason`` where none does or they disagree."""
    parts = F.slice(F.split(F.lower(path_col), "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(path_col, "/")) - 1))
    out = df.withColumn("split", _one_of(parts, SPLIT_DIRS)).withColumn("label", _one_of(parts, LABEL_DIRS))
    return out.withColumn("reason", first_reason((F.col("split").isNull(), "ambiguous_split"), (F.col("label").isNull(), "ambiguous_label")))


def archive_source_info(df: DataFrame, path_col: str = "archive_path") -> DataFrame:
    """``source``, ``source_label``, ``generator``, ``is_advanced`` and ``reason`` of an archive path; a holdout's name may stand anywhere in it."""
    path = F.lower(F.concat(F.lit("/"), F.replace(F.col(path_col), F.lit("\\"), F.lit("/"))))
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    real = path.contains("/real/")
    label = F.when(real, 0).when(path.contains("/diffusion_based/") | path.contains("/gan_based") | path.contains("/other_based"), 1)
    source = F.when(label.isNotNull(), F.concat(F.when(real, F.lit("wildfake_real_")).otherwise(F.lit("wildfake_")), stem))
    out = df.withColumn("source", source).withColumn("generator", stem).withColumn("source_label", label).withColumn("is_advanced", F.lit(0))
    holdout = stem.isin(*HOLDOUT_ARCHIVES) | path.rlike("|".join(HOLDOUT_PARTS))
    return out.withColumn("reason", first_reason((holdout, "holdout"), (label.isNull(), "unknown_source")))


def gatekeep_archives(requested: DataFrame, listing: DataFrame) -> DataFrame:
    """``requested`` (archive_path) against ``listing`` (archive_path, size, error): the reason an archive is not read, or null."""
    known = listing.select("archive_path", F.col("size").alias("_size"), F.col("error").alias("_error"), F.lit(True).alias("_found"))
    joined = archive_source_info(requested).join(known, "archive_path", "left")
    reason = F.coalesce(
        F.when(F.col("reason") == "holdout", F.col("reason")),
        F.when(F.col("_found").isNull(), F.lit("archive_not_found")).when(F.col("_size") <= 0, F.lit("incomplete_archive")).when(F.col("_error").isNotNull(), F.concat(F.lit("invalid_zip: "), "_error")),
        F.col("reason"),
    )
    return joined.withColumn("reason", reason).drop("_size", "_error", "_found")


def label_policy(df: DataFrame, label_col: str = "source_label", kept: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Rows whose source label is kept, as ``label``."""
    return df.where(F.col(label_col).isin(*kept)).withColumn("label", F.col(label_col).cast("int"))
