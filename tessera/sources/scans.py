"""Scans of image trees, Parquet shards, archives and manifests; sinks for manifests and reports."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.splits import stratified_cap
from tessera.sources.ranges import list_files, list_members, read_members

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp")
ARCHIVE_SUFFIXES = (*IMAGE_SUFFIXES, "tif", "tiff")
SHARD_PREFIXES = ("train-", "validation-")
#: Names of sources that differ from their scheme.
SOURCE_NAMES = {"sidset": "sid_set"}
SHARD_COLUMNS = ("img_id", "image", "width", "height", "label")


def scan_image_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """``path, relative_path, content`` of all files below ``root`` with one of the suffixes, in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = files.where(F.lower("path").rlike(rf"\.({'|'.join(suffixes)})$"))
    return named.select("path", F.replace(F.regexp_replace("path", "^file:/*", "/"), F.lit(root.removeprefix("file://").rstrip("/") + "/"), F.lit("")).alias("relative_path"), "content")


def image_bytes(df: DataFrame, column: str = "image") -> DataFrame:
    """``content`` from a binary column or the ``bytes`` of a struct."""
    kind = df.schema[column].dataType.typeName()
    return df.withColumn("content", F.col(f"{column}.bytes") if kind == "struct" else F.col(column))


def scan_parquet_shards(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of all shards that have the needed columns, and the rejected shards with their reason.

    Rows carry ``parquet_file``, ``row_index`` and the ``split`` that the file name starts with, in
    any case; a shard of another name is rejected.
    """
    good, bad = [], []
    for path in sorted(paths):
        if not path.rpartition("/")[2].lower().startswith(SHARD_PREFIXES):
            bad.append((path, "file name must start with " + " or ".join(SHARD_PREFIXES)))
            continue
        missing = sorted(set(SHARD_COLUMNS) - set(spark.read.parquet(path).columns))  # reads the footer
        bad.append((path, "missing columns: " + ", ".join(missing))) if missing else good.append(path)
    rejected = spark.createDataFrame(bad, "parquet_file string, reason string")
    if not good:
        return spark.createDataFrame([], "parquet_file string, row_index long, split string"), rejected
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    split = F.regexp_extract(F.lower(name), "^([a-z]+)-", 1)
    rows = spark.read.parquet(*good).select(*SHARD_COLUMNS, name.alias("parquet_file"), F.col("_metadata.row_index").alias("row_index"), split.alias("split"))
    return image_bytes(rows).drop("image"), rejected


def scan_zip_archives(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ARCHIVE_SUFFIXES) -> DataFrame:
    """``archive_path, member_path, content, error`` of the image members of all archives, read in place; a broken archive gives one row with an error, a broken member its own."""
    members = list_members(list_files(spark, root, "*.zip"))
    wanted = members.where(F.col("reason").isNotNull() | F.lower(F.element_at(F.split("member_path", r"\."), -1)).isin(*suffixes))
    return read_members(wanted).withColumnRenamed("reason", "error")


def scan_manifest(manifest: DataFrame, files: DataFrame, container: str, member: str, scheme: str, label: str = "source_label", generator: str | None = None) -> DataFrame:
    """``path, label, generator`` of the included rows whose container exists and whose label is 0 or 1; generators keep their case."""
    kept = manifest.where(F.col("include").cast("string").isin("True", "true") & F.col(label).cast("int").isin(0, 1)).join(files.select(container).distinct(), container, "left_semi")
    name = SOURCE_NAMES.get(scheme.partition("-")[0], scheme.partition("-")[0])
    source = F.concat(F.lit(f"{name}_"), F.col(generator)) if generator else F.lit(name)
    return kept.select(F.concat(F.lit(f"{scheme}://"), container, F.lit("#"), F.col(member).cast("string")).alias("path"), F.col(label).cast("int").alias("label"), source.alias("generator"))


def scan_dataset(paths: DataFrame, path: str = "path") -> DataFrame:
    """``path, label, generator`` from ``.../<dataset>/<real|ai>/...``; a generated file's generator is its next folder, in its own case."""
    parts = F.split(F.col(path), "/")
    at = F.array_position(F.transform(parts, lambda p: F.when(p.isin("real", "ai"), 1).otherwise(0)), 1).cast("int")
    dataset, kind = F.try_element_at(parts, F.when(at > 1, at - 1)), F.try_element_at(parts, F.when(at > 0, at))
    sub = F.when(F.size(parts) > at + 1, F.try_element_at(parts, at + 1))
    generator = F.when((dataset == "wildfake") & (kind == "ai"), F.concat(F.lit("wildfake_"), F.coalesce(sub, F.lit("unknown")))).otherwise(dataset)
    return paths.where(at > 1).select(path, F.when(kind == "real", 0).otherwise(1).alias("label"), generator.alias("generator"))


def scan_nested(paths: DataFrame, generator: str = "cifake", path: str = "path") -> DataFrame:
    """``path, label, generator`` of images in ``.../<train|test>/<REAL|FAKE>/...``, one pool; folder names count in their own case."""
    kind = F.regexp_extract(F.col(path), r"/(?:train|test)/(REAL|FAKE)/(?:.*/)?[^/]+\.(?i:jpg|jpeg|png|webp)$", 1)
    return paths.where(kind != "").select(path, F.when(kind == "REAL", 0).otherwise(1).alias("label"), F.lit(generator).alias("generator"))


def relabel_folders(paths: DataFrame, path: str = "path") -> DataFrame:
    """``path, label`` by the folder that an image lies in, real 0 and fake 1 in any case; another folder is an error."""
    folder = F.lower(F.regexp_extract(F.col(path), r"([^/]+)/[^/]+$", 1))
    unknown = paths.where(~folder.isin("real", "fake")).select(folder.alias("f")).distinct().limit(5).collect()
    if unknown:
        raise ValueError(f"expected real and fake folders, found {', '.join(sorted(r['f'] for r in unknown))}")
    return paths.select(path, F.when(folder == "real", 0).otherwise(1).alias("label"))


def scan_split(manifest: DataFrame, split: str, container: str, member: str, scheme: str, label: str = "source_label") -> DataFrame:
    """``path, label`` of a split's rows whose label is 0 or 1, to be read on demand by ``ranges.resolve_paths``; no such row is an error."""
    kept = manifest.where((F.col("split") == split) & F.col(label).cast("int").isin(0, 1))
    rows = kept.select(F.concat(F.lit(f"{scheme}://"), container, F.lit("#"), F.col(member).cast("string")).alias("path"), F.col(label).cast("int").alias("label"))
    if rows.isEmpty():
        raise ValueError(f"no usable rows for split {split!r}")
    return rows


def union_sources(sources: dict[str, DataFrame | None], most: int | None = None, seed: int = 42) -> DataFrame:
    """``path, label, generator`` of all sources that are there, each capped to ``most`` rows, evenly by label; a source that is not there (None) gives a warning."""
    out = None
    for name, rows in sources.items():
        if rows is None:
            warnings.warn(f"source {name} is not there", stacklevel=2)
            continue
        rows = rows.select("path", "label", "generator")
        rows = rows if most is None else stratified_cap(rows, most, seed=seed)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no source is present")
    return out


def write_manifests(classified: DataFrame, path: str) -> None:
    """``manifest``, ``clean_manifest`` and ``rejects`` below ``path`` as CSV with headers."""
    valid = classified.where("reason is null").drop("reason")
    for name, df in (("manifest", valid), ("clean_manifest", valid.where("include")), ("rejects", classified.where("reason is not null"))):
        df.write.mode("overwrite").option("header", "true").csv(f"{path}/{name}")


def media_key(image_id, suffix: str, folder: str = "originals"):
    return F.concat(F.lit(f"{folder}/"), image_id, F.lit(suffix))
