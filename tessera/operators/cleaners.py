"""Cleaning of an image collection as one job.

Images are read and decoded once, into a written table of records with a reason for
those that are rejected; counts come with that write as observed metrics. The table
with the duplicate policy and the review groups joined feeds every sink: manifest,
clean manifest, rejects, review list and report.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.functions.images import describe_images
from tessera.operators.dedup import dup_stats, exact_dup_policy, near_dup_review
from tessera.operators.report import cleaning_report
from tessera.operators.splits import hash_split
from tessera.operators.validate import archive_source_info, gatekeep_archives, infer_path_metadata, validate_rows
from tessera.plans.ordinals import number_rows
from tessera.plans.scratch import stage
from tessera.sources.ranges import list_members, read_members
from tessera.sources.scans import ARCHIVE_SUFFIXES, IMAGE_SUFFIXES, scan_image_tree, scan_parquet_shards

HELD = ("validation", "test")


@dataclass
class Cleaned:
    """``records``: all records with ``reason``, ``include``, ``exclusion_reason`` and ``exact_duplicate_group``; ``containers``: rejected shards or archives; ``metrics``: counts of the whole job."""

    records: DataFrame
    containers: DataFrame
    review: DataFrame
    metrics: dict[str, int]

    def manifest(self) -> DataFrame:
        return self.records.where("reason is null").drop("reason")

    def clean(self) -> DataFrame:
        return self.manifest().where("include")

    def rejected(self) -> DataFrame:
        return self.records.where("reason is not null")

    def report(self) -> DataFrame:
        """``section, name, n``: the breakdowns of ``cleaning_report`` and the metrics as section ``job``."""
        job = self.records.sparkSession.createDataFrame([("job", k, int(v)) for k, v in sorted(self.metrics.items())], "section string, name string, n long")
        return cleaning_report(self.records).unionByName(job)

    def write(self, folder: str) -> None:
        """All sinks as CSV with headers below ``folder``; rows of one table may lie in several files."""
        tables = {"manifest": self.manifest(), "clean_manifest": self.clean(), "rejected": self.rejected(), "rejected_containers": self.containers, "near_duplicate_review": self.review, "cleaning_report": self.report()}
        for name, df in tables.items():
            df.write.mode("overwrite").option("header", "true").csv(f"{folder.rstrip('/')}/{name}")


def _finished(records: DataFrame, key: str, rank: Column, containers: DataFrame, names: list[str]) -> Cleaned:
    """``records`` (with reason, label, split, dims, and the hashes of valid images) through the duplicate policy and the review."""
    seen = Observation("records")
    n = lambda c: F.count_if(c)
    staged = stage(records.observe(seen, F.count(F.lit(1)).alias("discovered"), n(F.col("reason").isNull()).alias("valid"), n(F.col("reason").isNotNull()).alias("rejected")), "records")
    valid, rejected = staged.where("reason is null"), staged.where("reason is not null")
    policy = exact_dup_policy(valid, key, "label", rank)
    none = rejected.withColumns({"exact_duplicate_group": F.lit(None).cast("string"), "exclusion_reason": F.lit(None).cast("string"), "include": F.lit(False)})
    kept = Observation("policy")
    whole = stage(policy.unionByName(none).observe(kept, n(F.col("include")).alias("included")), "classified")
    review = near_dup_review(whole.where("reason is null"), "dhash", "pixel_sha256").select("review_group", "dhash", *names, "split", "label")
    reviewed = Observation("review")
    review = stage(review.observe(reviewed, F.count(F.lit(1)).alias("review_rows"), F.max("review_group").alias("last")), "review")
    last = reviewed.get["last"]
    metrics = {**seen.get, **kept.get, "review_groups": int(last.rpartition("_")[2]) if last else 0, "review_rows": reviewed.get["review_rows"], **valid.transform(dup_stats, key, "label", "split").first().asDict(), "rejected_containers": containers.count()}
    return Cleaned(whole, containers, review, metrics)


def _described(images: DataFrame) -> DataFrame:
    """Decoded facts in place of the content, and ``dims``."""
    size = F.octet_length("content").cast("long")
    return describe_images(images.withColumn("file_size", size)).drop("content").withColumn("dims", F.concat_ws("x", F.col("decoded_width").cast("string"), F.col("decoded_height").cast("string")))


def clean_image_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> Cleaned:
    """Images below ``root`` in folders that name a split and a label; equal pixels are duplicates, and of a group the test copy stays, else the first path."""
    images = infer_path_metadata(scan_image_tree(spark, root, suffixes), "relative_path").withColumnRenamed("reason", "_named")
    found = validate_rows(_described(images)).withColumn("reason", F.coalesce("_named", "reason")).drop("_named", "path")
    rank = F.struct((F.col("split") != "test").alias("s"), F.col("relative_path").alias("p"))
    return _finished(found, "pixel_sha256", rank, spark.createDataFrame([], "path string, reason string"), ["relative_path"])


def clean_shards(spark: SparkSession, paths: list[str]) -> Cleaned:
    """Rows of Parquet shards; equal bytes are duplicates, and of a group the validation copy stays, else the first by file and row."""
    rows, rejected = scan_parquet_shards(spark, paths)
    found = validate_rows(_described(rows.withColumnRenamed("label", "source_label")), with_label=True).withColumn("label", F.col("source_label").cast("int"))
    rank = F.struct((F.col("split") != "validation").alias("s"), F.col("parquet_file").alias("f"), F.col("row_index").alias("r"))
    return _finished(found.drop("source_label"), "byte_sha256", rank, rejected, ["parquet_file", "row_index"])


def _stride(members: DataFrame, most: int) -> DataFrame:
    """Of each archive's members in name order those at floor(i * n / most), all if there are not more."""
    order = F.struct("member_path", "start")
    sizes = members.groupBy("archive_path").agg(F.count(F.lit(1)).alias("_n"))
    numbered = number_rows(members, F.col("archive_path"), order, name="_at")
    first = numbered.groupBy("archive_path").agg(F.min("_at").alias("_first"))
    placed = numbered.join(sizes, "archive_path").join(first, "archive_path").withColumn("_at", F.col("_at") - F.col("_first"))
    # The i-th pick is floor(i * n / most), so a place is picked when some i maps to it.
    i = F.ceil(F.col("_at") * F.lit(most) / F.col("_n"))
    picked = (F.col("_n") <= most) | ((F.floor(i * F.col("_n") / F.lit(most)) == F.col("_at")) & (i < most))
    return placed.where(picked).drop("_n", "_at", "_first")


def clean_archives(spark: SparkSession, root: str, names: list[str], most: int | None = None) -> Cleaned:
    """Image members of the archives ``names`` below ``root``, at most ``most`` of each; equal bytes are duplicates, and of a group a copy of validation or test stays, else the first by archive and member.

    Archives that are held out, missing, empty or no archives are rejected with a reason.
    """
    base = f"{root.rstrip('/')}/"
    asked = spark.createDataFrame([(n,) for n in names], "archive_path string")
    full = F.concat(F.lit(base), F.col("archive_path"))
    wanted = asked.join(archive_source_info(asked).where("reason is null").select("archive_path"), "archive_path").select(full.alias("path"))
    members = stage(list_members(wanted).withColumn("archive_path", F.substring("archive_path", len(base) + 1, 1 << 20)), "members")
    listing = members.groupBy("archive_path").agg(F.max("reason").alias("error")).where("error is null or error <> 'archive_not_found'").select("archive_path", F.lit(1).alias("size"), F.regexp_replace("error", "^invalid_zip: ", "").alias("error"))
    rejected = stage(gatekeep_archives(asked, listing).where("reason is not null").select("archive_path", "reason"), "rejected")
    images = members.where("reason is null").where(F.lower(F.element_at(F.split("member_path", r"\."), -1)).isin(*ARCHIVE_SUFFIXES))
    if most is not None:
        images = _stride(images, most)
    content = read_members(images.withColumn("archive_path", full)).withColumn("archive_path", F.substring("archive_path", len(base) + 1, 1 << 20))
    described = _described(content.withColumnRenamed("reason", "_read").withColumn("member_path", F.replace("member_path", F.lit("\\"), F.lit("/"))))
    found = archive_source_info(validate_rows(described).withColumnRenamed("reason", "_image")).drop("reason").withColumn("reason", F.coalesce("_read", "_image")).drop("_read", "_image")
    found = found.withColumn("split", hash_split(F.col("member_path"))).withColumnRenamed("source_label", "label")
    rank = F.struct((~F.col("split").isin(*HELD)).alias("s"), F.col("archive_path").alias("a"), F.col("member_path").alias("m"))
    return _finished(found, "byte_sha256", rank, rejected, ["archive_path", "member_path"])
