"""Results that are computed once: splits by their inputs, features by their keys.

What holds is written in a record, the newest of a folder; a record is written after
the rows that it names, so a job that dies leaves the former state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.splits import fingerprint_scalable, seeded_split
from tessera.plans.scratch import discard, stage


#: What Spark raises for files that are not there or damaged.
UNREADABLE = (PySparkException, Py4JError)


class Records:
    """Numbered records below a folder, each written whole."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, f"{folder.rstrip('/')}/records", schema

    def newest(self) -> tuple[int, list[dict]]:
        """The number and rows of the newest record; (-1, []) if there is none or it cannot be read."""
        try:
            rows = self.spark.read.schema(f"{self.schema}, record int").parquet(self.folder)
            last = rows.agg(F.max("record").alias("n")).first()["n"]
            if last is None:
                return -1, []
            return last, [r.asDict() for r in rows.where(F.col("record") == last).drop("record").collect()]
        except UNREADABLE:
            return -1, []

    def write(self, n: int, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/record={n}")

    def remove(self, n: int) -> None:
        if n >= 0:
            discard(self.spark, f"{self.folder}/record={n}")


# Splits -------------------------------------------------------------------------------


def _check(rows: DataFrame) -> tuple[int, str]:
    """Count and sum of hashes of a written split."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("path", "split").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum")).first()
    return r["n"], r["sum"]


def cached_split(samples: DataFrame, folder: str | None, path: str = "path", generator: str = "generator", holdout: str | None = None, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """``seeded_split`` of ``samples`` (distinct paths), kept below ``folder`` and used again as long as the set of paths and all parameters stay the same.

    The key is a hash of the parameters and of a fingerprint that is independent of row
    order. A split that is missing, damaged (its count or sum of hashes differ, or it
    cannot be read) or of another key is computed and written again, and replaces the
    former one. Without a folder nothing is written.
    """
    split = lambda: seeded_split(samples, path, generator, holdout, train, val, seed)
    if folder is None:
        return split()
    spark = samples.sparkSession
    records = Records(spark, folder, "key string, place string, n long, sum string")
    parameters = f"{holdout}|{train!r}|{val!r}|{seed}"
    key = fingerprint_scalable(samples, path).select(F.sha2(F.concat_ws("|", F.lit(parameters), "fingerprint"), 256).alias("key")).first()["key"]
    n, rows = records.newest()
    kept = rows[0] if rows else None
    join = lambda stored: samples.join(stored.withColumnRenamed("path", "_path"), F.col(path) == F.col("_path")).drop("_path")
    if kept and kept["key"] == key:
        try:
            stored = spark.read.schema("path string, split string").parquet(kept["place"])
            if _check(stored) == (kept["n"], kept["sum"]):
                return join(stored)
        except UNREADABLE:
            pass  # damaged: computed again below
    place = f"{folder.rstrip('/')}/split-{uuid.uuid4().hex}"
    stored = stage(split().select(F.col(path).alias("path"), "split"), "split", place)
    records.write(n + 1, [(key, place, *_check(stored))])
    records.remove(n)
    if kept:
        discard(spark, kept["place"])
    return join(stored)


# Features -----------------------------------------------------------------------------


class FeatureTable:
    """Features by key, each computed once.

    New keys are appended as a run; when there are more than ``runs`` of them they are
    merged into one. A key stands in one run, except where two writers computed it at
    the same time; the earlier run then counts.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: str, runs: int = 8):
        self.spark, self.folder, self.keys, self.schema, self.most = spark, folder.rstrip("/"), keys, schema, runs
        self.records = Records(spark, folder, "run int, place string, n long")

    def _runs(self) -> tuple[int, list[tuple[int, str, int]]]:
        n, rows = self.records.newest()
        return n, sorted((r["run"], r["place"], r["n"]) for r in rows)

    def read(self) -> DataFrame:
        """All features, with ``run``: the number of the run that computed them."""
        _, runs = self._runs()
        if not runs:
            return self.spark.createDataFrame([], f"{self.schema}, run int")
        rows = self.spark.read.schema(f"{self.schema}, run int").parquet(*[place for _, place, _ in runs])
        if len(runs) == 1:
            return rows
        others = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.min(F.struct("run", *[c for c in others if c != "run"])).alias("_f")).select(*self.keys, *[F.col(f"_f.{c}").alias(c) for c in others])

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The rows of ``wanted`` whose keys have no features, one for each key."""
        _, runs = self._runs()
        fresh = wanted.dropDuplicates(self.keys)
        if not runs:
            return fresh
        known = self.spark.read.schema(f"{self.schema}, run int").parquet(*[place for _, place, _ in runs]).select(*self.keys).distinct()
        return fresh.join(known, self.keys, "left_anti")

    def ensure(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> int:
        """Compute and append the features of the keys in ``wanted`` that have none; how many they are."""
        n, runs = self._runs()
        new = stage(self.missing(wanted), "missing")
        if new.isEmpty():
            return 0
        number = max((r[0] for r in runs), default=-1) + 1
        names = [c for c in self.spark.createDataFrame([], self.schema).columns]
        place = f"{self.folder}/run-{number}-{uuid.uuid4().hex}"
        rows = stage(compute(new).select(*names).withColumn("run", F.lit(number)), "run", place)
        count = rows.count()
        self.records.write(n + 1, [*runs, (number, place, count)])
        self.records.remove(n)
        if len(runs) + 1 > self.most:
            self.compact()
        return count

    def compact(self) -> None:
        """Merge all runs into one, by keys; former runs are removed after the new record holds."""
        n, runs = self._runs()
        if len(runs) < 2:
            return
        place = f"{self.folder}/run-{runs[-1][0]}-{uuid.uuid4().hex}"
        merged = stage(self.read(), "run", place)
        self.records.write(n + 1, [(runs[-1][0], place, merged.count())])
        self.records.remove(n)
        for _, old, _ in runs:
            discard(self.spark, old)


def with_features(rows: DataFrame, table: FeatureTable, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with the features of their keys, computing those not there yet."""
    table.ensure(rows, compute)
    return rows.join(table.read(), table.keys)


def embed_conditions(conditions: dict[str, Callable[[Column], Column]], vector: str = "embedding") -> Callable[[DataFrame], DataFrame]:
    """A ``compute`` that applies to ``vector`` the function of the row's ``condition`` as ``features``."""

    def compute(rows: DataFrame) -> DataFrame:
        out = F.lit(None)
        for name, f in conditions.items():
            out = F.when(F.col("condition") == name, f(F.col(vector))).otherwise(out)
        return rows.withColumn("features", out)

    return compute
