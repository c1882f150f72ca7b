"""Tables kept in buckets, with versions that are published whole.

A version is a list of (table, bucket, folder version). A new version writes the
buckets that changed and lists the former folders for all others, so a step reads
and writes what it touches. The list is written last: a step that dies leaves the
former version as it was, and a step that runs again overwrites its own folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.scratch import discard

#: Buckets of each table; a version's list has this many rows for each table.
BUCKETS = 64


class BucketStore:
    """``tables`` maps a table's name to its schema (DDL) and the column that its bucket is a hash of."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, str]], buckets: int = BUCKETS):
        self.spark, self.path, self.tables, self.buckets = spark, path.rstrip("/"), tables, buckets
        self._known: dict[int, dict[tuple[str, int], int]] = {}

    def bucket(self, table: str, key: Column | None = None) -> Column:
        """The bucket of a row; ``key`` where the key has another name than in the table."""
        return F.pmod(F.xxhash64(F.col(self.tables[table][1]) if key is None else key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, table: str, key: Column | None = None) -> list[int]:
        """The buckets of these rows, ``buckets`` numbers at most."""
        return sorted(r["b"] for r in rows.select(self.bucket(table, key).alias("b")).distinct().collect())

    def versions(self, n: int) -> dict[tuple[str, int], int]:
        """Folder versions of version ``n`` by table and bucket."""
        if n not in self._known:
            self._known[n] = {(r["table"], r["bucket"]): r["v"] for r in self.spark.read.parquet(f"{self.path}/versions/n={n}").collect()}
        return dict(self._known[n])

    def read(self, table: str, n: int, buckets: list[int] | None = None) -> DataFrame:
        """A table as of version ``n``, of the buckets asked for."""
        listed = [(b, v) for (t, b), v in sorted(self.versions(n).items()) if t == table and (buckets is None or b in buckets)]
        schema = self.tables[table][0]
        if not listed:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{table}/v={v}/bucket={b}" for b, v in listed])

    def publish(self, n: int, changed: dict[str, DataFrame], before: int | None = None) -> None:
        """Version ``n``: the buckets in which ``changed`` has rows are replaced by those rows, all others stay as in version ``before``."""
        listed = self.versions(before) if before is not None else {}
        self._known.pop(n, None)
        for table, rows in changed.items():
            folder = f"{self.path}/{table}/v={n}"
            names = self.spark.createDataFrame([], self.tables[table][0]).columns
            rows.select(*names, self.bucket(table).alias("bucket")).repartition("bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(folder)
            written = self.spark.read.schema("bucket int").parquet(folder).distinct().collect()  # folder names, ``buckets`` at most
            listed |= {(table, r["bucket"]): n for r in written}
        rows = [(t, b, v) for (t, b), v in sorted(listed.items())]
        self.spark.createDataFrame(rows, "table string, bucket int, v int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/n={n}")

    def forget(self, n: int, keep: int) -> None:
        """Remove version ``n`` and the folders that ``keep``, a later version, no longer lists; both must be published."""
        current = self.versions(keep)
        for (table, bucket), v in self.versions(n).items():
            if current.get((table, bucket)) != v:
                discard(self.spark, f"{self.path}/{table}/v={v}/bucket={bucket}")
        discard(self.spark, f"{self.path}/versions/n={n}")
        self._known.pop(n, None)
