"""Gapless global numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import stage


def number_rows(df: DataFrame, *order: Column, name: str = "ordinal") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 ... in the order given, which should be total.

    Rows are range-partitioned and sorted once and written; each partition then
    numbers its own rows from the count of those before it. Only one count for each
    partition reaches the driver.
    """
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    ranged = df.withColumns(keys).repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).withColumn("_part", F.spark_partition_id())
    staged = stage(ranged.sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys]), "ordinals")
    counts = sorted((r["_part"], r["count"]) for r in staged.groupBy("_part").count().collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    if not offsets:
        return df.withColumn(name, F.lit(0).cast("long"))
    first = df.sparkSession.createDataFrame(offsets, "_part int, _offset long")  # one row for each partition
    by = ", ".join(f"{k} asc nulls first" for k in keys)
    local = staged.withColumn("_local", F.expr(f"row_number() over (partition by _part order by {by})"))
    return local.join(F.broadcast(first), "_part").withColumn(name, (F.col("_offset") + F.col("_local") - 1).cast("long")).drop("_part", "_local", "_offset", *keys)
