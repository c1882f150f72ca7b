"""The cleaning report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cleaning_report(classified: DataFrame, split: str = "split", label: str = "label", size: str = "dims") -> DataFrame:
    """Counts in long form (section, name, n) from rows with ``reason`` and ``include``, in one pass over grouping sets.

    Sections: total (discovered, valid, included, rejected), included (split/label),
    dims (of all valid rows) and reason (of rejected rows).
    """
    rows = classified.select(
        F.col("reason").isNull().alias("valid"), F.coalesce(F.col("include"), F.lit(False)).alias("included"),
        F.concat_ws("/", split, F.col(label).cast("string")).alias("part"), F.col(size).alias("dims"), "reason",
    )
    state = [F.col("valid"), F.col("included")]
    sets = rows.groupingSets([state, [*state, F.col("part")], [F.col("valid"), F.col("dims")], [F.col("valid"), F.col("reason")]], *state, F.col("part"), F.col("dims"), F.col("reason"))
    counts = sets.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("absent"))
    # A bit of ``absent`` is set for each column that is not in the set: valid 16, included 8, part 4, dims 2, reason 1.
    total = lambda name, holds: F.when((F.col("absent") == 7) & holds, F.struct(F.lit("total").alias("section"), F.lit(name).alias("name")))
    cell = lambda absent, column, section, holds: F.when((F.col("absent") == absent) & holds & F.col(column).isNotNull(), F.struct(F.lit(section).alias("section"), F.col(column).alias("name")))
    sections = F.array(
        total("discovered", F.lit(True)), total("valid", F.col("valid")), total("included", F.col("valid") & F.col("included")), total("rejected", ~F.col("valid")),
        cell(3, "part", "included", F.col("valid") & F.col("included")), cell(13, "dims", "dims", F.col("valid")), cell(14, "reason", "reason", ~F.col("valid")),
    )
    return counts.select(F.explode(F.array_compact(sections)).alias("s"), "n").groupBy("s.section", "s.name").agg(F.sum("n").alias("n"))


def report_json(report: DataFrame) -> DataFrame:
    """The report as one row of JSON, a map of counts for each section."""
    maps = report.groupBy("section").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n")))).alias("m"))
    return maps.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", F.to_json("m")))))).alias("report"))
