"""Running aggregates that no long group can pile up in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 1024


def running(df: DataFrame, by: str, at: str, aggregate: Callable[[Column], Column], combine: Callable[[Column, Column], Column], columns: list[str], descending: bool = False, block: int | None = None) -> DataFrame:
    """``df`` with each of ``columns`` replaced by its aggregate over the rows of the same ``by`` up to this one, in the order of ``at`` (whole numbers, distinct within ``by``).

    A group is cut into blocks of ``block`` places; a window runs inside each, and the
    totals of the blocks before are carried on, so a group of any length spreads over
    tasks. ``df`` is read twice, so it should be a written table.
    """
    blocked = df.withColumn("_block", F.floor(F.col(at) / (block or BLOCK)))
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inside = Window.partitionBy(by, "_block").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(by).orderBy(order("_block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(by, "_block").agg(*[aggregate(F.col(c)).alias(c) for c in columns])
    carried = totals.select(by, "_block", *[aggregate(F.col(c)).over(before).alias(f"_{c}") for c in columns]).where(F.col(f"_{columns[0]}").isNotNull())
    local = blocked.withColumns({c: aggregate(F.col(c)).over(inside) for c in columns})
    joined = local.join(carried, [by, "_block"], "left")
    return joined.withColumns({c: F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(combine(F.col(c), F.col(f"_{c}"))) for c in columns}).drop("_block", *[f"_{c}" for c in columns])
