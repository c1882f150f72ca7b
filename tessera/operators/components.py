"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). A step is
one aggregation with map-side combine and one join whose hot side adaptive
execution may split, so a hub with a third of all edges costs no single task.
Every round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import discard, new_path, stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _not_stars(edges: DataFrame) -> DataFrame:
    """Nodes that keep the edges from being stars: leaves of several centres, and centres that are leaves."""
    ends = edges.select("u", F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(edges.select(F.col("v").alias("u"), F.lit(0), F.lit(1)))
    roles = ends.groupBy("u").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return roles.where("leaf > 1 or leaf = 1 and centre = 1")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, staged: bool = False) -> DataFrame:
    """``(node, component)`` of every node that has an edge; the component is its smallest node.

    Nodes may be of any ordered type. Self-loops give a node of its own component;
    edges with a null end are ignored; an empty table gives an empty result.
    ``staged`` says that ``edges`` is a written table, which needs no further copy.
    """
    spark = edges.sparkSession
    clean = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    given = clean if staged else stage(clean, "edges")
    current, path = given.where("u <> v"), None
    for _ in range(max_rounds):
        now = new_path(spark, "stars")
        current = stage(_small_star(_large_star(current)), "stars", now)
        if path:
            discard(spark, path)
        path = now
        if _not_stars(current).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labelled = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = labelled.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    loops = given.where("u = v").select("u").distinct()
    if loops.isEmpty():
        return out
    alone = loops.join(out.select(F.col("node").alias("u")), "u", "left_anti")
    return out.union(alone.select(F.col("u").alias("node"), F.col("u").alias("component")))
