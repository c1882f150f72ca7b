"""Exact top-k inner-product search in an M-tree (operator 9).

*Metric.* With M the longest length, a vector x gets one more component,
sqrt(M^2 - |x|^2), and a query 0. Then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x: the
highest products are the nearest neighbours of a metric.

*Tree.* It grows by levels. A node of more rows than a page holds gets routing
objects, picked from a bounded sample of its rows, as many as the pages it needs
and ``FANOUT`` at most; its rows go to the nearest one. This repeats until each
node fills one page. A node whose sample is one vector repeated is cut into
pages by a hash, so copies fill many pages. A page is a row of a table with its
routing object and covering radius, and its leaves: for each its routing object,
distance to that of the page, covering radius, and the distance of each entry.

*Bounds.* Each query first meets the page that its own row lies in; its k-th best
there bounds the result from below.

*Search.* Pages come in groups of ``GROUP_PAGES``. A task holds one group and
streams blocks of ``QUERY_BLOCK`` queries past it. Each query takes the pages in
the order of their lower bounds; the queries of a block that are at the same page
are compared in one product. Pages, leaves and entries whose stored distances
prove, by the triangle inequality, that they are farther than the k-th best so
far are never compared. The best k of all groups are merged by a window with a
partial limit. Nothing is collected or broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import stage

#: Routing objects of a node, rows that they are picked from, rows of a page and of a leaf, pages of a group, queries of a block.
FANOUT, SAMPLE, PAGE_ROWS, LEAF_ROWS, GROUP_PAGES, QUERY_BLOCK = 64, 512, 2048, 256, 8, 2048
#: Rows that one task deals to routing objects at a time, and the deepest level of the tree.
CHUNK_ROWS, DEPTH = 16384, 9
#: Components that a page, a chunk or a block of queries holds at most: 16 MB.
HELD = 1 << 21
#: Lower bounds are lowered by this share, so that rounding never prunes a tie.
SLACK = 1e-7
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component x as double; null for a null vector or one with a null or non-finite component."""
    doubles = F.transform(vector, lambda x: x.cast("double") * scale)
    good = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # From 2^53 on every double is whole, and floor() would leave the range of a long.
    whole = F.transform(doubles, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    return F.when(F.coalesce(good, F.lit(False)), whole)


def _fitting(rows: int, dims: int) -> int:
    return max(1, min(rows, HELD // dims))


def _block(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as a matrix, shorter vectors padded with zeros."""
    flat = np.asarray(column.flatten(), float)
    if len(flat) == len(column) * dims:
        return flat.reshape(-1, dims)
    sizes = np.asarray(column.value_lengths())
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _augmented(x: np.ndarray, longest: float, unit: float = 1.0) -> np.ndarray:
    """Points of the metric; ``unit`` scales vectors whose squares leave the range of doubles, and ``longest`` is in that unit."""
    x = x * unit
    return np.hstack([x, np.sqrt(np.maximum(0.0, longest - (x * x).sum(1)))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T))


def routing_objects(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Up to ``k`` distinct rows: each next one is drawn with the square of its distance to those before it."""
    chosen, rng = [0], np.random.default_rng(seed)
    gap = _distances(x, x[:1])[:, 0] ** 2
    floor = 1e-12 * max(1.0, float((x[0] * x[0]).sum()))
    while len(chosen) < min(k, len(x)):
        gap[gap <= floor] = 0.0
        total = gap.sum()
        if total <= 0:
            break
        at = min(int(np.searchsorted(gap.cumsum(), rng.random() * total, side="right")), len(x) - 1)
        chosen.append(at)
        gap = np.minimum(gap, _distances(x, x[at : at + 1])[:, 0] ** 2)
    return np.array(chosen)


def grow(rows: DataFrame, longest: float, dims: int, unit: float = 1.0) -> DataFrame:
    """``rows`` (id, v, query, mark) with ``node``, each node small enough for a page, and ``pages`` (more than 1 only for repeated vectors)."""
    fanout, sample_rows, page_rows, chunk_rows = FANOUT, SAMPLE, _fitting(PAGE_ROWS, dims), _fitting(CHUNK_ROWS, dims)
    columns = "id long, v array<double>, query boolean, mark long"
    placed, done = rows.withColumn("node", F.lit(0).cast("long")), []

    def route(key: tuple, table: pa.Table) -> pa.Table:
        order = np.lexsort((np.asarray(table["mark"]), np.asarray(table["drawn"])))
        x = _augmented(_block(table["v"].combine_chunks(), dims), longest, unit)[order]
        need = -(-int(table["n"][0].as_py()) // max(1, page_rows // 2))
        chosen = x[routing_objects(x, max(2, min(fanout, need)))]
        return pa.table({"node": [key[0].as_py()], "routing": pa.array([chosen.tobytes()], pa.binary())})

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return left.select(["id", "v", "query", "mark", "node"]).append_column("flat", pa.array([], pa.bool_()))
        routing = np.frombuffer(right["routing"][0].as_py()).reshape(-1, dims + 1)
        x = _augmented(_block(left["v"].combine_chunks(), dims), longest, unit)
        node = np.asarray(left["node"])
        child = node * fanout + 1 + _distances(x, routing).argmin(1)
        flat = len(routing) == 1
        out = left.select(["id", "v", "query", "mark"]).append_column("node", pa.array(node if flat else child))
        return out.append_column("flat", pa.array(np.full(len(left), flat)))

    for level in range(DEPTH):
        counts = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        counts = stage(counts.withColumn("large", F.col("n") > page_rows), "nodes")
        large = counts.where("large").select("node", "n", F.ceil(F.col("n") / chunk_rows).cast("int").alias("chunks"))
        if large.isEmpty():
            done.append(placed.withColumn("pages", F.lit(1)))
            break
        done.append(placed.join(counts.where("not large").select("node"), "node", "left_semi").select("id", "v", "query", "mark", "node").withColumn("pages", F.lit(1)))
        open_rows = placed.join(large, "node")
        drawn = open_rows.withColumn("drawn", F.xxhash64("id", F.lit(level)))
        first = drawn.withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("drawn", "mark"))).where(F.col("at") <= sample_rows)
        routing = first.groupBy("node").applyInArrow(route, "node long, routing binary")
        routing = stage(routing.join(large, "node").select("node", "routing", "n", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")), "routing")
        dealt = open_rows.withColumn("chunk", F.pmod(F.xxhash64("id", "mark"), F.col("chunks").cast("long")).cast("int"))
        split = dealt.groupBy("node", "chunk").cogroup(routing.groupBy("node", "chunk")).applyInArrow(deal, f"{columns}, node long, flat boolean")
        split = stage(split, "placed")
        flat = split.where("flat").join(large, "node").withColumn("pages", F.ceil(F.col("n") / page_rows).cast("int"))
        done.append(flat.select("id", "v", "query", "mark", "node", "pages"))
        placed = split.where("not flat").drop("flat")
    else:  # deeper than any tree of distinct vectors that the levels can hold
        sizes = placed.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / page_rows).cast("int").alias("pages"))
        done.append(placed.join(sizes, "node").select("id", "v", "query", "mark", "node", "pages"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


PAGE = "pivot binary, radius double, ids binary, vectors binary, gaps binary, ends binary, leaf_pivots binary, leaf_ups binary, leaf_radii binary, q_ids array<long>, q_marks array<long>, q_lows array<long>"


def build_pages(placed: DataFrame, longest: float, dims: int, k: int, unit: float = 1.0) -> DataFrame:
    """One row for each page; ``q_*`` are the queries whose own row lies in it, with their first bounds."""
    leaf_rows = LEAF_ROWS
    page = F.pmod(F.xxhash64("id", "mark", F.lit("page")), F.col("pages").cast("long"))

    def build(table: pa.Table) -> pa.Table:
        order = np.lexsort((np.asarray(table["mark"]), np.asarray(table["id"])))
        x = _block(table["v"].combine_chunks(), dims)[order]
        ids, marks, asked = (np.asarray(table[c])[order] for c in ("id", "mark", "query"))
        f = _augmented(x, longest, unit)
        leaves = f[routing_objects(f, -(-len(f) // leaf_rows), seed=1)]
        gap = _distances(f, leaves)
        own = gap.argmin(1)
        by_leaf = np.argsort(own, kind="stable")
        own, x, f, ids, marks, asked = own[by_leaf], x[by_leaf], f[by_leaf], ids[by_leaf], marks[by_leaf], asked[by_leaf]
        used, starts = np.unique(own, return_index=True)
        leaves, gaps = leaves[used], gap[by_leaf, own]
        pivot = f[_distances(f, f.mean(0, keepdims=True))[:, 0].argmin()][None]
        radii = np.maximum.reduceat(gaps, starts)
        at = np.flatnonzero(asked)
        lows = np.concatenate([first_bounds(ids[at[i : i + 512]], x[at[i : i + 512]], ids, x, k) for i in range(0, len(at), 512)] or [np.zeros(0, np.int64)])
        cells = {
            "pivot": pivot.tobytes(), "radius": float(_distances(f, pivot).max()), "ids": ids.tobytes(), "vectors": x.tobytes(), "gaps": gaps.tobytes(),
            "ends": np.append(starts[1:], len(x)).astype(np.int64).tobytes(), "leaf_pivots": leaves.tobytes(), "leaf_ups": _distances(leaves, pivot)[:, 0].tobytes(),
            "leaf_radii": radii.tobytes(), "q_ids": ids[at].tolist(), "q_marks": marks[at].tolist(), "q_lows": lows.tolist(),
        }
        return pa.Table.from_pylist([cells], schema=_PAGE_SCHEMA)

    return placed.withColumn("page", page).groupBy("node", "page").applyInArrow(build, PAGE)


_KINDS = {"binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
_PAGE_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in PAGE.split(", ")])


def scores_of(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; those beyond a long count as the nearest long."""
    with np.errstate(over="ignore"):
        top = np.sqrt((q * q).sum(1).max(initial=0.0)) * np.sqrt((x * x).sum(1).max(initial=0.0))
    if top < 2.0**52:  # every partial sum is exact
        return (q @ x.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(q).dot(whole(x).T), LEAST, MOST).astype(np.int64)


def first_bounds(ids: np.ndarray, q: np.ndarray, other_ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among rows of other ids; the least long if there are fewer."""
    score = np.where(ids[:, None] == other_ids, LEAST, scores_of(q, x))
    if score.shape[1] < k:
        return np.full(len(ids), LEAST)
    return np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]


class Page:
    """A page read back from its row."""

    def __init__(self, row: dict, dims: int):
        part = lambda name, kind=float: np.frombuffer(row[name], kind)
        self.pivot, self.radius = part("pivot")[None], row["radius"]
        self.ids, self.gaps, self.ends = part("ids", np.int64), part("gaps"), part("ends", np.int64)
        self.x = part("vectors").reshape(-1, dims)
        self.leaves, self.ups, self.radii = part("leaf_pivots").reshape(-1, dims + 1), part("leaf_ups"), part("leaf_radii")
        self.leaf_of = np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))

    def open_entries(self, f: np.ndarray, to_pivot: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Rows of the page that some of the queries still has to compare."""
        near = np.abs(to_pivot[:, None] - self.ups) - self.radii <= limit[:, None]
        leaves = np.flatnonzero(near.any(0))  # the others are ruled out without a distance
        if not len(leaves):
            return leaves
        d = _distances(f, self.leaves[leaves])
        near = near[:, leaves] & (d - self.radii[leaves] <= limit[:, None])
        slot = np.full(len(self.ends), -1)
        slot[leaves] = np.arange(len(leaves))
        rows = np.flatnonzero(slot[self.leaf_of] >= 0)
        column = slot[self.leaf_of[rows]]
        keep = (near[:, column] & (np.abs(d[:, column] - self.gaps[rows]) <= limit[:, None])).any(0)
        return rows[keep]


def search(pages: list[Page], ids: np.ndarray, q: np.ndarray, lows: np.ndarray, longest: float, k: int, unit: float = 1.0):
    """The rows (query number, id, score) among which the best k of these pages are, best first."""
    f, low = np.hstack([q * unit, np.zeros((len(q), 1))]), lows.copy()
    square = (f * f).sum(1) + longest
    best = np.full((len(q), k), LEAST)
    # A query that accepts every score has no limit.
    limit_of = lambda at: np.where(low[at] == LEAST, np.inf, np.sqrt(np.maximum(0.0, square[at] - 2.0 * unit * (unit * low[at]))) * (1 + SLACK) + SLACK)
    to_pivot = np.hstack([_distances(f, p.pivot) for p in pages])
    least = to_pivot - np.array([p.radius for p in pages])
    order = np.argsort(least, axis=1, kind="stable")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for turn in range(len(pages)):
        turned = order[:, turn]
        live = np.flatnonzero(least[np.arange(len(q)), turned] <= limit_of(slice(None)))
        for p in np.unique(turned[live]):
            page, at = pages[p], live[turned[live] == p]
            for i in range(0, len(at), 512):
                part = at[i : i + 512]
                rows = page.open_entries(f[part], to_pivot[part, p], limit_of(part))
                if not len(rows):
                    continue
                score = scores_of(q[part], page.x[rows])
                good = (score >= low[part, None]) & (ids[part, None] != page.ids[rows])
                some = np.flatnonzero(good.any(1))
                if not len(some):
                    continue
                score, good, part = score[some], good[some], part[some]
                a, b = np.nonzero(good)
                found.append((part[a], page.ids[rows][b], score[a, b]))
                merged = np.hstack([best[part], np.where(good, score, LEAST)])
                best[part] = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
                low[part] = np.maximum(low[part], best[part].min(1))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    a, other, score = (np.concatenate(x) for x in zip(*found))
    keep = score >= low[a]
    a, other, score = a[keep], other[keep], score[keep]
    by = np.lexsort((other, ~score, a))
    a, other, score = a[by], other[by], score[by]
    first = np.searchsorted(a, a, side="left")
    top = np.arange(len(a)) - first < k
    return a[top], other[top], score[top]


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each query with all rows but its own.

    Ties go to the smaller id. Vectors that are null or hold a null or non-finite
    component, and rows without an id, take no part; shorter vectors are padded
    with zeros. Rows that repeat an id count each as candidates, and once as a
    query, with the vector that sorts first. A score beyond a long counts as the
    nearest long. Fewer than ``k`` candidates are all returned; an empty table
    gives none. Further columns are ignored.
    """
    spark, schema = vectors.sparkSession, "query_id long, vec_id long, score long"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = stage(rows.where("id is not null and v is not null").withColumn("mark", F.xxhash64("v")), "vectors")
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = rows.agg(F.max(length).alias("longest"), F.max(F.array_max(F.transform("v", F.abs))).alias("top"), F.max(F.size("v")).alias("dims"), F.sum(F.col("query").cast("long")).alias("queries")).first()
    if not facts["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    longest, dims, unit = float(facts["longest"]), max(1, int(facts["dims"])), 1.0
    if longest > 2.0**1000:
        unit = 2.0**-math.frexp(facts["top"])[1]
        longest = float(rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x * unit) * (x * unit)))).first()[0])
    pages = stage(build_pages(grow(rows, longest, dims, unit), longest, dims, k, unit), "pages")

    lows = pages.select(F.explode(F.arrays_zip(F.col("q_ids").alias("id"), F.col("q_marks").alias("mark"), F.col("q_lows").alias("low"))).alias("x")).select("x.*")
    lows = lows.groupBy("id", "mark").agg(F.max("low").alias("low"))
    asked = rows.where("query").groupBy("id").agg(F.min(F.struct("v", "mark")).alias("x")).select("id", "x.*")
    blocks, groups = -(-int(facts["queries"]) // _fitting(QUERY_BLOCK, dims)), -(-pages.count() // GROUP_PAGES)

    def pack(table: pa.Table) -> pa.Table:
        q = _block(table["v"].combine_chunks(), dims)
        cells = [np.asarray(table["id"]).tobytes(), q.tobytes(), np.asarray(table["low"]).tobytes()]
        return pa.table({n: pa.array([c], pa.binary()) for n, c in zip(("ids", "vectors", "lows"), cells)})

    block = F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks).cast("long"))
    packed = asked.join(lows, ["id", "mark"]).withColumn("block", block).groupBy("block").applyInArrow(pack, "ids binary, vectors binary, lows binary")
    packed = stage(packed, "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["grp"] != group:
                    group, held = row["grp"], []
                if row["kind"] == 0:
                    held.append(Page(row, dims))
                    continue
                ids = np.frombuffer(row["ids"], np.int64)
                a, other, score = search(held, ids, np.frombuffer(row["vectors"]).reshape(-1, dims), np.frombuffer(row["lows"], np.int64), longest, k, unit)
                for i in range(0, len(a), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a[part]]), pa.array(other[part]), pa.array(score[part])], names=["query_id", "vec_id", "score"])

    # A group's pages come first, then the blocks of queries, one after the other.
    own = pages.drop("q_ids", "q_marks", "q_lows").withColumn("grp", F.pmod(F.xxhash64("pivot", "ids"), F.lit(groups).cast("long"))).withColumn("kind", F.lit(0))
    passing = packed.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).withColumn("kind", F.lit(1))
    both = own.unionByName(passing, allowMissingColumns=True).repartition("grp").sortWithinPartitions("grp", "kind")
    best = both.mapInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    """Every twentieth vector against all others."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


SQL = {
    "op9_topk": """
    with v as (
      select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as double)) as e from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (
      select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
      from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
    select query_id, cast(rank as int) as rank, vec_id, score
    from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20"""
}
