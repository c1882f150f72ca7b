"""Approximate nearest neighbours by cosine: a navigable small-world graph for each shard (operator 13).

*Shards.* Rows are dealt to shards by a hash of their id, about ``rows_per_shard``
in each, which a bound on rows and on components limits. A shard is built by one
task and written as one row of the index table: its vectors and a graph in flat
neighbour arrays. Every row is indexed.

*Graph.* Its nodes are the distinct directions of the shard in single precision, so
copies of one vector, however many, are one node with a list of rows. A node has a
level, drawn by a hash, a sixteenth of the nodes of each level reaching the next.
Nodes are stored by descending level, so that a level is a prefix of them and its
links one matrix of node numbers, -1 for none. Levels are built from the top; a
chunk of nodes searches the links made so far, meets its own members in one
product, and links to those of the found that are nearer to it than to each other,
which keeps links between clusters. Overfull lists are thinned by the same rule.

*Search.* Blocks of queries stream past a shard. A block descends the levels and
then keeps a beam of ``WIDTH`` nodes on the lowest; many queries advance in one
step, so that the work is in matrix products. The rows of the nodes found are
scored anew in double precision on the vectors as given. A window with a partial
limit merges the shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.topk_mtree import _block, _fitting
from tessera.plans.scratch import stage

#: Rows of a shard at least and at most, shards that a table is dealt to before they grow, and components that a shard holds at most (64 MB).
LEAST_ROWS, MOST_ROWS, SHARDS, HELD = 4096, 1 << 17, 16, 1 << 23
#: Links of a node on the upper levels and on the lowest, spare places before a list is thinned, nodes of a level for one of the next.
LINKS, LINKS_0, SPARE, STEP = 16, 32, 16, 16
#: Nodes kept while a graph is built, and while it is searched on the lowest and on the upper levels; nodes opened in a step.
BUILD_WIDTH, WIDTH, UPPER_WIDTH, OPENED = 48, 96, 4, 4
#: Queries of a block, and cells of the table of nodes that a step has seen.
QUERY_BLOCK, SEEN_CELLS = 1024, 1 << 24


def rows_per_shard(rows: int, dims: int) -> int:
    """A sixteenth of the table within the bounds: larger tables have larger shards, so that a query visits few of them."""
    return max(1, min(max(LEAST_ROWS, -(-rows // SHARDS)), MOST_ROWS, HELD // dims))


def usable(vector: Column) -> Column:
    """The vector in doubles; null if it is null, empty, zero or has a null or non-finite component."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(doubles, lambda x: x != 0)
    return F.when(F.coalesce(good, F.lit(False)), doubles)


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows and their lengths; rows whose squares leave the range of doubles are first scaled by a power of two, which changes no cosine."""
    with np.errstate(over="ignore", under="ignore"):
        squares = (x * x).sum(1)
    odd = ~(np.isfinite(squares) & (squares > 1e-280))
    if odd.any():
        x = x.copy()
        x[odd] = np.ldexp(x[odd], -np.frexp(np.abs(x[odd]).max(1))[1][:, None])
        squares[odd] = (x[odd] * x[odd]).sum(1)
    return x, np.sqrt(squares)


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``q`` up to ``width`` nodes with the highest products, best first, found along ``links`` from ``starts`` (-1: none); and the products."""
    at_once = max(1, SEEN_CELLS // max(1, len(links)))
    if len(q) > at_once:
        parts = [beam(x, links, q[i : i + at_once], starts[i : i + at_once], width) for i in range(0, len(q), at_once)]
        return tuple(np.concatenate(p) for p in zip(*parts))
    row = np.arange(len(q))[:, None]
    seen = np.zeros((len(q), len(links) + 1), bool)  # the last column stands for -1
    seen[:, -1] = True
    ids = np.full((len(q), width), -1, np.int32)
    sims = np.full((len(q), width), -np.inf, np.float32)
    opened = np.zeros((len(q), width), bool)

    def merge(live: np.ndarray, new: np.ndarray) -> None:
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[live[:, None], new]] = -1
        seen[live[:, None], new] = True
        found = np.where(new >= 0, np.matmul(x[new], q[live][:, :, None])[:, :, 0], -np.inf)
        every = np.concatenate([sims[live], found], axis=1)
        top = np.argpartition(-every, width - 1, axis=1)[:, :width]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(every, top, 1), axis=1, kind="stable"), 1)
        sims[live] = np.take_along_axis(every, top, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], new], axis=1), top, 1)
        opened[live] = np.take_along_axis(np.concatenate([opened[live], np.zeros_like(new, bool)], axis=1), top, 1)

    merge(row[:, 0], starts.astype(np.int32))
    while True:
        waiting = (ids >= 0) & ~opened
        live = np.flatnonzero(waiting.any(1))
        if not len(live):
            return ids, sims
        turn = waiting[live] & (waiting[live].cumsum(1) <= OPENED)
        opened[live] |= turn
        nodes = np.where(turn, ids[live], -1)
        nodes = -np.sort(-nodes, axis=1)[:, :OPENED]
        new = np.where(nodes[:, :, None] >= 0, links[nodes], -1)
        merge(live, new.reshape(len(live), -1))


def spread(x: np.ndarray, own: np.ndarray, candidates: np.ndarray, limit: int) -> np.ndarray:
    """For each node of ``own`` up to ``limit`` of its candidates (-1: none): from the nearest on those nearer to it than to any chosen before, then the nearest of the others."""
    out = []
    for i in range(0, len(own), 256):
        c = np.sort(candidates[i : i + 256], axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        c[c == own[i : i + 256, None]] = -1
        v = x[c]
        sims = np.where(c >= 0, np.matmul(v, x[own[i : i + 256]][:, :, None])[:, :, 0], -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        c, sims = np.take_along_axis(c, order, 1), np.take_along_axis(sims, order, 1)
        v = np.take_along_axis(v, order[:, :, None], 1)
        between = np.matmul(v, v.transpose(0, 2, 1))
        kept = np.zeros(c.shape, bool)
        for j in range(c.shape[1]):
            covered = (kept[:, :j] & (between[:, j, :j] >= sims[:, j, None])).any(1)
            kept[:, j] = (c[:, j] >= 0) & ~covered & (kept.sum(1) < limit)
        rank = np.where(c < 0, 2, np.where(kept, 0, 1))
        first = np.argsort(rank, axis=1, kind="stable")[:, :limit]
        chosen = np.take_along_axis(c, first, 1)
        out.append(np.pad(chosen, ((0, 0), (0, limit - chosen.shape[1])), constant_values=-1))
    return np.concatenate(out) if out else np.zeros((0, limit), np.int32)


def build_level(x: np.ndarray, above: list[np.ndarray], n: int, limit: int) -> np.ndarray:
    """Links among the first ``n`` nodes; ``above`` holds those of the higher levels, from the top."""
    room = limit + SPARE
    links, used = np.full((n, room), -1, np.int32), np.zeros(n, np.int64)
    done = 0
    while done < n:
        own = np.arange(done, min(n, done + max(64, min(512, done))), dtype=np.int32)
        near = x[own] @ x[own].T
        np.fill_diagonal(near, -np.inf)
        k = min(limit, len(own) - 1)
        candidates = own[np.argpartition(-near, k - 1, axis=1)[:, :k]] if k > 0 else np.full((len(own), 1), -1, np.int32)
        if done:
            entry = descend(x, above, x[own], done)
            found, _ = beam(x, links[:done], x[own], entry, BUILD_WIDTH)
            candidates = np.concatenate([candidates, found], axis=1)
        chosen = spread(x, own, candidates, LINKS)
        links[own, :LINKS] = chosen
        used[own] = (chosen >= 0).sum(1)
        links[own, :LINKS] = -np.sort(-chosen, axis=1)
        done = int(own[-1]) + 1
        # Links back: each target takes its new ones, as many at a time as it has room for.
        a, b = np.nonzero(chosen >= 0)
        source, target = own[a], chosen[a, b]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        while len(target):
            rank = np.arange(len(target)) - np.searchsorted(target, target, side="left")
            place = used[target] + rank
            fits = place < room
            links[target[fits], place[fits]] = source[fits]
            np.add.at(used, target[fits], 1)
            source, target = source[~fits], target[~fits]
            full = np.unique(target)
            if len(full):
                thinned = spread(x, full.astype(np.int32), links[full], limit)
                links[full] = -1
                links[full, :limit] = -np.sort(-thinned, axis=1)
                used[full] = (thinned >= 0).sum(1)
    over = np.flatnonzero(used > limit)
    if len(over):
        links[over, :limit] = spread(x, over.astype(np.int32), links[over], limit)
    return links[:, :limit].copy()


def descend(x: np.ndarray, above: list[np.ndarray], q: np.ndarray, within: int) -> np.ndarray:
    """Nodes below ``within`` from which a search of the next level may start."""
    starts = np.zeros((len(q), 1), np.int32)
    for links in above:
        starts, _ = beam(x, links, q, starts, UPPER_WIDTH)
    return np.where(starts < within, starts, -1) if (starts[:, 0] < within).all() else np.concatenate([np.zeros((len(q), 1), np.int32), np.where(starts < within, starts, -1)], axis=1)


def build_graph(x: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of the nodes by descending level, and the links of each level from the top, of unit vectors ``x`` with hashed ``marks``."""
    level = np.zeros(len(x), np.int64)
    bits = marks.astype(np.uint64)
    for i in range(1, 16):
        reached = bits % np.uint64(STEP) == 0
        level[reached & (level == i - 1)] = i
        bits = bits // np.uint64(STEP)
    order = np.lexsort((marks, -level))
    sizes = np.bincount(level, minlength=1)[::-1].cumsum()
    above: list[np.ndarray] = []
    for size in np.unique(sizes[sizes > 0]):
        if size < len(x) and size <= STEP:
            continue  # too few nodes for a level of their own
        above.append(build_level(x[order], above, int(size), LINKS_0 if size == len(x) else LINKS))
    return order, above


INDEX = "shard long, dims int, ids binary, vectors binary, nodes binary, starts binary, members binary, sizes array<int>, links binary"


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The written index: one row for each shard, with the vectors, the unit vectors of the nodes, the rows of each node and the links of each level."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), usable(F.col(vector_col)).alias("v")).where("id is not null and v is not null")
    rows = stage(rows.withColumn("mark", F.xxhash64("v", F.lit("level"))), "vectors")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    n, dims = int(facts["n"]), max(1, int(facts["dims"] or 1))
    shards = max(1, -(-n // rows_per_shard(n, dims)))

    def build(table: pa.Table) -> pa.Table:
        order = np.lexsort((np.asarray(table["mark"]), np.asarray(table["id"])))
        x = _block(table["v"].combine_chunks(), dims)[order]
        ids, marks = np.asarray(table["id"])[order], np.asarray(table["mark"])[order]
        scaled, lengths = _scaled(x)
        unit = (scaled / lengths[:, None]).astype(np.float32)
        nodes, first, node_of = np.unique(unit, axis=0, return_index=True, return_inverse=True)
        by, levels = build_graph(nodes, marks[first])
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        node_of = rank[node_of.ravel()]
        members = np.argsort(node_of, kind="stable")
        starts = np.searchsorted(node_of[members], np.arange(len(by) + 1))
        cells = {
            "shard": table["shard"][0].as_py(), "dims": dims, "ids": ids.tobytes(), "vectors": x.tobytes(), "nodes": nodes[by].tobytes(), "starts": starts.astype(np.int64).tobytes(),
            "members": members.astype(np.int64).tobytes(), "sizes": [len(a) for a in levels], "links": b"".join(np.ascontiguousarray(a).tobytes() for a in levels),
        }
        return pa.Table.from_pylist([cells], schema=_INDEX)

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards).cast("long")))
    return stage(dealt.repartitionByRange(shards, "shard").groupBy("shard").applyInArrow(build, INDEX), "index")


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
_INDEX = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in INDEX.split(", ")])


class Shard:
    """A row of the index, read back."""

    def __init__(self, row: dict):
        dims = row["dims"]
        self.ids, self.members, self.starts = (np.frombuffer(row[c], np.int64) for c in ("ids", "members", "starts"))
        self.vectors, self.lengths = _scaled(np.frombuffer(row["vectors"]).reshape(-1, dims))
        self.nodes = np.frombuffer(row["nodes"], np.float32).reshape(-1, dims)
        flat, at, self.levels = np.frombuffer(row["links"], np.int32), 0, []
        for i, size in enumerate(row["sizes"]):
            wide = LINKS_0 if i == len(row["sizes"]) - 1 else LINKS
            self.levels.append(flat[at : at + size * wide].reshape(size, wide))
            at += size * wide

    def nearest(self, ids: np.ndarray, q: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, row ids and cosines of the best ``k`` rows of other ids that are found."""
        q, lengths = _scaled(q)
        unit = (q / lengths[:, None]).astype(np.float32)
        found, _ = beam(self.nodes, self.levels[-1], unit, descend(self.nodes, self.levels[:-1], unit, len(self.nodes)), width)
        a, b = np.nonzero(found >= 0)
        node = found[a, b]
        out = []
        # A node of many rows is taken apart for a few queries at a time.
        count = self.starts[node + 1] - self.starts[node]
        held = np.add.reduceat(count, np.searchsorted(a, np.arange(len(q)))).cumsum() if len(a) else np.zeros(0)
        start = 0
        while start < len(held):
            end = max(start + 1, int(np.searchsorted(held, (held[start - 1] if start else 0) + (1 << 18), side="right")))
            here = (a >= start) & (a < end)
            rows = np.repeat(self.starts[node[here]] - np.concatenate([[0], count[here].cumsum()[:-1]]), count[here]) + np.arange(count[here].sum())
            rows, asked = self.members[rows], np.repeat(a[here], count[here])
            other = self.ids[rows] != ids[asked]
            rows, asked = rows[other], asked[other]
            score = np.einsum("ij,ij->i", q[asked], self.vectors[rows]) / (lengths[asked] * self.lengths[rows])
            by = np.lexsort((self.ids[rows], -score, asked))
            rows, asked, score = rows[by], asked[by], score[by]
            top = np.arange(len(asked)) - np.searchsorted(asked, asked, side="left") < k
            out.append((asked[top], self.ids[rows[top]], score[top]))
            start = end
        return tuple(np.concatenate(p) for p in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def search_index(index: DataFrame, queries: DataFrame, k: int = 5, width: int = WIDTH) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the nearest rows found for ``queries`` (id, v: vectors as ``usable`` gives them, no longer than those of the index; ids distinct)."""
    facts = index.agg(F.max("dims").alias("dims"), F.max("shard").alias("last")).first()
    empty = index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if facts["last"] is None:
        return empty
    dims, shards = int(facts["dims"]), int(facts["last"]) + 1
    blocks = max(1, -(-queries.count() // _fitting(QUERY_BLOCK, dims)))

    def pack(table: pa.Table) -> pa.Table:
        q = _block(table["v"].combine_chunks(), dims)
        return pa.table({"ids": pa.array([np.asarray(table["id"]).tobytes()], pa.binary()), "vectors": pa.array([q.tobytes()], pa.binary())})

    block = F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks).cast("long"))
    packed = stage(queries.withColumn("block", block).groupBy("block").applyInArrow(pack, "ids binary, vectors binary"), "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    shard, number = Shard(row), row["shard"]
                    continue
                if row["shard"] != number:  # no row was dealt to this shard
                    continue
                ids = np.frombuffer(row["ids"], np.int64)
                a, other, score = shard.nearest(ids, np.frombuffer(row["vectors"]).reshape(-1, dims), k, width)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(other), pa.array(score)], names=["query_id", "vec_id", "score"])

    # A shard comes first, then the blocks of queries, one after the other.
    own = index.withColumn("kind", F.lit(0))
    passing = packed.withColumn("kind", F.lit(1)).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    both = own.unionByName(passing, allowMissingColumns=True).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "kind")
    best = both.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, width: int = WIDTH) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest cosine found for each query among all rows but its own.

    Ties go to the smaller id. Vectors that are null, empty, zero or hold a null or
    non-finite component, and rows without an id, take no part; shorter vectors are
    padded with zeros. Rows that repeat an id count each as candidates, and once as a
    query, with the vector that sorts first; none of them is a candidate of its own
    id. Fewer than ``k`` candidates are all returned as far as the graph reaches
    them; an empty table gives an empty result. Further columns are ignored.
    """
    asked = vectors.where(F.coalesce(is_query, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), usable(F.col(vector_col)).alias("v"))
    asked = asked.where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))
    return search_index(build_index(vectors, id_col, vector_col), asked, k, width)


def op13_ann(spark, sf_dir: str) -> DataFrame:
    """Every fiftieth vector against all others."""
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
