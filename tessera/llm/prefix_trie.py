"""Prefix trie of conversations with sums over subtrees (operator 11).

*Nodes.* A turn is the SHA-256 of its role and text. The key of the first d turns
of a conversation is the exclusive or of 128 hashed bits for each (turn, place), a
running aggregate, so that equal prefixes have equal keys wherever they stand and
no sequence is ever gathered. A node is a distinct (d, key); its parent is the key
without the last turn. Two sequences under one key would be told by their last
turns or parents, which are compared; the job then fails instead of merging them.

*Heavy paths.* Each node's heavy child is the one with most members, ties to the
smaller conversation. A heavy path ends at a childless node, and all its nodes are
prefixes of that node's smallest member, so a path is named by a conversation: its
head is the deepest light node among that conversation's prefixes, and its level
the number of light ones. A light child has at most half of its parent's members,
so there are at most log2(conversations) + 1 levels.

*Sums.* Levels are done from the last to the first. A round takes the paths of one
level, adds to their nodes what light paths of the level below brought, forms the
suffix sums along each path, and hands the sum at each head to the head's parent.

*Skew.* Running aggregates go over blocks of rows whose totals are carried
on (``plans/running.py``), so neither a conversation of a third of all rows nor a path of that
length stands in one task. Texts are never shuffled. The digest over a node's
conversations is one SHA-256 of a sorted list, which only one task can form; it
streams the ids and holds none but a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.ordinals import number_rows
from tessera.plans.running import running
from tessera.plans.scratch import new_path, stage

#: Conversations of one family share the opening turns of its first, and at most this many of them.
FAMILY, OPENING = 5, 9
KEY = ["depth", "k1", "k2"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(conv_id, pos, digest, size)`` of each turn, places from 1, and ``(conv_id, n)`` of each conversation."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    ordered = stage(number_rows(stage(rows.where("conv_id is not null"), "turns"), F.col("conv_id"), F.col("turn"), F.col("digest")).drop("turn"), "numbered")
    convs = stage(ordered.groupBy("conv_id").agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("n")), "conversations")
    placed = ordered.join(convs, "conv_id").select("conv_id", (F.col("ordinal") - F.col("first") + 1).alias("pos"), "digest", "size")
    return placed, convs.select("conv_id", "n")


def rebuilt(placed: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rule of the corpus: conversation c opens with the first h turns of conversation c - c % ``FAMILY``, h = crc32(decimal c) % ``OPENING``, and goes on with its own after its first h.

    Gives ``(conv_id, depth, digest, size, length)`` and ``(conv_id, length)``.
    """
    families = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % OPENING).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    opened = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    facts = families.join(opened, "base", "left").withColumn("opening", F.least("h", F.coalesce("base_n", F.lit(0))))
    facts = stage(facts.withColumn("length", F.col("opening") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "opening", "length"), "facts")
    own = placed.join(facts, "conv_id").where("pos > h").select("conv_id", (F.col("opening") + F.col("pos") - F.col("h")).alias("depth"), "digest", "size", "length")
    heads = placed.where((F.col("pos") < OPENING) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    shared = heads.join(facts, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "digest", "size", "length")
    return own.unionByName(shared), facts.select("conv_id", "length")


def _ends(ends: DataFrame) -> DataFrame:
    """``depth, k1, k2, ends_sha256`` over the conversations (``conv_id``) that end at each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, out = None, None, []
        flush = lambda rows: pa.RecordBatch.from_pylist([dict(zip([*KEY, "ends_sha256"], [*k, d])) for k, d in rows], schema=_ENDS)
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in KEY]
            ids = batch.column("conv_id").to_pylist()
            changed = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for i, j in zip([0, *changed], [*changed, len(ids)]):
                if i == j:
                    continue
                key, said = tuple(int(k[i]) for k in keys), ",".join(map(str, ids[i:j])).encode()
                if key == held:
                    state.update(b"," + said)
                    continue
                if held is not None:
                    out.append((held, state.hexdigest()))
                held, state = key, hashlib.sha256(said)
            if len(out) >= 10_000:
                yield flush(out)
                out = []
        if held is not None:
            out.append((held, state.hexdigest()))
        yield flush(out)

    return ends.repartition(*KEY).sortWithinPartitions(*KEY, "conv_id").mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


_ENDS = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def trie(sequences: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie over ``sequences`` (conv_id, depth, digest, size, length) of the conversations in ``lengths`` (conv_id, length).

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``; the root has depth 0 and no text. No conversations: no nodes.
    """
    spark = lengths.sparkSession
    # Prefix keys: a running exclusive or of hashed (turn, place).
    part = lambda seed: F.xxhash64(F.lit(seed), "digest", "depth")
    marked = stage(sequences.withColumns({"x1": part(1), "x2": part(2)}).withColumns({"k1": F.col("x1"), "k2": F.col("x2")}), "sequences")
    keyed = running(marked, "conv_id", "depth", F.bit_xor, lambda a, b: a.bitwiseXOR(b), ["k1", "k2"])
    keyed = keyed.withColumns({"p1": F.col("k1").bitwiseXOR(F.col("x1")), "p2": F.col("k2").bitwiseXOR(F.col("x2"))})
    prefixes = stage(keyed.select("conv_id", *KEY, "p1", "p2", "digest", "size", "length"), "prefixes")

    same = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.raise_error(F.lit("two sequences have one key")).cast("long"))
    mark = F.xxhash64("digest")
    nodes = prefixes.withColumn("mark", mark).groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), same("p1").alias("p1"), same("p2").alias("p2"), same("size").alias("size"), same("mark").alias("mark")).drop("mark")
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", none.alias("p1"), none.alias("p2"), zero.alias("size"))
    nodes = stage(nodes.unionByName(root), "nodes")

    # Children, and the heavy one: most members, ties to the smaller conversation.
    up = (F.col("depth") - 1).alias("depth")
    below = nodes.where("depth > 0").select(up, F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.struct("n_convs", F.bitwise_not("conv_id").alias("small"), F.col("k1").alias("h1"), F.col("k2").alias("h2")).alias("child"))
    kids = below.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"), F.max("child").alias("heavy"))
    known = nodes.join(kids, KEY, "left").select(*nodes.columns, F.coalesce("n_children", zero).alias("n_children"), F.col("heavy.h1").alias("h1"), F.col("heavy.h2").alias("h2"))
    known = stage(known, "children")
    parents = known.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("h1").alias("o1"), F.col("h2").alias("o2"))
    light = (F.col("k1") != F.col("o1")) | (F.col("k2") != F.col("o2"))
    full = known.drop("h1", "h2").join(parents, ["depth", "p1", "p2"], "left").withColumn("light", F.coalesce(light, F.lit(False))).drop("o1", "o2")
    full = stage(full, "nodes")

    # Paths: one for each childless node, named by its smallest member.
    leaves = full.where("n_children = 0").select("conv_id", F.col("depth").alias("bottom"))
    along = prefixes.join(leaves, "conv_id").select(F.col("conv_id").alias("path"), *KEY)
    along = stage(along.join(full, KEY), "along")  # of each path's conversation, all prefixes but the root
    heads = along.groupBy("path").agg(F.max(F.when(F.col("light"), F.col("depth"))).alias("head"), F.count_if("light").cast("int").alias("level"))
    heads = leaves.select(F.col("conv_id").alias("path")).join(heads, "path", "left").select("path", F.coalesce("head", zero).alias("head"), F.coalesce("level", F.lit(0)).alias("level"))
    heads = stage(heads, "heads")
    on_path = along.join(heads, "path").where("depth >= head")
    top = full.where("depth = 0").join(heads.where("level = 0"), F.col("depth") == F.col("head"))  # the root and the one path that it begins
    values = {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("size")}
    path = new_path(spark, "paths")
    valued = on_path.unionByName(top.select(on_path.columns)).withColumns(values)
    valued.write.partitionBy("level").parquet(path)
    paths = spark.read.schema(valued.schema).parquet(path)

    deepest = heads.agg(F.max("level").alias("level")).first()["level"]
    sums, done, brought = ["n_leaves", "saved_tokens"], None, None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        here = paths.where(F.col("level") == level).drop("level")
        if brought is not None:
            here = here.join(brought, KEY, "left").withColumns({c: F.col(c) + F.coalesce(f"b_{c}", zero) for c in sums}).drop(*[f"b_{c}" for c in sums])
            here = stage(here, "attached")
        here = stage(running(here, "path", "depth", F.sum, lambda a, b: a + b, sums, descending=True), "level")
        brought = here.where("depth = head and depth > 0").groupBy(up, F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(*[F.sum(c).alias(f"b_{c}") for c in sums])
        done = here if done is None else done.unionByName(here)
    if done is None:
        done = paths.drop("level")
    ends = prefixes.where("depth = length").select(*KEY, "conv_id").unionByName(lengths.where("length = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id"))
    out = done.join(_ends(ends), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rebuild: bool = True) -> DataFrame:
    """One row for each distinct opening of the conversations in ``turns``, as ``trie`` returns them.

    Turns stand in the order of their number, null first, ties by the digest of role
    and text; rows that repeat are turns of their own. Null roles and texts count as
    empty. Rows without a conversation id belong to no conversation. ``rebuild``
    applies ``rebuilt`` first. An empty table gives an empty result; further columns
    are ignored.
    """
    placed, convs = numbered_turns(turns, conv_col, turn_col, role_col, text_col)
    if rebuild:
        return trie(*rebuilt(placed, convs))
    lengths = convs.withColumnRenamed("n", "length")
    return trie(placed.withColumnRenamed("pos", "depth").join(lengths, "conv_id"), lengths)


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie over all rebuilt conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: CRC-32 of the ASCII digits of an id, bit by bit.
_CRC = "xor(list_reduce(list_transform(string_split(cast(c as varchar), ''), lambda x: cast(ascii(x) as bigint)), lambda r, b: list_reduce(range(8), lambda v, i: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, xor(r, b)), cast(4294967295 as bigint)), 4294967295)"

SQL = {
    "op11_prefix_trie": f"""
    with o as (
      select conv_id as c, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) as turn_key, octet_length(encode(coalesce(text, ''))) as size, turn from conversations where conv_id is not null),
    t as (select c, list(struct_pack(k := turn_key, s := size) order by turn nulls first, turn_key) as ts from o group by c),
    h as (select c, ts, {_CRC} % {OPENING} as h from t),
    r as (select x.c, coalesce(b.ts, [])[1:x.h] || x.ts[x.h + 1:] as ts from h x left join h b on b.c = x.c - x.c % {FAMILY}),
    p as (
      select c, d, len(ts) as n, case when d > 0 then ts[d].s else 0 end as size, sha256(array_to_string(list_transform(ts[1:d], lambda x: x.k), ',')) as node, sha256(array_to_string(list_transform(ts[1:d - 1], lambda x: x.k), ',')) as parent
      from (select c, ts, unnest(range(len(ts) + 1)) as d from r)),
    g as (
      select d, node, min(c) as conv_id, count(*) as n_convs, any_value(parent) as parent, any_value(size) as size,
        sha256(coalesce(string_agg(case when n = d then cast(c as varchar) end, ',' order by c), '')) as ends_sha256
      from p group by d, node),
    k as (select d - 1 as d, parent as node, count(*) as n_children from g where d > 0 group by all),
    f as (select g.*, coalesce(n_children, 0) as n_children from g left join k using (d, node)),
    a as (select distinct u.d, u.node, v.d as below_d, v.node as below from p u join p v on u.c = v.c and u.d <= v.d),
    s as (
      select a.d, a.node, count(*) filter (f.n_children = 0) as n_leaves, cast(sum((f.n_convs - 1) * f.size) as bigint) as saved_tokens
      from a join f on f.d = a.below_d and f.node = a.below group by a.d, a.node)
    select f.conv_id, cast(f.d as bigint) as depth, q.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
    from f join s using (d, node) left join f q on f.d > 0 and q.d = f.d - 1 and q.node = f.parent"""
}
