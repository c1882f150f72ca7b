"""Exact dedup through a log-structured merge index (operator 3; SQL functions only).

* *Memtables* take the digests of a slice of the scan and flush them as runs
  sorted by digest, one row for each digest, combined before the shuffle.
* Each run has a *filter*: a blocked Bloom filter of 16 bits a key whose three
  probes lie in one 4 KB block, so that one join on the block number tests a
  digest against all runs.
* *Compaction* merges only digests that the filter of another run may hold; all
  others pass through. It keeps the smallest (or largest) identifier.
* *Hits*, digests with two or more rows, are verified byte by byte: the least
  and the greatest normalised text of a digest must be equal. Both are combined
  before the shuffle, so a group with a third of all rows costs no single task.
  Digests that fail are split again by the texts themselves.

Texts equal after lower-casing A-Z are copies; a null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import bitmap
from tessera.llm.columns import free_name
from tessera.llm.text import ascii_lower
from tessera.plans.scratch import stage

MEMTABLES, BITS_A_KEY, PROBES = 16, 16, 3
#: Bits of the filter that picks the texts to verify: 4 MB, whatever the input.
HIT_BITS = 1 << 25


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "utf-8"), 256))


@dataclass
class MergeIndex:
    """rows: (row, id, digest) of every document; entries: (digest, best, group_size) after compaction."""

    rows: DataFrame
    runs: DataFrame
    filters: DataFrame
    entries: DataFrame


def _probes(digest: Column, blocks: int) -> tuple[Column, list[Column]]:
    block = F.pmod(F.xxhash64(digest), F.lit(blocks).cast("long"))
    return block, [F.pmod(F.xxhash64(digest, F.lit(i)), F.lit(bitmap.BLOCK).cast("long")) for i in range(1, PROBES + 1)]


def build_index(docs: DataFrame, id_col: str, text_col: str, keep: str = "smallest", memtables: int = MEMTABLES, digest: Callable[[Column], Column] = sha256) -> MergeIndex:
    """Flush all documents through memtables and compact the runs."""
    best = (lambda c: F.max(c)) if keep == "largest" else (lambda c: F.min(c))
    tie = -F.monotonically_increasing_id() if keep == "largest" else F.monotonically_increasing_id()
    rows = stage(
        docs.select(
            tie.alias("row"),
            F.col(id_col).alias("id"),
            digest(normalised(F.col(text_col))).alias("digest"),
            F.pmod(F.spark_partition_id(), F.lit(memtables)).alias("run"),
        ),
        "digests",
    )
    # A null id never outranks another: it stays only if no row of the group has an id.
    known = F.col("id").isNotNull()
    rank = F.struct((known if keep == "largest" else ~known).alias("r"), F.col("id"), F.col("row"))
    flushed = rows.groupBy("run", "digest").agg(best(rank).alias("best"), F.count(F.lit(1)).alias("n"))
    runs = stage(flushed.sortWithinPartitions("run", "digest"), "runs")

    blocks = max(1, -(-rows.count() * BITS_A_KEY // (memtables * bitmap.BLOCK)))
    block, bits = _probes(F.col("digest"), blocks)
    filters = stage(
        runs.select("run", block.alias("block"), F.explode(F.array(*bits)).alias("bit"))
        .groupBy("run", "block")
        .agg(F.bitmap_construct_agg("bit").alias("bitmap")),
        "filters",
    )
    # At most `memtables` bitmaps meet in a block.
    by_block = filters.groupBy("block").agg(F.collect_list(F.struct("run", "bitmap")).alias("filters"))
    elsewhere = F.exists("filters", lambda f: (f["run"] != F.col("run")) & _all([bitmap.bit_is_set(f["bitmap"], b) for b in bits]))
    probed = runs.withColumn("block", block).join(by_block, "block").select("digest", "best", "n", elsewhere.alias("hit"))
    merged = probed.where("hit").groupBy("digest").agg(best("best").alias("best"), F.sum("n").alias("group_size"))
    entries = stage(probed.where("not hit").select("digest", "best", F.col("n").alias("group_size")).unionByName(merged), "index")
    return MergeIndex(rows, runs, filters, entries)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _hit_texts(docs: DataFrame, hits: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """(id, digest, text) of the documents whose digest is among the hits; a fixed-size filter goes before the exact join."""
    own = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text")).withColumn("digest", digest(F.col("text")))
    near = bitmap.probe(own, F.col("digest"), bitmap.build(hits, F.col("digest"), HIT_BITS), HIT_BITS, "maybe")
    return near.where("maybe").drop("maybe")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memtables: int = MEMTABLES, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, digest, verified``.

    ``verified`` says that the bytes of the group were compared (groups of two or
    more). Of equal texts exactly one row is ``kept``, also where rows repeat an
    id. A null id stays only in a group without any id. An empty table gives an
    empty result; further columns of ``docs`` are ignored.
    """
    index = build_index(docs, id_col, text_col, keep, memtables, digest)
    hits = index.entries.where("group_size > 1")
    seen = _hit_texts(docs, hits, id_col, text_col, digest)
    # What the fixed-size filter let through by chance has one text a digest, and passes.
    failed = stage(seen.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("digest"), "failed")
    answered = (
        index.rows.join(hits, "digest", "left")
        .select(
            "id",
            "digest",
            F.coalesce(F.col("best")["id"], F.when(F.col("group_size").isNull(), F.col("id"))).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce(F.col("best")["row"] == F.col("row"), F.lit(True)).alias("kept"),
            F.col("group_size").isNotNull().alias("verified"),
        )
    )
    if failed.isEmpty():
        return answered
    return answered.join(failed, "digest", "left_anti").unionByName(_by_text(docs, failed, id_col, text_col, keep, digest))


def _by_text(docs: DataFrame, failed: DataFrame, id_col: str, text_col: str, keep: str, digest) -> DataFrame:
    """The answer for digests that stand for several texts, by the texts themselves."""
    tied = stage(_hit_texts(docs, failed, id_col, text_col, digest).join(failed, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()), "collisions")
    known = F.col("id").isNotNull()
    rank = F.struct((known if keep == "largest" else ~known).alias("r"), F.col("id"), F.col("row"))
    groups = tied.groupBy("digest", "text").agg((F.max if keep == "largest" else F.min)(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return tied.join(groups, ["digest", "text"]).select(
        "id", "digest", F.col("best")["id"].alias("keep_id"), "group_size", (F.col("best")["row"] == F.col("row")).alias("kept"), (F.col("group_size") > 1).alias("verified")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` without the rows that :func:`dedup` drops; all columns as they were.

    Only rows that a fixed-size filter of the dropped digests lets through take
    part in the join; the texts of all others are never shuffled.
    """
    said = stage(dedup(docs, id_col, text_col, keep), "verdicts")
    pairs = said.groupBy("id", "digest").agg(F.sum(F.col("kept").cast("int")).alias("stay"), F.count(F.lit(1)).alias("n"))
    pairs = stage(pairs.where("n > stay").select("id", "digest", "stay"), "pairs")
    own, maybe, gone_id, gone = (free_name(docs, x) for x in ("_digest", "_maybe", "_gone_id", "_gone_digest"))
    marked = docs.withColumn(own, sha256(normalised(F.col(text_col))))
    marked = bitmap.probe(marked, F.col(own), bitmap.build(pairs, F.col("digest"), HIT_BITS), HIT_BITS, maybe)
    touched = marked.where(F.col(maybe))
    match = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone))
    names = [F.col("id").alias(gone_id), F.col("digest").alias(gone)]
    free = marked.where(~F.col(maybe)).unionByName(touched.join(pairs.select(*names), match, "left_anti"))
    repeated = pairs.where("stay > 0").select(*names)
    if not repeated.isEmpty():
        free = free.unionByName(touched.join(repeated, match, "left_semi").dropDuplicates([id_col, own]))
    return free.drop(own, maybe)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the row that stands for its text; the largest doc_id stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup(docs, keep="largest").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


SQL = {
    "op3_exact_dedup": """
    with d as (
      select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
      from documents)
    select doc_id, max(doc_id) over (partition by text_sha256) as keep_id,
           count(*) over (partition by text_sha256) as group_size,
           doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
    from d"""
}
