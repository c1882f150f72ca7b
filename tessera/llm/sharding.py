"""Sharding by vector bin packing (operator 2).

Equal texts form a group that stays in one shard. A group is a vector of bytes,
tokens and rows; groups are placed, largest first, where the dot product with
the residual capacity is highest among the shards that still have room.

What the driver places has a fixed bound. A group is *heavy* if it has more than
``1 / (shards * RESOLUTION)`` of all bytes, tokens or rows, so there are at most
``3 * shards * RESOLUTION`` of them. All others are dealt by their digest into
``PARCELS`` parcels, each placed as one vector. Small tables consist of heavy
groups only and are placed group by group.

A heavy group is cut by a hash of the id into chunks of about one parcel's rows,
so no task numbers the rows of a hot group alone. Its chunks stay together
unless the group exceeds a shard in some dimension; then they are placed one by
one, since no shard could hold it and stay near the others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.columns import free_name
from tessera.llm.text import token_count
from tessera.plans.scratch import stage

SHARDS, RESOLUTION, PARCELS = 16, 256, 4096
DIMS = ("size", "tokens", "rows")


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each vector. Deterministic: ties go to the earlier vector and the lower shard."""
    if not len(vectors):
        return np.zeros(0, int)
    total = vectors.sum(axis=0)
    share = vectors / np.where(total > 0, total, 1)  # of the corpus, in each dimension
    room = np.full((shards, share.shape[1]), 1.0 / shards)
    out = np.zeros(len(share), int)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        fits = (room >= share[i] - 1e-12).all(axis=1)
        if fits.any():
            gain = np.where(fits, room @ share[i], -np.inf)
            out[i] = int(gain.argmax())
        else:  # least overflow in the fullest dimension
            out[i] = int((room - share[i]).min(axis=1).argmax())
        room[out[i]] -= share[i]
    return out


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, resolution: int = RESOLUTION, parcels: int = PARCELS) -> DataFrame:
    """``id, size, tokens, text_crc32, text_hash, shard, slot`` of every row.

    ``size`` is the text's UTF-8 bytes plus 1; a null text has none and counts as
    empty. Slots number the rows of a shard without gaps from 0. Rows that repeat
    an id get slots of their own; null ids are placed with their text's group. An
    empty table gives an empty result; further columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            token_count(text).alias("tokens"),
            F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
            _text_hash(F.col(text_col)).alias("text_hash"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    spark = docs.sparkSession
    total = rows.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).first()
    if not total["rows"]:
        return rows.select("id", "size", "tokens", "text_crc32", "text_hash", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    cut = {d: max(1.0, total[d] / (shards * resolution)) for d in DIMS}
    is_heavy = (F.col("size") > cut["size"]) | (F.col("tokens") > cut["tokens"]) | (F.col("rows") > cut["rows"])
    chunk_rows = max(1, total["rows"] // parcels)
    heavy = stage(
        rows.groupBy("text_hash").agg(*sums).where(is_heavy).select("text_hash", F.ceil(F.col("rows") / chunk_rows).cast("int").alias("chunks")),
        "heavy",
    )
    chunks = F.coalesce("chunks", F.lit(0))
    # At most 3 * shards * resolution rows of 12 bytes.
    dealt = rows.join(F.broadcast(heavy), "text_hash", "left").select(
        "id", "size", "tokens", "text_crc32", "text_hash",
        (chunks > 0).alias("heavy"),
        F.when(chunks > 0, F.col("text_hash")).otherwise(F.pmod("text_hash", F.lit(parcels).cast("long"))).alias("unit"),
        F.when(chunks > 0, F.pmod(F.xxhash64(F.col("id"), F.when(F.col("id").isNull(), F.col("row"))), chunks.cast("long"))).otherwise(F.lit(0)).cast("int").alias("chunk"),
    )
    units = dealt.groupBy("heavy", "unit", "chunk").agg(*sums).toPandas().sort_values(["heavy", "unit", "chunk"], ignore_index=True)
    placed = _place_units(units, shards)
    # One row for each unit's chunk: as many as were collected.
    where = F.broadcast(spark.createDataFrame(placed, "heavy boolean, unit long, chunk int, shard int, first long"))
    order = "row_number() over (partition by heavy, unit, chunk order by id, size, text_crc32, text_hash)"
    return dealt.withColumn("n", F.expr(order)).join(where, ["heavy", "unit", "chunk"]).select(
        "id", "size", "tokens", "text_crc32", "text_hash", "shard", (F.col("first") + F.col("n") - 1).alias("slot")
    )


def _place_units(units, shards: int):
    """Adds the shard and the first slot of each chunk."""
    units = units.copy()
    total = units[list(DIMS)].sum()
    whole = units.groupby(["heavy", "unit"], sort=False)[list(DIMS)].transform("sum")
    over = ((whole > total / shards) & (total > 0)).any(axis=1)
    units["item"] = units["unit"].astype(str) + units["heavy"].map({True: "h", False: "p"}) + units["chunk"].where(over, 0).astype(str)
    items = units.groupby("item", sort=False)[list(DIMS)].sum()
    units["shard"] = units["item"].map(dict(zip(items.index, place(items.to_numpy(float), shards)))).astype("int32")
    units["first"] = units.groupby("shard")["rows"].cumsum() - units["rows"]
    return units[["heavy", "unit", "chunk", "shard", "first"]]


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> None:
    """Write the rows of ``docs`` as Parquet below ``path``, one folder ``shard=`` for each shard.

    Every row is written once: rows that repeat an id find their places by id and
    text, and those that repeat both by a number among them. A column ``shard`` of
    ``docs`` would clash with the name of the folders and is written as ``_shard``,
    lengthened until it is free.
    """
    if "shard" in (c.lower() for c in docs.columns):
        docs = docs.withColumnRenamed("shard", free_name(docs, "_shard"))
    mark, at, own_id, own_mark, own_at, slot = (free_name(docs, x) for x in ("_mark", "_at", "_own_id", "_own_mark", "_own_at", "_slot"))
    numbered = lambda names: F.row_number().over(Window.partitionBy(*names).orderBy(*names))
    where = stage(assign(docs, id_col, text_col, shards), "places").withColumn("at", numbered(["id", "text_hash"]))
    where = where.select(F.col("id").alias(own_id), F.col("text_hash").alias(own_mark), F.col("at").alias(own_at), "shard", F.col("slot").alias(slot))
    own = docs.withColumn(mark, _text_hash(F.col(text_col))).withColumn(at, numbered([id_col, mark]))
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(mark) == F.col(own_mark)) & (F.col(at) == F.col(own_at))
    joined = own.join(where, same).drop(mark, at, own_id, own_mark, own_at)
    joined.repartition("shard", F.pmod(F.col(slot), F.lit(64))).sortWithinPartitions("shard", slot).drop(slot).write.partitionBy("shard").parquet(path)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 of near-equal bytes."""
    placed = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )
