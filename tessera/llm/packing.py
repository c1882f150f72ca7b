"""Packing into optimal length buckets (operator 1).

1. A text's length is its number of tokens: of ids where a column holds them, else
   of words, where each letter of a script without spaces is a word. Texts longer
   than ``max_length`` are cut into segments, so the histogram of lengths has at most ``max_length``
   entries whatever the input. It is counted over all segments.
2. Dynamic programming over that histogram chooses the bucket boundaries whose
   total padding is least. The cost of a bucket obeys the quadrangle inequality,
   so each layer is solved by divide and conquer.
3. Inside a bucket, token-budget batches take ``budget // boundary`` segments
   each. A bucket is dealt by a hash into groups of at least ``GROUP_BATCHES``
   full batches, which keeps a bucket with a third of all rows out of one task;
   only the last batch of a group may be short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import token_count
from tessera.plans.scratch import stage

BUCKETS, MAX_LENGTH, BUDGET, GROUP_BATCHES, GROUP_ROWS = 16, 4096, 65536, 64, 1024


def optimal_boundaries(lengths, counts, buckets: int) -> list[int]:
    """At most ``buckets`` upper boundaries, the last one the longest length, with the least padding."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    order = np.argsort(lengths)
    lengths, counts = lengths[order], counts[order]
    n, before = len(lengths), np.concatenate([[0], np.cumsum(counts)])
    if not n:
        return []
    # Padding is sum(boundary * rows) less the tokens, which no choice changes.
    best = lengths * before[1:]
    choice: list[np.ndarray] = []
    for _ in range(1, min(buckets, n)):
        ended = np.concatenate([[0], best])  # best cost of the first j lengths
        now, cut = np.empty(n, np.int64), np.zeros(n, np.int64)
        todo = [(0, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo >= hi:
                continue
            j = (lo + hi) // 2
            k = np.arange(a, min(b, j) + 1)
            cost = ended[k] + lengths[j] * (before[j + 1] - before[k])
            at = int(cost.argmin())
            now[j], cut[j] = cost[at], k[at]
            todo += [(lo, j, a, int(k[at])), (j + 1, hi, int(k[at]), b)]
        choice.append(cut)
        best = now
    out, j = [], n - 1
    for cut in reversed(choice):
        out.append(int(lengths[j]))
        j = int(cut[j]) - 1
        if j < 0:
            return out[::-1]
    out.append(int(lengths[j]))
    return out[::-1]


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_length: int = MAX_LENGTH, tokens_col: str | None = None) -> DataFrame:
    """``id, segment, start, length`` and with ``tokens_col`` also ``tokens``: whole texts in pieces of at most ``max_length`` tokens; an empty text has one of length 0."""
    n = F.coalesce(F.size(tokens_col), F.lit(0)).cast("long") if tokens_col else token_count(F.coalesce(F.col(text_col), F.lit("")))
    n = F.greatest(n, F.lit(0).cast("long"))
    own = docs.select(F.col(id_col).alias("id"), n.alias("words"), *([F.col(tokens_col).alias("all")] if tokens_col else []))
    length = F.least(F.lit(max_length).cast("long"), F.col("words") - F.col("start"))
    cut = F.when(F.col("words") > max_length, F.slice("all", (F.col("start") + 1).cast("int"), F.lit(max_length))).otherwise(F.coalesce("all", F.array().cast("array<int>"))) if tokens_col else None
    return (
        own.withColumn("segment", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("words") - 1) / max_length).cast("int")))))
        .withColumn("start", F.col("segment").cast("long") * max_length)
        .select("id", "segment", "start", length.alias("length"), *([cut.alias("tokens")] if tokens_col else []))
    )


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, max_length: int = MAX_LENGTH, budget: int = BUDGET, tokens_col: str | None = None) -> DataFrame:
    """``id, segment, start, length, bucket, boundary, pack_group, batch, slot`` of every segment, and its ``tokens`` where ``tokens_col`` holds ids.

    ``(bucket, pack_group, batch)`` names a batch; its segments have slots from 0 and
    are padded to ``boundary``. A batch never exceeds ``budget`` padded tokens
    (a boundary above the budget gives batches of one). Null texts count as empty;
    empty texts form segments of length 0, padded like others of their bucket.
    Rows that repeat an id are packed each. An empty table gives an empty result.
    """
    pieces = stage(segments(docs, id_col, text_col, max_length, tokens_col), "segments")
    # At most max_length + 1 rows.
    histogram = pieces.groupBy("length").count().toPandas()
    ends = optimal_boundaries(histogram["length"], histogram["count"], buckets)
    if not ends:
        ends = [0]
    rows = [int(histogram["count"][(histogram["length"] <= e) & (histogram["length"] > s)].sum()) for s, e in zip([-1, *ends], ends)]
    capacity = [max(1, budget // max(1, e)) for e in ends]
    groups = [max(1, r // max(GROUP_ROWS, GROUP_BATCHES * c)) for r, c in zip(rows, capacity)]
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("bucket") + 1)
    bucket = F.lit(len(ends) - 1)
    for k in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("length") <= ends[k], F.lit(k)).otherwise(bucket)
    dealt = (
        pieces.withColumn("bucket", bucket)
        .withColumn("boundary", pick(ends).cast("long"))
        .withColumn("pack_group", F.pmod(F.xxhash64("id", "segment"), pick(groups).cast("long")).cast("int"))
        .withColumn("n", F.expr("row_number() over (partition by bucket, pack_group order by length, id, segment)") - 1)
    )
    return dealt.select(
        "id", "segment", "start", "length", "bucket", "boundary", "pack_group",
        F.floor(F.col("n") / pick(capacity)).cast("int").alias("batch"), (F.col("n") % pick(capacity)).cast("int").alias("slot"),
        *(["tokens"] if tokens_col else []),
    )


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """Where each segment of every document goes."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
