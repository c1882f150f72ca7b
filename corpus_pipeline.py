"""From raw documents to packed training batches.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of ``documents``, and further columns
as they were. An empty table gives an empty result in every stage. Rows may
repeat, lack an id or a text; the stages say what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, ngram_join, packing, pii, sentencepiece_viterbi, toxicity
from tessera.llm.columns import free_name
from tessera.plans.scratch import stage


#: Words whose ids a worker keeps while it packs, so that its memory is small beside that of the other stages.
REMEMBERED = 1 << 16


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. Labels come from the table ``labels``; null texts have the score of an empty text, equal texts have equal scores. Where the labels to learn from hold one class only, nothing can be told apart and every row stays."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model.trees is None:
        return docs
    score = free_name(docs, "_toxicity")
    return toxicity.with_score(docs, model, out=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z one row, that with the smallest doc_id; rows without an id come last, and a null text counts as empty."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share four fifths of their five-word shingles one row, that with the smallest doc_id; rows without an id come last, texts without words all stay."""
    return ngram_join.keep_one(docs, k=5, threshold=80, keep_unknown=False)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates under the key ``spark.tessera.pii.key``; ``n_chars`` follows the new text where it held the length of the old. Null texts stay null."""
    out = pii.replace_pii(docs, key=spark.conf.get("spark.tessera.pii.key", pii.KEY))
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of SentencePiece ids: where each segment of every document goes, and its ids. Null and empty texts give a segment without ids; rows that repeat an id are packed each."""
    encoded = sentencepiece_viterbi.encode(docs, remembered=REMEMBERED).select(F.col("id").alias("doc_id"), "ids")
    return packing.pack(encoded, tokens_col="ids").withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("pii", replace_personal_data),
    ("packing", pack_batches),
]

#: Toxicity is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
