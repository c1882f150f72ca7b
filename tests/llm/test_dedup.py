import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm import bitmap, exact_dedup


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_against_brute_force(spark, docs, cases):
    for keep, best in (("smallest", min), ("largest", max)):
        groups = defaultdict(list)
        for i, t in cases:
            groups[hashlib.sha256(lower(t).encode()).hexdigest()].append(i)
        got = exact_dedup.dedup(docs(cases), keep=keep, memtables=3).withColumn("h", F.lower(F.hex("digest"))).collect()
        assert len(got) == len(cases)
        for r in got:
            ids = [i for i in groups[r["h"]] if i is not None]
            assert r["group_size"] == len(groups[r["h"]]) and r["keep_id"] == (best(ids) if ids else None)
        kept = defaultdict(int)
        for r in got:
            kept[r["h"]] += r["kept"]
        assert set(kept.values()) == {1}


def test_colliding_digests_are_split_by_bytes(docs):
    rows = [(i, f"text {i % 5}") for i in range(40)]
    got = exact_dedup.dedup(docs(rows), digest=lambda t: F.unhex(F.lit("00"))).collect()
    assert len(got) == 40 and {r["group_size"] for r in got} == {8} and sorted({r["keep_id"] for r in got}) == [0, 1, 2, 3, 4]
    assert sum(r["kept"] for r in got) == 5


def test_keep_one_keeps_columns_and_clean_rows(docs, cases):
    df = docs(cases)
    out = exact_dedup.keep_one(df)
    assert out.columns == df.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "")[:20]) for r in out.collect())
    assert [g[1] for g in got if not g[0]] == [1, 3, 5, 6, 7, 8] and sum(g[0] for g in got) == 1


def test_empty_table(docs):
    assert exact_dedup.dedup(docs([])).count() == 0 and exact_dedup.keep_one(docs([])).count() == 0


def test_filters_never_miss(spark):
    keys = random.Random(0).sample(range(10**9), 500)
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    bits = 1 << 16
    out = bitmap.probe(df.union(spark.range(10**9 + 1, 10**9 + 1001).toDF("k")), F.col("k"), bitmap.build(df, F.col("k"), bits), bits, "hit")
    rows = out.groupBy((F.col("k") <= 10**9).alias("own")).agg(F.avg(F.col("hit").cast("int")).alias("share")).collect()
    share = {r["own"]: r["share"] for r in rows}
    assert share[True] == 1.0 and share[False] < 0.1
