"""Evaluation of scores: accuracy, AUC, robustness, calibration, errors, shortcuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.significance import correlation_p

#: Weights of the final score, and the rows that are no perturbation.
CLEAN_WEIGHT, ROBUST_WEIGHT, CLEAN, UNSEEN = 0.5, 0.5, "clean", "unseen_generator"


def accuracy(p: Column, y: Column, threshold: float = 0.5) -> Column:
    return F.avg(((p >= threshold) == (y == 1)).cast("double"))


def roc_auc(scores: DataFrame, by: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """``auc`` and ``n`` of each group; ties count half; null where one class is missing.

    Rows are first counted by distinct score, so the running total is over distinct
    scores, not rows.
    """
    counts = scores.groupBy(*by, F.col(p).alias("_p")).agg(F.sum((F.col(y) == 1).cast("long")).alias("a"), F.sum((F.col(y) != 1).cast("long")).alias("b"))
    over = f"sum(b) over ({'partition by ' + ', '.join(by) if by else ''} order by _p rows between unbounded preceding and current row)"
    below = counts.withColumn("below", F.expr(over) - F.col("b"))
    wins = F.sum(F.col("a") * (F.col("below") + F.col("b") / 2))
    a, b = F.sum("a"), F.sum("b")
    return below.groupBy(*by).agg(F.when((a > 0) & (b > 0), wins / (a * b)).alias("auc"), (a + b).alias("n"))


def robustness_table(scores: DataFrame, condition: str = "condition", p: str = "p", y: str = "y") -> DataFrame:
    """``condition, accuracy, auc, n``; a condition without rows has no line."""
    acc = scores.groupBy(condition).agg(accuracy(F.col(p), F.col(y)).alias("accuracy"))
    return acc.join(roc_auc(scores, [condition], p, y), condition)


def final_score(table: DataFrame, condition: str = "condition", clean_weight: float = CLEAN_WEIGHT, robust_weight: float = ROBUST_WEIGHT) -> DataFrame:
    """One row: weighted AUC of the clean row and of the mean over perturbations."""
    clean = F.max(F.when(F.col(condition) == CLEAN, F.col("auc")))
    robust = F.avg(F.when(~F.col(condition).isin(CLEAN, UNSEEN), F.col("auc")))
    return table.agg(clean.alias("clean_auc"), robust.alias("robust_auc"), (clean * clean_weight + robust * robust_weight).alias("final_score"))


def temperature_fit(logits: DataFrame, logit: str = "logit", y: str = "y", steps: int = 50) -> float:
    """The T > 0 that minimises binary cross-entropy of logit / T, by damped Newton on 1 / T; one aggregation a step.

    The loss is convex in 1 / T. With one class, or classes that the logit separates,
    the minimum lies at an end; 1 / T then stops at 1e-3 or 1e3.
    """
    beta = 1.0
    z, t = F.col(logit).cast("double"), F.col(y).cast("double")
    for _ in range(steps):
        q = 1 / (1 + F.exp(-F.lit(beta) * z))
        row = logits.agg(F.avg((q - t) * z).alias("g"), F.avg(q * (1 - q) * z * z).alias("h")).first()
        if row["g"] is None or abs(row["g"]) < 1e-10:
            break
        step = row["g"] / max(row["h"], 1e-12)
        now = min(1e3, max(1e-3, beta - max(-beta, min(beta / 2, step))))
        if abs(now - beta) < 1e-10:
            break
        beta = now
    return 1 / beta


def error_topk(scores: DataFrame, k: int = 10, p: str = "p", y: str = "y", key: str = "image_id") -> DataFrame:
    """The ``k`` surest false positives and false negatives, with ``kind`` and ``rank``."""
    fp = scores.where((F.col(y) == 0) & (F.col(p) >= 0.5)).orderBy(F.desc(p), key).limit(k).withColumn("kind", F.lit("false_positive"))
    fn = scores.where((F.col(y) == 1) & (F.col(p) < 0.5)).orderBy(F.asc(p), key).limit(k).withColumn("kind", F.lit("false_negative"))
    order = f"row_number() over (partition by kind order by if(kind = 'false_positive', -{p}, {p}), {key})"
    return fp.unionByName(fn).withColumn("rank", F.expr(order))


def source_accuracy(scores: DataFrame, generator: str = "generator", p: str = "p", y: str = "y") -> DataFrame:
    return scores.groupBy(generator).agg(accuracy(F.col(p), F.col(y)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def compression_proxy(size: Column, width: Column, height: Column, path: Column) -> Column:
    """Bytes a pixel; null for pseudo-paths."""
    return F.when(~path.contains("://"), size / F.greatest(F.lit(1), width * height))


def point_biserial(scores: DataFrame, binary: Column, proxy: str) -> DataFrame:
    """``r``, its two-sided ``p`` and ``n`` over rows with a proxy; ``r`` and ``p`` only with more than ten of them."""
    known = scores.where(F.col(proxy).isNotNull()).select(binary.cast("double").alias("b"), F.col(proxy).cast("double").alias("x"))
    found = known.agg(F.when(F.count(F.lit(1)) > 10, F.corr("b", "x")).alias("r"), F.count(F.lit(1)).alias("n"))
    return found.select("r", correlation_p(F.col("r"), F.col("n")).alias("p"), "n")


def shortcut_check(scores: DataFrame, proxy: str, p: str = "p", y: str = "y") -> DataFrame:
    """``against, r, p, n`` of the proxy with the label and with the prediction."""
    label = point_biserial(scores, F.col(y) == 1, proxy).select(F.lit("label").alias("against"), "r", "p", "n")
    return label.unionByName(point_biserial(scores, F.col(p) >= 0.5, proxy).select(F.lit("prediction").alias("against"), "r", "p", "n"))


def score_summary(scores: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Mean score over all rows, real rows and generated rows."""
    return scores.agg(F.avg(p).alias("overall"), F.avg(F.when(F.col(y) == 0, F.col(p))).alias("real"), F.avg(F.when(F.col(y) == 1, F.col(p))).alias("fake"), F.count(F.lit(1)).alias("n"))
