"""Evaluation metrics as relations: confusion, F1, precision-recall curves, AUC, average precision, thresholds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from .lineage import cut

BUCKETS = 1024  #: score ranges whose totals are summed first, so that no task orders all scores


def confusion(df: DataFrame, truth: str, pred: str, n_classes: int) -> DataFrame:
    """(truth, pred, n) for all pairs of classes."""
    axis = df.sparkSession.range(n_classes)
    full = axis.select(F.col("id").cast("int").alias("truth")).crossJoin(axis.select(F.col("id").cast("int").alias("pred")))  # n_classes squared rows
    counts = df.groupBy(F.col(truth).cast("int").alias("truth"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))
    return F.broadcast(full).join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def f1_report(matrix: DataFrame) -> DataFrame:
    """One row: accuracy, F1 averaged over classes that occur in truth or prediction, and each class's F1."""
    by_class = matrix.select(F.col("truth").alias("c"), "n", F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"), F.lit(0).cast("long").alias("called")).unionAll(matrix.select(F.col("pred").alias("c"), F.lit(0).cast("long"), F.lit(0).cast("long"), "n"))
    s = by_class.groupBy("c").agg(F.sum("n").alias("is"), F.sum("hit").alias("hit"), F.sum("called").alias("called"))
    s = s.withColumn("f1", ratio(2.0 * F.col("hit"), F.col("is") + F.col("called")))
    return s.agg(ratio(F.sum("hit").cast("double"), F.sum("is")).alias("accuracy"), F.coalesce(F.avg(F.when(F.col("is") + F.col("called") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_f1"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "f1")))).alias("f1"))


def _ranges(at: DataFrame, score: str, name: str) -> DataFrame:
    """at with the number of the score's range; NaN is above all. The bounds are BUCKETS - 1 numbers at most."""
    from pyspark.ml.feature import Bucketizer

    bounds = at.agg(F.percentile_approx(score, [i / BUCKETS for i in range(1, BUCKETS)], 4 * BUCKETS)).first()[0] or []
    splits = [float("-inf"), *sorted({float(x) for x in bounds if math.isfinite(x)}), float("inf")]
    if len(splits) < 3:
        return at.withColumn(name, F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=score, outputCol=name, handleInvalid="keep").transform(at)


def curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(threshold, pos, neg, tp, fp, n_pos, n_neg) at each distinct score, counting scores >= threshold. Sums run within
    score ranges and over the ranges' totals. Ranges hold about equally many distinct scores each, whatever their scale: their bounds come from
    a quantile sketch."""
    at = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.count("*").alias("_n")).withColumn("neg", F.col("_n") - F.col("pos")).drop("_n")
    at = _ranges(cut(at.filter(F.col("threshold").isNotNull()).withColumn("threshold", F.col("threshold").cast("double"))), "threshold", "_b")
    sums = at.groupBy("_b").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
    above = W.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = sums.select("_b", zero(F.sum("_p").over(above)).alias("_p"), zero(F.sum("_q").over(above)).alias("_q"), F.sum("_p").over(W.partitionBy()).alias("n_pos"), F.sum("_q").over(W.partitionBy()).alias("n_neg"))
    w = W.partitionBy("_b").orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    at = at.withColumn("tp", F.sum("pos").over(w)).withColumn("fp", F.sum("neg").over(w)).join(F.broadcast(sums), "_b")  # at most BUCKETS rows
    return at.select("threshold", "pos", "neg", (F.col("tp") + F.col("_p")).alias("tp"), (F.col("fp") + F.col("_q")).alias("fp"), "n_pos", "n_neg")


def pr_curve(c: DataFrame) -> DataFrame:
    return c.select("threshold", ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp").cast("double"), F.col("n_pos")).alias("recall"))


def auc(c: DataFrame) -> DataFrame:
    """Area under the ROC curve, ties half; 0.5 with one class only."""
    below = F.col("n_neg") - F.col("fp") + F.col("neg") / 2
    s = c.agg(F.sum(F.col("pos") * below).alias("_u"), F.max("n_pos").alias("_p"), F.max("n_neg").alias("_q"))
    return s.select(F.when((F.col("_p") > 0) & (F.col("_q") > 0), F.try_divide("_u", F.col("_p") * F.col("_q"))).otherwise(0.5).alias("auc_roc"))


def average_precision(c: DataFrame) -> DataFrame:
    """Sum of precision times the step in recall."""
    return c.agg(F.coalesce(F.sum(F.try_divide(F.col("pos"), F.col("n_pos")) * F.col("tp") / (F.col("tp") + F.col("fp"))), F.lit(0.0)).alias("auprc"))


def best_threshold(c: DataFrame) -> DataFrame:
    """Threshold of the largest F1, the lowest of equals; 0.5 and 0 without positives."""
    f1 = ratio(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("n_pos"))
    s = c.withColumn("f1", f1).agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("_t"), F.max("f1").alias("_f"))
    return s.select(F.when(F.col("_f") > 0, F.col("_t")).otherwise(0.5).alias("threshold"), F.coalesce("_f", F.lit(0.0)).alias("f1"))


def precision_at_recall(c: DataFrame, least: float = 0.8) -> DataFrame:
    return pr_curve(c).filter(F.col("recall") >= least).agg(F.coalesce(F.max("precision"), F.lit(0.0)).alias("precision_at_recall"))


def at_threshold(df: DataFrame, truth: str, score: str, threshold: float) -> DataFrame:
    """F1, accuracy, positives and negatives with prediction score >= threshold."""
    y, p = F.col(truth) == 1, F.col(score) >= threshold
    s = df.agg(F.count_if(y & p).alias("tp"), F.count_if(p).alias("called"), F.count_if(y).alias("n_pos"), F.count("*").alias("n"), F.count_if(y == p).alias("right"))
    return s.select(ratio(2.0 * F.col("tp"), F.col("called") + F.col("n_pos")).alias("f1"), ratio(F.col("right").cast("double"), F.col("n")).alias("accuracy"), "n_pos", (F.col("n") - F.col("n_pos")).alias("n_neg"))


def class_report(matrix: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: a map of accuracy, macro_f1 and f1_<name> of each class, in the classes' order of `matrix`."""
    entries = [F.lit("accuracy"), F.col("accuracy"), F.lit("macro_f1"), F.col("macro_f1")]
    for i, name in enumerate(names):
        entries += [F.lit(f"f1_{name}"), F.coalesce(F.try_element_at("f1", F.lit(i)), F.lit(0.0))]
    return f1_report(matrix).select(F.create_map(*entries).alias("metrics"))


def binary_report(c: DataFrame, threshold: DataFrame | float | None = None, least: float = 0.8) -> DataFrame:
    """One row: a map of all metrics of a curve at a threshold: a number, a row of best_threshold (chosen on other rows, as on
    val for test), or the curve's own best one. Everything is one aggregation over the curve."""
    if threshold is None:
        threshold = best_threshold(c)
    if isinstance(threshold, DataFrame):
        c = c.crossJoin(F.broadcast(threshold.select(F.col("threshold").alias("_t"))))  # one row
    else:
        c = c.withColumn("_t", F.lit(float(threshold)))
    called, hit = F.col("threshold") >= F.col("_t"), F.col("tp").cast("double")
    reached = ratio(hit, F.col("n_pos")) >= least
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    s = c.agg(
        F.max("n_pos").alias("p"), F.max("n_neg").alias("q"), F.max("_t").alias("t"), F.sum(F.col("pos") * (F.col("n_neg") - F.col("fp") + F.col("neg") / 2)).alias("u"),
        zero(F.sum(F.try_divide("pos", "n_pos") * hit / (F.col("tp") + F.col("fp")))).alias("ap"), zero(F.max(F.when(reached, ratio(hit, F.col("tp") + F.col("fp"))))).alias("pr"),
        F.sum(F.when(called, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(called, F.col("neg")).otherwise(0)).alias("fp"),
    )
    p, q, tp, fp = (F.coalesce(x, F.lit(0)).cast("double") for x in ("p", "q", "tp", "fp"))
    out = {
        "auc_roc": F.when((p > 0) & (q > 0), F.try_divide("u", p * q)).otherwise(0.5), "auprc": F.col("ap"), "f1": ratio(2 * tp, tp + fp + p), "accuracy": ratio(tp + q - fp, p + q),
        "threshold": F.coalesce("t", F.lit(0.5)), f"precision_at_recall_{least:g}": F.col("pr"), "n_pos": p, "n_neg": q,
    }
    return s.select(F.create_map(*(x for k, v in out.items() for x in (F.lit(k), v))).alias("metrics"))
