"""Ranking metrics by window sums over distinct scores: ROC, AUC, thresholds, confusion profiles, score summaries.

Rows are summed by score first, and distinct scores are dealt to pieces, so no task gets all of them. A score with the rule "at most" (a low
score is positive) is negated for the curve and shown with its own sign.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.quantiles import quantiles
from cairn.functions.ranks import running_sums
from cairn.functions.stored import stored
from cairn.operators.clean import quoted


def _by_score(df: DataFrame, score: str, positive: Column, at_most: bool) -> DataFrame:
    s = quoted(score).cast("double")
    rows = df.select((-s if at_most else s).alias("s"), positive.cast("long").alias("y")).dropna()
    return rows.groupBy("s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))


def _running(df: DataFrame, score: str, positive: Column, at_most: bool) -> DataFrame:
    """(s, tp, fp, pos, neg) with scores descending, and tp and fp of the score before (last) and after (next). The counts by score are stored."""
    grouped = stored(_by_score(df, score, positive, at_most), "scores")
    total = F.broadcast(grouped.agg(F.sum("p").alias("pos"), F.sum("n").alias("neg")))
    sums = running_sums(grouped, "s", ["p", "n"])
    return sums.crossJoin(total).select("s", F.col("p_sum").alias("tp"), F.col("n_sum").alias("fp"), "pos", "neg", *[F.col(f"{a}_{x}").alias(f"{b}_{x}") for a, b in (("p", "tp"), ("n", "fp")) for x in ("last", "next")])


def roc_curve(df: DataFrame, score: str, positive: Column, at_most: bool = False, drop_collinear: bool = True) -> DataFrame:
    """(threshold, fpr, tpr): from (infinity, 0, 0) down to the least score. Points on a line between their neighbours are dropped."""
    points = _running(df, score, positive, at_most)
    if drop_collinear:
        bend = lambda c: F.col(f"{c}_last") - 2 * F.col(c) + F.col(f"{c}_next")
        points = points.withColumn("_b", bend("tp")).withColumn("_c", bend("fp")).where("_b is null or _b <> 0 or _c <> 0")
    sign = -1.0 if at_most else 1.0
    curve = points.select((F.col("s") * sign).alias("threshold"), F.try_divide("fp", "neg").alias("fpr"), F.try_divide("tp", "pos").alias("tpr"))
    start = df.sparkSession.createDataFrame([(sign * float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(curve)


def auc(df: DataFrame, score: str, positive: Column, at_most: bool = False) -> DataFrame:
    """(auc): trapezoids; ties count half."""
    points = _running(df, score, positive, at_most)
    before = lambda c: F.coalesce(f"{c}_last", F.lit(0))
    area = points.select(((F.col("fp") - before("fp")) * (F.col("tp") + before("tp")) / 2).alias("a"), "pos", "neg")
    return area.agg(F.try_divide(F.sum("a"), F.max("pos") * F.max("neg")).alias("auc"))


def threshold_at(curve: DataFrame, min_sensitivity: float = 0.9, at_most: bool = False) -> DataFrame:
    """(threshold, sensitivity, specificity): of the points with that sensitivity the most specific, of these the highest (for "at most" scores the lowest) threshold; else the most sensitive."""
    points = curve.select("threshold", F.col("tpr").alias("sensitivity"), (1 - F.col("fpr")).alias("specificity"))
    enough = F.col("sensitivity") >= min_sensitivity
    order = F.col("threshold") if at_most else -F.col("threshold")
    return points.orderBy(F.desc(enough), F.desc(F.when(enough, F.round("specificity", 12)).otherwise(F.col("sensitivity"))), order).limit(1)


def confusion_profile(df: DataFrame, score: str, positive: Column, at_most: bool = False) -> DataFrame:
    """One row for each distinct score as threshold: true and false positives and negatives and the ratios; 0/0 is null."""
    sign = -1 if at_most else 1
    counts = _running(df, score, positive, at_most)
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    fn, tn = pos - tp, neg - fp
    return counts.select(
        (F.col("s") * sign).alias("threshold"), tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"),
        F.try_divide(tp, pos).alias("sensitivity"), F.try_divide(tn, neg).alias("specificity"), F.try_divide(tp, tp + fp).alias("ppv"), F.try_divide(tn, tn + fn).alias("npv"), (tp + fp).alias("predicted_positive"), (tn + fn).alias("predicted_negative"),
    )


def score_summary(df: DataFrame, score: str, label: str) -> DataFrame:
    """(label, n, mean, median, deviation, p25, p75) of the score by class; the deviation is that of the population. Looks at the data for the quantiles."""
    s, kind = quoted(score).cast("double"), df.schema[label].dataType
    found = quantiles(df, {"s": s}, [0.25, 0.5, 0.75], by=quoted(label))
    # One row a class.
    at = df.sparkSession.createDataFrame([(of, x.at[0.5], x.at[0.25], x.at[0.75]) for (of, _), x in found.items()], "label string, median double, p25 double, p75 double")
    sums = df.groupBy(quoted(label).alias("label")).agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("deviation"))
    met = sums.alias("a").join(F.broadcast(at).alias("b"), F.col("a.label").cast("string").eqNullSafe(F.col("b.label")), "left")
    return met.select(F.col("a.label").cast(kind).alias("label"), "n", "mean", "median", "deviation", "p25", "p75")
