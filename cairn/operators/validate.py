"""Validation of boosted trees: AUC by fold, grids over parameters, and reports for rows of several labels.

Labels are 0/1 columns, one a label; a model is fitted for each. Rows whose label is null are not counted for that label.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.stored import stored
from cairn.operators import boost, metrics, sample
from cairn.operators.clean import quoted
from cairn.operators.explain import shuffled
from cairn.operators.score import boosted_out_of_fold, tree_probability


def fold_auc(frame: DataFrame, columns: Sequence[str], outcome: str, id_column: str, folds: int = 10, trees: int = 60, depth: int = 4, rate: float = 0.1) -> DataFrame:
    """(fold, auc) of trees fitted on the other folds, which are equal in each class; fewer folds where a class is smaller."""
    k = sample.fold_count(sample.class_counts(frame, outcome), folds)
    split = sample.folds(frame, outcome, k, id_column)
    _, scored = boosted_out_of_fold(split, columns, outcome, [outcome], k, trees, depth, rate, 1.0)
    # Small jobs of folds that don't wait for each other.
    area = inheritable_thread_target(frame.sparkSession)(lambda i: (i, metrics.auc(scored.where(F.col("fold") == i), "probability", quoted(outcome) == 1).first()["auc"]))
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(area, range(k)))
    return frame.sparkSession.createDataFrame(found, "fold int, auc double")


def fit_labels(frame: DataFrame, columns: Sequence[str], labels: Sequence[str], trees: int = 100, depth: int = 5, rate: float = 0.1) -> dict:
    """A model for each label, all grown in the same passes. A label of one class has its share (0 or 1) for a model; one without rows has 0."""
    # A row of counts.
    counts = frame.agg(*[f(quoted(c)).cast("long").alias(f"_{k}{i}") for i, c in enumerate(labels) for k, f in (("n", F.count), ("p", F.sum))]).first()
    both = [c for i, c in enumerate(labels) if 0 < (counts[f"_p{i}"] or 0) < counts[f"_n{i}"]]
    models: dict = {c: float((counts[f"_p{i}"] or 0) > 0) for i, c in enumerate(labels)}
    if both:
        how = boost.Settings(trees, depth, rate, 1.0, 1.0)
        models.update(zip(both, boost.fit(frame, columns, [boost.Model(c, settings=how) for c in both], columns).models))
    return models


def label_probabilities(models: Mapping, frame: DataFrame, id_column: str) -> DataFrame:
    """(id, label, y, probability): a row for each label of each row."""
    out = None
    for c, model in models.items():
        keep = [id_column, c]
        part = frame.select(*[quoted(x) for x in keep], F.lit(model).alias("probability")) if isinstance(model, float) else tree_probability(model, frame, keep)
        part = part.select(quoted(id_column), F.lit(c).alias("label"), quoted(c).cast("int").alias("y"), "probability")
        out = part if out is None else out.unionByName(part)
    return out


def _counts(long: DataFrame, by: Sequence[Column], threshold: float) -> DataFrame:
    hit = (F.col("probability") >= threshold).cast("int")
    return long.where("y is not null").groupBy(*by).agg(F.sum(hit * F.col("y")).alias("tp"), F.sum(hit * (1 - F.col("y"))).alias("fp"), F.sum((1 - hit) * F.col("y")).alias("fn"), F.sum("y").alias("support"))


def _f1() -> Column:
    return F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))


def label_report(long: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(label, precision, recall, f1, support) of label probabilities; "micro" sums all labels. 0/0 is 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    each = _counts(long, [F.col("label")], threshold)
    every = each.unionByName(each.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")]).select(F.lit("micro").alias("label"), "*"))
    return every.select("label", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"), _f1().alias("f1"), "support")


def label_auc(long: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label, auc): of each label, of all their rows together ("micro") and the labels' mean ("macro"). Null where a label has one class only; "macro" then too."""
    positive = F.col("y") == 1
    each = None
    for c in labels:
        part = metrics.auc(long.where(F.col("label") == c), "probability", positive).select(F.lit(c).alias("label"), "auc")
        each = part if each is None else each.unionByName(part)
    macro = each.agg(F.when(F.count("auc") == len(labels), F.avg("auc")).alias("auc")).select(F.lit("macro").alias("label"), "auc")
    micro = metrics.auc(long, "probability", positive).select(F.lit("micro").alias("label"), "auc")
    return each.unionByName(micro).unionByName(macro)


def grid_search(frame: DataFrame, columns: Sequence[str], labels: Sequence[str], id_column: str, trees: Sequence[int] = (50, 100, 200), depths: Sequence[int] = (5, 9, 13), rates: Sequence[float] = (0.01, 0.05, 0.1), folds: int = 3) -> DataFrame:
    """(trees, depth, rate, f1): the mean over folds of the F1 of all labels together, the best first (of equals the fewer and shallower trees)."""
    k = sample.fold_count({"all": frame.count()}, folds)
    split = sample.folds(frame.withColumn("_all", F.lit(0)), "_all", k, id_column).drop("_all")
    # Shorter models are the first trees of the longest, so one model serves all numbers of trees.
    cells = list(product(depths, rates, range(k), labels))
    models = [boost.Model(label, i, boost.Settings(max(trees), depth, rate, 1.0, 1.0)) for depth, rate, i, label in cells]
    fitted = boost.fit(split, columns, models, [id_column], "fold", [id_column], snapshots=trees)
    of = F.create_map(*[F.lit(x) for m, c in enumerate(cells) for x in (m, cells.index((c[0], c[1], c[2], labels[0])))])
    found = []
    for n in sorted(set(trees)):
        long = fitted.probabilities(n).where("left_out")
        # A row for each depth, rate and fold.
        f1 = {r["cell"]: r["f1"] for r in _counts(long.withColumn("cell", of[F.col("model")]), [F.col("cell")], 0.5).select("cell", _f1().alias("f1")).collect()}
        found += [(n, depth, float(rate), sum(f1.get(cells.index((depth, rate, i, labels[0])), 0.0) for i in range(k)) / k) for depth, rate in product(depths, rates)]
    found.sort(key=lambda r: (-r[3], r[0], r[1], r[2]))
    return frame.sparkSession.createDataFrame(found, "trees int, depth int, rate double, f1 double")


def auc_importance(model, test: DataFrame, columns: Sequence[str], outcome: str, id_column: str, repeats: int = 10) -> DataFrame:
    """(feature, importance): the mean over repeats of the AUC that a fitted model loses when a feature's values move to other rows, the largest first."""
    positive = quoted(outcome) == 1
    # All features' and repeats' values move in one shuffle, and are scored in one pass.
    scored = stored(tree_probability(model, shuffled(test, columns, id_column, repeats), [outcome, "feature", "repeat"]), "scored")
    area = lambda df: metrics.auc(df, "probability", positive).first()["auc"]
    base = area(scored.where("feature is null"))
    if base is None:
        raise ValueError("Both classes are needed to measure an AUC")
    found = [(c, sum(base - area(scored.where((F.col("feature") == c) & (F.col("repeat") == r))) for r in range(repeats)) / repeats) for c in columns]
    return test.sparkSession.createDataFrame(sorted(found, key=lambda r: (-r[1], r[0])), "feature string, importance double")
