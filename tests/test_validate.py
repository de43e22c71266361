"""Validation of trees over folds, grids and several labels, and the sums of the logistic fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import cluster, features, score, validate


@pytest.fixture(scope="module")
def cohort(spark):
    r = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2], "xyz"[int(v * 3)], float(v), int((i % 2 == 1) != (v > 0.95)), int(v > 0.5) if i % 11 else None, 1) for i, v in enumerate(r.random(160))]
    return spark.createDataFrame(rows, "id long, side string, third string, v double, y int, late int, sure int").persist()


def area(y, p):
    pos, neg = [q for k, q in zip(y, p) if k == 1], [q for k, q in zip(y, p) if k == 0]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_newton_sums_agree_on_driver_and_in_tasks(cohort, monkeypatch):
    a = score.fit_logistic(cohort, ["side", "third"], "y")
    monkeypatch.setattr(score, "LOCAL_PATTERNS", 0)
    b = score.fit_logistic(cohort, ["side", "third"], "y")
    assert a.coefficients.keys() == b.coefficients.keys()
    np.testing.assert_allclose([a.intercept, *a.coefficients.values()], [b.intercept, *b.coefficients.values()], atol=1e-10)


def test_fold_auc(cohort):
    got = [tuple(r) for r in validate.fold_auc(cohort, ["side"], "y", "id", folds=3, trees=3).orderBy("fold").collect()]
    assert [f for f, _ in got] == [0, 1, 2] and all(0.85 < a <= 1 for _, a in got)
    with pytest.raises(ValueError, match="two rows of each class"):
        validate.fold_auc(cohort, ["side"], "sure", "id", folds=1)


def test_several_labels(spark, cohort):
    labels = ["y", "late", "sure"]
    models = validate.fit_labels(cohort, ["side", "v"], labels, trees=3, depth=2)
    assert models["sure"] == 1.0
    long = validate.label_probabilities(models, cohort, "id").persist()
    assert long.count() == 3 * cohort.count()
    rows = long.where("y is not null").toPandas()
    report = {r["label"]: r for r in validate.label_report(long).collect()}
    for name in [*labels, "micro"]:
        part = rows if name == "micro" else rows[rows.label == name]
        hit = part.probability >= 0.5
        tp, fp, fn = int((hit & (part.y == 1)).sum()), int((hit & (part.y == 0)).sum()), int((~hit & (part.y == 1)).sum())
        r = report[name]
        assert (r["precision"], r["recall"], r["f1"], r["support"]) == pytest.approx((tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn))
    got = {r["label"]: r["auc"] for r in validate.label_auc(long, labels).collect()}
    assert got["sure"] is None and got["macro"] is None
    two = long.where("label <> 'sure'")
    got = {r["label"]: r["auc"] for r in validate.label_auc(two, labels[:2]).collect()}
    each = {n: area(*zip(*rows[rows.label == n][["y", "probability"]].to_numpy())) for n in labels[:2]}
    assert got["y"] == pytest.approx(each["y"]) and got["late"] == pytest.approx(each["late"]) and got["macro"] == pytest.approx(sum(each.values()) / 2)
    assert got["micro"] == pytest.approx(area(*zip(*rows[rows.label != "sure"][["y", "probability"]].to_numpy())))
    empty = {r["label"]: r["f1"] for r in validate.label_report(long.limit(0)).collect()}
    assert all(v == 0 for v in empty.values())
    lost = [tuple(r) for r in validate.auc_importance(models["y"], cohort, ["side", "v"], "y", "id", repeats=2).collect()]
    assert lost[0][0] == "side" and lost[0][1] > 0.2


def test_grid(cohort):
    got = validate.grid_search(cohort, ["side", "v"], ["y", "late"], "id", trees=(2,), depths=(0, 2), rates=(0.1,), folds=2).collect()
    assert [r["depth"] for r in got] == [2, 0] and 0.9 < got[0]["f1"] <= 1


def test_one_hot_and_hamming_layout(spark, cohort):
    hot = features.one_hot(cohort, ["side", "third"], ["id"])
    assert hot.columns == ["id", "side_a", "side_b", "third_x", "third_y", "third_z"]
    assert hot.where(F.expr("side_a + side_b <> 1 or third_x + third_y + third_z <> 1")).count() == 0
    places = cluster.layout(hot, "id", hot.columns[1:], 5, metric="hamming").toPandas()
    assert len(places) == cohort.count() and np.isfinite(places[["umap_dimension_1", "umap_dimension_2"]].to_numpy()).all()
