"""Boosted trees by second-order histograms: hand-worked splits, nulls, sampling, folds in the same passes, exact sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import boost, metrics, sample, score


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain(**more):
    return boost.Settings(**{"trees": 1, "depth": 1, "rate": 1.0, "subsample": 1.0, "columns": 1.0, "min_weight": 0.0, **more})


def one(frame, columns, label="y", **more):
    return boost.fit(frame, columns, [boost.Model(label, settings=plain(**more))], ["id"]).models[0]


def test_hand_worked_stump(spark):
    """Four of eight are 1, so p is 1/2, g is +-1/2 and h 1/4: the cut after 3 leaves three 0 on its left."""
    rows = [(i, float(i + 1), y) for i, y in enumerate([0, 0, 0, 1, 0, 1, 1, 1])]
    t = one(spark.createDataFrame(rows, "id long, v double, y int"), ["v"]).trees[0]
    assert (t.col[0], t.bin[0]) == (0, 2)
    # Left: g 1.5, h 0.75; right: g -1.5, h 1.25.
    assert [t.value[t.left[0]], t.value[t.right[0]]] == pytest.approx([-1.5 / 1.75, 1.5 / 2.25], abs=1e-6)


def test_nulls_take_the_side_that_gains(spark):
    r = [(i, float(i % 4) if i % 3 else None, int(i % 3 == 0 or i % 4 >= 2)) for i in range(60)]
    model = one(spark.createDataFrame(r, "id long, v double, y int"), ["v"])
    t = model.trees[0]
    assert (t.bin[0], t.null_left[0]) == (1, False)
    r = [(i, v, int(y == 0)) for i, v, y in r]
    r = [(i, None if v is None else -v, y) for i, v, y in r]
    t = one(spark.createDataFrame(r, "id long, v double, y int"), ["v"]).trees[0]
    assert t.col[0] == 0 and t.null_left[0] == (t.value[t.left[0]] < t.value[t.right[0]])
    # A node without nulls sends later ones to its larger side; NaN is null.
    full = spark.createDataFrame([(i, float(i >= 7), int(i >= 7)) for i in range(10)], "id long, v double, y int")
    model = one(full, ["v"])
    p = model.probability(spark.createDataFrame([(0, None), (1, float("nan")), (2, 0.0)], "id long, v double"), ["id"]).orderBy("id").collect()
    assert p[0][1] == p[1][1] == p[2][1] < 0.5


def test_text_is_one_value_against_the_rest(spark):
    rows = [(i, ["a", "b", None, "c"][i % 4], int(i % 4 == 2)) for i in range(40)]
    model = one(spark.createDataFrame(rows, "id long, s string, y int"), ["s"])
    got = {r["s"]: r["probability"] for r in model.probability(spark.createDataFrame([("a",), (None,), ("new",)], "s string"), ["s"]).collect()}
    assert got[None] > 0.5 > got["a"] == got["new"]
    # More values than bins: the rest share a code.
    made = boost.learn_bins(spark.createDataFrame([(v,) for v in "aaabbcd"], "s string"), ["s"], bins=2)
    assert made.values["s"] == ("a", "b") and made.sizes == [3]


def brute(x, y, depth, trees, rate, l2=1.0):
    """Trees over numbers by the definition: every cut at every value, all rows, no bins."""
    share = y.mean()
    margin = np.full(len(y), math.log(share / (1 - share)))

    def grow(at, g, h, left):
        whole = g[at].sum() ** 2 / (h[at].sum() + l2)
        best = (1e-6, None)
        if left:
            for c in range(x.shape[1]):
                for cut in np.unique(x[at, c])[:-1]:
                    a = at & (x[:, c] <= cut)
                    b = at & ~a
                    if h[a].sum() >= 1 and h[b].sum() >= 1:
                        gain = (g[a].sum() ** 2 / (h[a].sum() + l2) + g[b].sum() ** 2 / (h[b].sum() + l2) - whole) / 2
                        if gain > best[0] + 1e-9:
                            best = (gain, (a, b))
        if best[1] is None:
            margin[at] -= rate * g[at].sum() / (h[at].sum() + l2)
        else:
            for part in best[1]:
                grow(part, g, h, left - 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grow(np.ones(len(y), dtype=bool), p - y, p * (1 - p), depth)
    return 1 / (1 + np.exp(-margin))


@pytest.fixture(scope="module")
def numbers(spark):
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(400, 3)), 1)
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + r.normal(size=400) * 0.3 > 0).astype(int)
    rows = [(i, *map(float, v), int(k), i % 3) for i, (v, k) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, c double, y int, fold int").persist()


def test_equals_the_definition(numbers):
    x, y, frame = numbers
    model = one(frame, ["a", "b", "c"], trees=4, depth=3, rate=0.3, min_weight=1.0)
    got = [r["probability"] for r in model.probability(frame, ["id"]).orderBy("id").collect()]
    np.testing.assert_allclose(got, brute(x, y, 3, 4, 0.3), atol=1e-6)


def test_partitions_and_passes_do_not_count(numbers, monkeypatch):
    _, _, frame = numbers
    fit = lambda f: boost.fit(f, ["a", "b", "c"], [boost.Model("y", settings=boost.Settings(trees=3, depth=4))], ["id"]).models[0].trees
    first = fit(frame)
    assert fit(frame.repartition(7)) == first
    # One node a pass, margins stored after each tree.
    monkeypatch.setattr(boost, "SUMS", 1)
    monkeypatch.setattr(boost, "STORE", 1)
    again = fit(frame)
    assert again == first


def test_folds_and_labels_in_the_same_passes(numbers):
    _, _, frame = numbers
    both = frame.withColumn("z", F.when(F.col("id") % 5 != 0, (F.col("b") > 0).cast("int")))
    how = plain(trees=3, depth=2, rate=0.3)
    fitted = boost.fit(both, ["a", "b"], [boost.Model("y", 1, how), boost.Model("z", None, how)], ["id"], "fold", ["id"], snapshots=[1])
    made = boost.learn_bins(both, ["a", "b"])
    alone = boost.fit(both.where("fold <> 1"), ["a", "b"], [boost.Model("y", None, how)], ["id"], known=made).models[0]
    other = boost.fit(both.where("z is not null"), ["a", "b"], [boost.Model("z", None, how)], ["id"], known=made).models[0]
    assert fitted.models[0].trees == alone.trees and fitted.models[1].trees == other.trees
    # What the table holds is what the models say.
    held = {(r["id"], r["model"]): r for r in fitted.probabilities().collect()}
    said = {r["id"]: r["probability"] for r in fitted.models[0].probability(both, ["id"]).collect()}
    assert all(held[i, 0]["probability"] == pytest.approx(p) and held[i, 0]["left_out"] == (i % 3 == 1) for i, p in said.items())
    assert held[0, 1]["y"] is None and len(held) == 800
    short = boost.Boosted(fitted.models[0].bins, fitted.models[0].start, fitted.models[0].trees[:1])
    early = {r["id"]: r["probability"] for r in fitted.probabilities(1).where("model = 0").collect()}
    assert all(early[r["id"]] == pytest.approx(r["probability"]) for r in short.probability(both, ["id"]).collect())


def test_not_below_the_library(spark, numbers):
    """Held-out AUC beside the library's first-order trees, of the same number and depth."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    _, _, frame = numbers
    train, test = frame.where("fold <> 0"), frame.where("fold = 0")
    area = lambda df: metrics.auc(df, "probability", F.col("y") == 1).first()["auc"]
    mine = area(score.tree_probability(score.boosted_trees(train, ["a", "b", "c"], "y", trees=20, rate=0.1), test, ["y"]))
    put = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features")
    theirs = GBTClassifier(featuresCol="features", labelCol="y", maxIter=20, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=42).fit(put.transform(train))
    assert mine >= area(theirs.transform(put.transform(test)).select("y", vector_to_array("probability")[1].alias("probability"))) - 0.01


def test_awkward_tables(spark, numbers):
    _, _, frame = numbers
    empty = one(frame.limit(0), ["a"], trees=2)
    assert [t.col for t in empty.trees] == [[-1], [-1]] and empty.probability(frame.limit(3), ["id"]).count() == 3
    same = one(frame.withColumn("y", F.lit(1)), ["a"], trees=1)
    assert all(r[0] > 0.99 for r in same.probability(frame.limit(5), ["y"]).select("probability").collect())
    rows = spark.createDataFrame([(1, None, None, 1), (2, None, None, 0), (3, None, None, None)], "id long, `probability` double, `a.b` string, y int")
    got = one(rows, ["probability", "a.b"]).probability(rows, ["id", "a.b"])
    assert got.columns == ["id", "a.b", "probability"] and {r["probability"] for r in got.collect()} == {0.5}


def test_columns_are_sampled_by_tree():
    a = boost._allowed([4, 3, 9], [False, True, False], 0.5, 7, 0)
    assert sum(int(x.all()) if i != 1 else int(x.sum()) for i, x in enumerate(a)) == 3
    assert any(any((x != y).any() for x, y in zip(a, boost._allowed([4, 3, 9], [False, True, False], 0.5, 7, t))) for t in range(1, 5))
    assert all(x.all() for x in boost._allowed([4, 3], [False, True], 1.0, 7, 0))


def test_out_of_fold(numbers):
    _, _, frame = numbers
    k = sample.fold_count(sample.class_counts(frame, "y"), 3)
    models, scored = score.boosted_out_of_fold(frame, ["a", "b", "c"], "y", ["id", "y"], k, trees=10, rate=0.2)
    assert len(models) == 3 and scored.count() == 400 and scored.select("id").distinct().count() == 400
    assert metrics.auc(scored, "probability", F.col("y") == 1).first()["auc"] > 0.9
