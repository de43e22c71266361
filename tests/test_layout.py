"""Layouts of all rows: exact neighbours, groups that stay together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import cluster, layout, linkage


def frame(spark, x):
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, " + ", ".join(f"x{j} double" for j in range(x.shape[1]))).repartition(3)


@pytest.mark.parametrize("metric", [*cluster.METRICS, "hamming"])
def test_neighbours_are_the_nearest(spark, monkeypatch, metric):
    monkeypatch.setattr(layout, "ASKED", 64)
    monkeypatch.setattr(layout, "MET", 50)
    r = np.random.default_rng(3)
    x = r.integers(0, 3, (300, 6)).astype(float) + (r.normal(size=(300, 6)) if metric != "hamming" else 0)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "c long, x array<double>").repartition(3)
    got = {row["c"]: sorted(zip(row["far"], row["near"])) for row in layout.neighbours(points, 8, metric, 300).collect()}
    d = layout.distances(x, x, metric)
    np.fill_diagonal(d, np.inf)
    assert len(got) == 300
    for i in range(300):
        assert np.allclose([f for f, _ in got[i]], np.sort(d[i])[:8]) and all(np.isclose(d[i, j], f) for f, j in got[i]) and len({j for _, j in got[i]}) == 8


def test_the_table_is_not_sent_to_every_group(spark, monkeypatch):
    """Blocks meet where they are stored; met in several parts, or with many copies, the nearest are the same."""
    x = np.concatenate([np.random.default_rng(4).normal(size=(900, 3)), np.ones((200, 3)), np.zeros((5, 3))])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "c long, x array<double>")
    d = layout.distances(x, x, "euclidean")
    np.fill_diagonal(d, np.inf)
    for part in (64 << 20, 10_000):
        monkeypatch.setattr("cairn.functions.blocks.PART", part)
        found = layout.neighbours(points, 4, "euclidean", len(x))
        if part > 10_000:
            assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        got = {r["c"]: (sorted(r["far"]), set(r["near"])) for r in found.collect()}
        assert len(got) == len(x) and all(np.allclose(got[i][0], np.sort(d[i])[:4], atol=1e-7) and len(got[i][1] - {i}) == 4 for i in range(len(x)))


def test_what_is_found_is_not_sent(spark, monkeypatch):
    """A row meets all others in one task, however many files of blocks there are; pairs and the strongest are told in one shuffle."""
    monkeypatch.setattr("cairn.functions.blocks.PART", 10_000)
    points = spark.createDataFrame([(i, [float(i % 37), float(i)]) for i in range(1500)], "c long, x array<double>")
    near = layout.neighbours(points, 4, "euclidean", 1500)
    nearest = linkage.nearest(points.withColumn("s", F.lit(1.0)), points.withColumn("s", F.lit(1.0)), 1500, True)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (near, nearest, layout.edges(near, 4))]
    assert [plan.count("Exchange") for plan in plans] == [0, 0, 1]


def test_each_row_has_a_place_whatever_its_id(spark):
    x = np.random.default_rng(8).normal(size=(40, 3))
    df = frame(spark, x).withColumn("id", F.when(F.col("id") > 9, F.col("id") % 5 + 10))
    got = cluster.layout(df, "id", ["x0", "x1", "x2"], 5, rounds=1, epochs=3).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {None: 10, 10: 6, 11: 6, 12: 6, 13: 6, 14: 6}


def test_weights_add_up():
    far = np.sort(np.random.default_rng(1).random((40, 15)), axis=1)
    w = layout.weights(far)
    assert np.allclose(w.max(1), 1) and np.allclose(w.sum(1), np.log2(15), rtol=1e-3)


def test_edges_are_symmetric_and_bounded(spark):
    """A hub that all others have as their neighbour is drawn at by the strongest of them."""
    rows = [(i, [0] if i else [1], [0.1 * i + 0.1]) for i in range(50)]
    e = {(r["a"], r["b"]): r["w"] for r in layout.edges(spark.createDataFrame(rows, "c long, near array<long>, far array<double>"), 1).collect()}
    assert e[0, 1] == e[1, 0] and sum(a == 0 for a, _ in e) <= layout.REVERSE + 1 and all((i, 0) in e for i in range(1, 50))


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_groups_stay_together(spark, metric):
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(20 * np.eye(6)[g] if metric == "cosine" else 20 * g, 1, (400, 6)) for g in range(3)])
    found = cluster.layout(frame(spark, x), "id", [f"x{j}" for j in range(6)], 10, 0.1, metric, rounds=3, epochs=30).toPandas().sort_values("id")
    place = found[["umap_dimension_1", "umap_dimension_2"]].to_numpy()
    centre = np.array([place[400 * g : 400 * g + 400].mean(0) for g in range(3)])
    nearest = ((place[:, None, :] - centre[None, :, :]) ** 2).sum(-1).argmin(1)
    assert (nearest == np.repeat(np.arange(3), 400)).mean() > 0.95 and np.isfinite(place).all()
    # Neighbours in space are neighbours in the plane: by chance 0.075 of them are, as a group has 400 rows.
    d, e = layout.distances(x, x, metric), layout.distances(place, place, "euclidean")
    near = np.argsort(d, axis=1)[:, 1:11]
    plane = np.argsort(e, axis=1)[:, 1:31]
    assert np.mean([len(np.intersect1d(a, b)) / 10 for a, b in zip(near, plane)]) > 0.2


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    assert cluster.layout(frame(spark, np.zeros((3, 2))).limit(n), "id", ["x0", "x1"], 5, rounds=1).count() == n
