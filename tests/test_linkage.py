"""Agglomeration in rounds against linkage of the whole matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import cluster, linkage


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>").repartition(3)


def labels(spark, x, k, ward, **options):
    got = {r["id"]: r["cluster"] for r in linkage.linked(frame(spark, x), "id", F.col("x"), k, ward, **options).collect()}
    return np.array([got[i] for i in range(len(x))])


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_rounds_equal_linkage_of_the_matrix(spark, metric):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(c, s, (500, 6)) for c, s in ((0, 1), (2, 0.5), (-3, 2), (5, 0.2))])
    assert (labels(spark, x, 7, metric == "euclidean", finish=800) == cluster.linkage_labels(x, 7, metric)).all()
    got = linkage.chained(np.arange(2000), np.ones(2000), (x - x.mean(0)) if metric == "euclidean" else x / np.linalg.norm(x, axis=1, keepdims=True), metric == "euclidean")
    assert len(got) == 1999 and len({c for c, _, _ in got}) == 1999


@pytest.mark.parametrize("part", [64 << 20, 20_000])
def test_nearest_clusters_of_any_weight(spark, monkeypatch, part):
    """Blocks meet where they are stored, in one part or several: the table isn't sent to every group."""
    monkeypatch.setattr("cairn.functions.blocks.PART", part)
    r = np.random.default_rng(7)
    x, s = r.normal(size=(700, 4)), r.integers(1, 400, 700).astype(float)
    clusters = spark.createDataFrame([(i, float(s[i]), v.tolist()) for i, v in enumerate(x)], "c long, s double, x array<double>")
    found = linkage.nearest(clusters.where("c % 3 = 0"), clusters, 700, True)
    if part > 20_000:
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1) * 2 * s[:, None] * s / (s[:, None] + s)
    np.fill_diagonal(d, np.inf)
    got = {row["c"]: (row["nn"], row["d"]) for row in found.collect()}
    assert set(got) == set(range(0, 700, 3)) and all(n == d[i].argmin() and np.isclose(v, d[i].min()) for i, (n, v) in got.items())


def test_ties_and_copies(spark):
    """A grid, whose distances are all alike, and rows that are the same many times over."""
    grid = [(a, b) for a in range(12) for b in range(12)]
    x = np.array(grid + [(50, 50)] * 300 + [(50, 51)] * 5, dtype=float)
    got = labels(spark, x, 2, True, finish=70)
    assert set(got[:144]) == {0} and set(got[144:]) == {1}
    assert set(labels(spark, np.ones((5, 2)), 3, True)) == {0}
    assert labels(spark, np.array([[0.0], [9.0]]), 2, True).tolist() == [0, 1]
    assert linkage.linked(frame(spark, x[:0]), "id", F.col("x"), 2, True).count() == 0


def test_roots(spark):
    up = spark.createDataFrame([(i, i - 1) for i in range(1, 20)] + [(40, 39)], "c long, into long")
    assert {(r["c"], r["root"]) for r in linkage.roots(up).collect()} == {(i, 0) for i in range(1, 20)} | {(40, 39)}


def test_names_of_columns(spark):
    df = spark.createDataFrame([(f"r{i}", float(i // 5 * 100 + i), 1.0, i) for i in range(10)], "`the id` string, a double, c double, x long")
    got = {r[0]: r[1] for r in cluster.agglomerative(df, "the id", ["a", "c"], 2).collect()}
    assert got == {f"r{i}": i // 5 for i in range(10)}


def test_steps_of_a_round(spark, monkeypatch):
    """A round stores three steps: its neighbours, what merges, and the blocks. Up to FINISH clusters need no round."""
    seen = []
    real = linkage.stored
    monkeypatch.setattr(linkage, "stored", lambda df, name="step": seen.append(name) or real(df, name))
    monkeypatch.setattr("cairn.functions.blocks.stored", lambda df, name="step": seen.append(name) or real(df, name))
    x = np.random.default_rng(11).normal(size=(1500, 5))
    wanted = cluster.linkage_labels(x, 6, "euclidean")
    assert (labels(spark, x, 6, True, finish=900) == wanted).all()
    steps = seen[seen.index("blocks") : seen.index("merges")]
    assert len(steps) > 3 and steps == ["blocks"] + ["nearest", "told", "blocks"] * (len(steps) // 3)
    seen.clear()
    assert (labels(spark, x, 6, True) == wanted).all() and "nearest" not in seen


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1.0, 1e4), (1e-3, 1e6), (1e-30, 0.0), (1e30, 0.0), (1e-3, 1.0)])
@pytest.mark.parametrize("ward", [True, False])
def test_single_precision_only_leaves_out(scale, offset, ward):
    """What it can't tell, as among vectors far from the origin or of tiny or huge numbers, is told by differences."""
    r = np.random.default_rng(13)
    x = np.concatenate([r.normal(size=(600, 8)) * scale + offset, r.normal(size=(40, 8)) * max(scale, 1.0)])
    s = r.integers(1, 50, len(x)).astype(float)
    if not ward:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = r.permutation(len(x))
    own, best = (c[:200], s[:200], x[:200]), [np.full(200, np.inf), np.full(200, 1 << 62), np.full(200, 1 << 62)]
    for k in range(0, len(x), 160):
        linkage._closer(own, (c[k : k + 160], s[k : k + 160], x[k : k + 160]), best, ward)
    d = ((x[:200, None, :] - x[None, :, :]) ** 2).sum(-1) * 2 / (1 / s[:200, None] + 1 / s) if ward else 1 - (x[:200, None, :] * x[None, :, :]).sum(-1)
    d[np.arange(200), np.arange(200)] = np.inf
    assert np.allclose(best[0], d.min(1), rtol=1e-6, atol=1e-12)


def test_where_no_two_are_nearest_to_each_other(spark, monkeypatch):
    """Where rounding leaves no such pair, the nearest of all merge."""
    monkeypatch.setattr(linkage, "_told", lambda near: near.withColumn("into", F.lit(None).cast("long")))
    x = np.random.default_rng(17).normal(size=(10, 3))
    assert (labels(spark, x, 3, True, finish=6) == cluster.linkage_labels(x, 3, "euclidean")).all()


@pytest.mark.parametrize("ward", [True, False])
def test_clusters_that_wait_to_ask(spark, monkeypatch, ward):
    """Those without a neighbour ask by shares; who waits merges later, at the same heights."""
    monkeypatch.setattr(linkage, "WORTH", 20_000)
    asked = []
    real = linkage._searched
    monkeypatch.setattr(linkage, "_searched", lambda asking, blocks, ward: asked.append((asking, blocks)) or real(asking, blocks, ward))
    x = np.random.default_rng(19).normal(size=(700, 6))
    assert (labels(spark, x, 9, ward, finish=300) == cluster.linkage_labels(x, 9, "euclidean" if ward else "cosine")).all()
    size = lambda df: df.agg(F.sum(F.length("s") / 8)).first()[0]
    counts = [(size(a), size(b)) for a, b in asked]
    assert counts[0] == (700, 700) and min(b for _, b in counts) > 300 and all(a for a, _ in counts)
    # Less than half as many as lost their neighbour asked in the second round.
    assert counts[1][0] < (counts[0][1] - counts[1][1]) * 1.2
