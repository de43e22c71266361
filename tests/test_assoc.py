"""Pairs of columns, merged exports, samples by threshold and shuffled features against their definitions."""

import hashlib
import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import assoc, explain, sample


@pytest.mark.parametrize("values,width", [(3, 24), (3, 2), (150, 2)])
def test_pair_cells(spark, values, width):
    r = np.random.default_rng(values)
    rows = [tuple(None if r.random() < 0.1 else f"v{int(r.integers(values))}" for _ in range(5)) for _ in range(600)]
    names = ["e", "d", "c", "b", "a"]
    got = {tuple(x)[:4]: x["n"] for x in assoc.pair_cells(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names)).repartition(3), names, width).collect()}
    want = Counter((names[i], names[j], row[i], row[j]) for row in rows for i, j in itertools.combinations(range(5), 2) if row[i] is not None and row[j] is not None)
    assert got == want


def test_pair_cells_hand_on_many_values(spark, monkeypatch):
    monkeypatch.setattr(assoc, "CODES", 8)
    df = spark.range(300).select(F.col("id").cast("string").alias("x"), (F.col("id") % 7).cast("string").alias("y"))
    assert {(r["left"], r["right"], r["n"]) for r in assoc.pair_cells(df, ["x", "y"]).collect()} == {(str(i), str(i % 7), 1) for i in range(300)}
    assert assoc.pair_cells(df.limit(0), ["x", "y"]).count() == 0


def test_continuity(spark):
    """Chi-squared of [[12, 5], [3, 9]] with and without the correction, by hand."""
    df = spark.createDataFrame([("a", "x")] * 12 + [("a", "y")] * 5 + [("b", "x")] * 3 + [("b", "y")] * 9, "p string, q string")
    n, det, margins = 29, 12 * 9 - 5 * 3, 17 * 12 * 15 * 14
    assert assoc.cramers_v(df, "p", "q", corrected=False).first()["chi2"] == pytest.approx(n * (det - n / 2) ** 2 / margins)
    assert assoc.cramers_v(df, "p", "q", corrected=False, continuity=False).first()["chi2"] == pytest.approx(n * det**2 / margins)
    even = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("b", "y")] * 2, "p string, q string")
    assert assoc.cramers_v(even, "p", "q", corrected=False).first()["chi2"] == 0
    diagonal = spark.createDataFrame([("a", "x")] * 6 + [("b", "y")] * 4, "p string, q string")
    assert assoc.cramers_v(diagonal, "p", "q", corrected=False).first()["chi2"] == pytest.approx(10 * (24 - 5) ** 2 / (6 * 4 * 6 * 4))


def first_rows(rows, quotas, seed=42):
    out = []
    for k, q in quotas.items():
        mine = sorted((hashlib.md5(f"{i}|{seed}".encode()).hexdigest(), i) for i, c in rows if c == k)
        out += [(i, k) for _, i in mine[:q]]
    return Counter(out)


@pytest.mark.parametrize("few", [4096, 3])
def test_samples_are_the_first_rows(spark, monkeypatch, few):
    monkeypatch.setattr(sample, "FEW", few)
    monkeypatch.setattr(sample, "DIGITS", 2 if few < 10 else 3)
    rows = [(i, [None, "a", "b"][i % 3]) for i in range(3000)] + [(5, "b")] * 4
    df = spark.createDataFrame(rows, "id long, k string").repartition(3)
    for quotas in ({None: 70, "a": 1, "b": 1001}, {"a": 0, "b": 5000}):
        assert Counter(map(tuple, sample.take_quotas(df, "k", quotas, "id").collect())) == first_rows(rows, quotas)
    every = [(i, None) for i, _ in rows]
    for most in (0, 1, 999, 3004, 9000):
        assert Counter(r["id"] for r in sample.cap(df, "id", most).collect()) == Counter(i for i, _ in first_rows(every, {None: most}).elements())


def test_capped_rows_are_a_filter(spark):
    plan = sample.cap(spark.range(50_000).withColumnRenamed("id", "key"), "key", 20_000)
    assert plan.count() == 20_000 and plan.rdd.getNumPartitions() > 1
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in text and "Exchange hash" not in text


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4097])
def test_bijection(n):
    seen = [explain.bijection(np.arange(n), n, k) for k in range(3)]
    assert all(sorted(s.tolist()) == list(range(n)) for s in seen)
    assert n < 64 or len({tuple(s) for s in seen}) == 3 and (seen[0] == np.arange(n)).sum() < 10


def test_shuffled_features_are_permutations(spark):
    rows = [(i, float(i) / 3, f"s{i % 5}" if i % 4 else None, i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, s string, y int").repartition(3)
    out = explain.shuffled(df, ["x", "s"], "id", repeats=2).collect()
    by = {f: [r for r in out if r["feature"] == f] for f in (None, "x", "s")}
    assert [len(v) for v in by.values()] == [200, 400, 400]
    assert sorted(tuple(r)[:4] for r in by[None]) == sorted(rows) or Counter(tuple(r)[:4] for r in by[None]) == Counter(rows)
    assert Counter(r["x"] for r in by["x"]) == Counter({x: 2 for _, x, _, _ in rows}) and Counter(r["s"] for r in by["s"]) == Counter(s for _, _, s, _ in rows for _ in (0, 1))
    # The other columns stay where they were, and values do move.
    assert Counter((r["id"], r["s"], r["y"]) for r in by["x"]) == Counter({(i, s, y): 2 for i, _, s, y in rows})
    assert sum(r["x"] == r["id"] / 3 for r in by["x"]) < 20
    assert explain.shuffled(df.limit(0), ["x"], "id").count() == 0
