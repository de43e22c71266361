"""Quantiles by selection against the definition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import quantiles as q
from cairn.operators import features, metrics, profile

PROBS = [0.0, 0.1, 0.25, 0.5, 2 / 3, 0.9, 1.0]


def expected(v, p):
    v = sorted(v, key=lambda x: (math.isnan(x), x))
    if not v:
        return None
    place = p * (len(v) - 1)
    a, b = v[math.floor(place)], v[math.ceil(place)]
    return a if a == b or math.floor(place) == math.ceil(place) else (math.ceil(place) - place) * a + (place - math.floor(place)) * b


def test_keys_are_in_order():
    v = np.array([-math.inf, -1e300, -2.5, -1e-320, 0.0, 1e-320, 1.0, 1.0000000000000002, 1e300, math.inf, math.nan])
    k = q.keys(v)
    assert (k[1:] > k[:-1]).all() and q.keys(np.array([-0.0])) == q.keys(np.array([0.0]))
    assert np.array_equal(q.values(k), v, equal_nan=True)


def draws():
    r = np.random.default_rng(3)
    return {
        "ties": r.integers(0, 5, 900).astype(float), "wide": np.exp(r.normal(0, 200, 900)) * r.choice([-1, 1], 900), "near": 1 + r.integers(0, 900, 900) * 2.0**-52,
        "same": np.full(900, 7.25), "odd": np.concatenate([[math.inf, -math.inf, math.nan, -0.0, 0.0], r.normal(size=895)]),
    }


@pytest.mark.parametrize("few", [1 << 15, 10, 0])
def test_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(q, "FEW", few)
    cols = draws()
    rows = [(i % 3, *[None if (i + j) % 11 == 0 else float(v[i]) for j, v in enumerate(cols.values())]) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{c} double" for c in cols)).repartition(3)
    for by in (None, F.col("k")):
        got = q.quantiles(df, {c: F.col(c) for c in cols}, PROBS, by=by, different=4)
        assert {c for c, _ in got} == ({None} if by is None else {"0", "1", "2"})
        for (of, c), s in got.items():
            v = [r[1 + list(cols).index(c)] for r in rows if r[1 + list(cols).index(c)] is not None and (of is None or str(r[0]) == of)]
            assert s.n == len(v) and s.different >= min(4, len(set(v))) and (c != "same" or s.different == 1) and s.passes <= 7
            assert [s.at[p] for p in PROBS] == pytest.approx([expected(v, p) for p in PROBS], nan_ok=True, rel=1e-15, abs=0)


def test_passes_and_bins_are_bounded(spark, monkeypatch):
    """A hundred thousand different values: three passes, and none returns more than some bins."""
    sizes = []
    counted = q._counted

    def seen(width, shift, last, open_):
        sizes.append(None if open_ is None else sum(map(len, open_.values())))
        return counted(width, shift, last, open_)

    monkeypatch.setattr(q, "_counted", seen)
    df = spark.range(100_000).select((F.hash("id") / 7).alias("v"))
    s = q.quantiles(df, {"v": F.col("v")}, [0.25, 0.5, 0.75])[None, "v"]
    assert s.passes == len(sizes) <= 4 and max(sizes[1:]) <= 6
    v = np.array([r[0] for r in df.collect()])
    assert [s.at[p] for p in (0.25, 0.5, 0.75)] == pytest.approx(np.quantile(v, [0.25, 0.5, 0.75]).tolist(), rel=1e-14)


def test_operators_on_nothing(spark):
    df = spark.createDataFrame([(None, None)], "v double, k string")
    assert tuple(profile.five_numbers(df, "v").first()) == (0, None, None, None, None, None)
    assert features.quantile_edges(df.limit(0), "v", 3).first()["edges"] is None
    assert features.impute_median(df, ["v"]).first()["v"] is None
    r = metrics.score_summary(df, "v", "k").first()
    assert (r["label"], r["n"], r["median"]) == (None, 0, None)


def test_edges_follow_the_number_of_values(spark):
    df = spark.createDataFrame([(float(i % 3), float(i % 2), 1.0, float(i)) for i in range(60)], "three double, two double, one double, many double")
    found = features.edges_of(df, df.columns, 4)
    assert found["two"] == [0.0, 0.5, 1.0] and found["one"] is None and found["many"] == [0.0, 14.75, 29.5, 44.25, 59.0]
    assert found["three"] == pytest.approx([0.0, 2 / 3, 4 / 3, 2.0])


def test_column_profile_counts_different_values(spark):
    df = spark.createDataFrame([(1, 0.0, "a", [1], None), (1, -0.0, None, [1], None), (2, float("nan"), "b", [2], None)], "i int, d double, s string, a array<int>, n string")
    assert {r["column"]: (r["cardinality"], round(r["missing_rate"], 3)) for r in profile.column_profile(df).collect()} == {"i": (2, 0), "d": (2, 0), "s": (3, 0.333), "a": (2, 0), "n": (1, 1)}
    assert [tuple(r) for r in profile.column_profile(df.limit(0), ["i"]).collect()] == [("i", 0, 0.0)]
