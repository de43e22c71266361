"""SimHash, hard negatives and whitening against brute force, and on awkward tables."""

import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import hard_negatives, queries, simhash, vectors, whitening
from tests.llm.test_llm import AWKWARD, SCHEMA, sentence

# --- SimHash ---


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(rows):
    """(doc_id, fingerprint, component_id) of rows (doc_id, text), by comparing all pairs."""
    fp = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = [min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in group]
    return sorted(((k, f"{f:016x}", c) for (k, _), f, c in zip(rows, fp, ids)), key=str)


def shown(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=str)


def test_simhash_awkward(spark):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in AWKWARD], SCHEMA).withColumns({"fp": F.lit("x"), "key": F.lit(1), "least": F.lit(2), "fingerprint": F.lit(3)}).repartition(3)
    assert shown(simhash.simhash(df)) == grouped([(r[0], r[1]) for r in AWKWARD])
    assert simhash.simhash(spark.createDataFrame([], SCHEMA)).count() == 0
    assert shown(simhash.simhash(spark.createDataFrame([(None, "a b"), (None, None), (None, "")], "doc_id long, text string"))) == grouped([(None, "a b"), (None, None), (None, "")])


@pytest.mark.parametrize("block", [1 << 18, 40])
def test_simhash_near_copies(spark, block):
    base = [sentence(s, 400).split() for s in range(6)]
    r = np.random.default_rng(5)
    rows = []
    for i in range(240):
        words = list(base[i % 6])
        for _ in range(i // 24):
            words[r.integers(len(words))] = f"w{r.integers(1000)}"
        rows.append((i, " ".join(words)))
    want = grouped(rows)
    assert 6 <= len({c for *_, c in want}) < 240
    assert shown(simhash.simhash(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shard=16, block=block)) == want


def brute_pairs(x):
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)
    return {(int(a), int(b)) for a, b in zip(x[i[i < j]], x[j[i < j]])}


def many_fingerprints(kind):
    r = np.random.default_rng(3)
    x = r.integers(0, 1 << 63, 1500).astype(np.uint64) * np.uint64(2) + r.integers(0, 2, 1500).astype(np.uint64)
    if kind == "half":  # one half is the same in all
        x = x & np.uint64(0xFFFF) | np.uint64(7 << 40)
    if kind == "ball":  # all near one another
        x = x[0] ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (4, 1500)).astype(np.uint64), axis=0)
    flips = np.bitwise_xor.reduce(np.uint64(1) << r.integers(0, 64, (3, 300)).astype(np.uint64), axis=0)
    return np.unique(np.concatenate([x, x[:300] ^ flips]))


@pytest.mark.parametrize("kind", ["random", "half", "ball"])
def test_vantage_points_find_all_pairs(kind):
    x = many_fingerprints(kind)
    want, got = brute_pairs(x), set()
    for half in simhash.HALVES:
        tree = simhash.Tree.fit(np.random.default_rng(1).permutation(x)[:200], 16, half, 1)
        seen = 0
        for _, homes, asks in tree.deal(x):
            seen += len(homes)
            for a, b in simhash.close_pairs(homes, asks, half, leaf=8):
                got |= {(min(u, v), max(u, v)) for u, v in zip(a.tolist(), b.tolist())}
        assert seen == len(x)
    assert got == want and len(want) > 200


def test_vantage_points_prune():
    """Random fingerprints are compared with a few of the others."""
    x = np.random.default_rng(9).integers(0, 1 << 63, 40_000).astype(np.uint64)
    compared = 0
    todo = [(x, x[:0])]
    while todo:
        homes, asks = todo.pop()
        if len(homes) <= 64:
            compared += len(homes) * (len(homes) // 2 + len(asks))
            continue
        inner, outer = simhash.parted(homes, asks, *simhash.split(homes, simhash.HALVES[0]), simhash.HALVES[0], 1)
        todo += [inner, outer]
    assert compared < 0.05 * len(x) ** 2 / 2


def test_stars():
    r = np.random.default_rng(2)
    a, b = r.integers(0, 300, 200).astype(np.uint64), r.integers(0, 300, 200).astype(np.uint64)
    root = {int(x): int(x) for x in [*a, *b]}
    for _ in range(300):
        for x, y in zip(a.tolist(), b.tolist()):
            root[x] = root[y] = min(root[x], root[y])
    nodes, roots = simhash.stars(a, b)
    assert {(int(x), int(y)) for x, y in zip(nodes, roots)} == {(x, y) for x, y in root.items() if x != y}


# --- vectors ---


def test_narrow():
    for x in (np.array([[-5, 7], [0, 1 << 40]]), np.zeros((0, 3), dtype=np.int64), np.array([[-(1 << 62), 1 << 62]]), np.array([3, 3])):
        assert (vectors.widen(vectors.narrow(x)) == x).all() and vectors.widen(vectors.narrow(x)).shape == x.shape


VECTORS = "vec_id long, embedding array<float>, label int, row string, block string, score string, anchor string"


@pytest.fixture(scope="module")
def odd_vectors(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(v) for v in r.normal(size=5)], int(r.integers(0, 3))) for i in range(160)]
    rows += [(50, rows[50][1], rows[50][2]), (3, rows[4][1], 1), (None, rows[7][1], 1), (200, None, 1), (201, [1.0, None], 1), (202, [float("nan")] * 5, 2), (203, [float("inf")] * 5, 0), (250, rows[9][1], None), (300, [0.5], 2), (301, [], 1), (350, [0.0] * 5, 0)]
    return spark.createDataFrame([(*x, "c", "c", "c", "c") for x in rows], VECTORS).repartition(3)


def padded(df):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    ok = [x for x in rows if x[1] is not None and all(v is not None and np.isfinite(v) for v in x[1])]
    width = max(len(x[1]) for x in ok)
    return ok, np.array([list(x[1]) + [0.0] * (width - len(x[1])) for x in ok])


def brute_negatives(df):
    rows, x = padded(df)
    keep = [i for i, r in enumerate(rows) if r[2] is not None]
    rows, e = [rows[i] for i in keep], np.floor(x[keep] * 256).astype(int)
    score = e @ e.T
    label = [(k + 1) % 10 if i is not None and i % 7 == 0 else k for i, _, k in rows]
    order = lambda a: sorted((j for j in range(len(rows)) if j != a), key=lambda j: (-score[a, j], rows[j][0] is None, rows[j][0] or 0))
    out = []
    for a in range(len(rows)):
        if rows[a][0] is not None and rows[a][0] % 50 == 0:
            for p in [j for j in order(a) if label[j] == label[a]][:5]:
                fit = [j for j in order(a) if label[j] != label[a] and 50 * score[a, p] <= 100 * score[a, j] <= 95 * score[a, p]]
                out += [(rows[a][0], rows[p][0], k + 1, rows[j][0], int(score[a, p]), int(score[a, j])) for k, j in enumerate(fit[:3])]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"rows": 7, "chunk": 2, "panel": 2}])
def test_hard_negatives(odd_vectors, sizes):
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    got = hard_negatives.hard_negatives(odd_vectors, F.expr("vec_id % 50 = 0"), label=label, **sizes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_negatives(odd_vectors)


def test_hard_negatives_edges(spark, odd_vectors):
    none = hard_negatives.hard_negatives(odd_vectors.limit(0), F.expr("vec_id % 50 = 0"))
    assert none.count() == 0 and hard_negatives.hard_negatives(odd_vectors, F.lit(False)).count() == 0
    one = spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 2)], "vec_id long, embedding array<double>, label int")
    assert hard_negatives.hard_negatives(one, F.lit(True)).count() == 0
    # Beyond 2 ** 53 products are made in whole numbers, beyond 2 ** 62 they are an error.
    large = spark.createDataFrame([(50, [300_000.0, 1.0], 1), (51, [290_001.0, 1.0], 1), (52, [200_001.0, 3.0], 2)], "vec_id long, embedding array<double>, label int")
    r = hard_negatives.hard_negatives(large, F.expr("vec_id = 50")).first()
    assert (r["positive_score"], r["negative_score"]) == (65536 * (300_000 * 290_001 + 1), 65536 * (300_000 * 200_001 + 3))
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.hard_negatives(large.withColumn("embedding", F.expr("transform(embedding, x -> x * 1e6)")), F.lit(True))


def test_hard_negatives_sql(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    got = queries.op11_hard_negatives(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(c.execute(hard_negatives.SQL).fetchall())


def test_best_keeps_ties():
    r = np.random.default_rng(6)
    best, seen = hard_negatives.Best(3, 4), []
    for _ in range(6):
        slot, score, ids = r.integers(0, 4, 30), r.integers(-3, 3, 30), r.integers(0, 9, 30)
        row = np.arange(30) + 30 * len(seen)
        seen.append((slot, score, ids, row))
        best.offer(slot, score, ids, row)
    every = sorted((s, -c, i, w) for x in seen for s, c, i, w in zip(*map(np.ndarray.tolist, x)))
    want = [x for s in range(4) for x in [y for y in every if y[0] == s][:3]]
    assert [(s, -c, i, w) for s, c, i, w in zip(*map(np.ndarray.tolist, best.held))] == want
    assert best.bound.tolist() == [-want[3 * s + 2][1] for s in range(4)]


# --- whitening ---


def test_whitening(odd_vectors):
    rows, e = padded(odd_vectors)
    x = (np.floor(e * 64) + 1_000_000).astype(np.int64)
    n = len(x)
    y = x - x.mean(0)
    values, u = np.linalg.eigh(y.T @ y / n)
    values, u = values[::-1], u[:, ::-1]
    got = whitening.whiten(odd_vectors, k=3).collect()
    assert len(got) == 3 * n
    for c in range(3):
        mine = sorted(((r["vec_id"], r["deviation"], r["whitened"]) for r in got if r["component"] == c + 1), key=lambda t: (t[0] is None, t[0] or 0, t[1]))
        order = sorted(range(n), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, sum((n * x[i] - x.sum(0)) ** 2)))
        assert [t[:2] for t in mine] == [(rows[i][0], int(((n * x[i] - x.sum(0)) ** 2).sum())) for i in order]
        w = y[order] @ u[:, c] / np.sqrt(values[c])
        assert np.allclose(w * np.sign(w @ [t[2] for t in mine]), [t[2] for t in mine], atol=1e-9)
    assert {(r["n"], r["identity_error"] < 1e-9) for r in got} == {(n, True)}
    assert np.allclose([next(r["explained"] for r in got if r["component"] == c + 1) for c in range(3)], values[:3] / values.sum(), rtol=1e-9)


def test_whitening_edges(spark, odd_vectors):
    assert whitening.whiten(odd_vectors.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [r["component"] for r in flat] == [1, 1]
    assert [x for r in flat for x in (r["explained"], abs(r["whitened"]))] == pytest.approx([1.0] * 4)


def test_subspace_widens_for_equal_eigenvalues():
    r = np.random.default_rng(8)
    u = np.linalg.qr(r.normal(size=(300, 300)))[0]
    apart = np.concatenate([np.linspace(30, 10, 6), np.full(294, 0.1)])
    values, vectors_, passes, residual = whitening.subspace(lambda q: u @ (apart[:, None] * (u.T @ q)), 300, 4, spare=4)
    assert np.allclose(values, apart[:4]) and passes < 12 and residual <= 1e-13 * 30
    level = 1 + np.linspace(0.01, 0, 300)
    widths = []
    values, vectors_, passes, residual = whitening.subspace(lambda q: widths.append(q.shape[1]) or u @ (level[:, None] * (u.T @ q)), 300, 4, spare=4)
    assert np.allclose(values, level[:4]) and np.allclose(vectors_.T @ vectors_, np.eye(4), atol=1e-12)
    assert widths[0] == 8 and widths[-1] == 300 and passes < 20


# --- filters and components ---


def test_filters_by_ranges_pass_as_many_through(spark):
    """With a filter for a hundredth of the rows, and for a tenth, as many unique rows pass as with one for all."""
    from cairn.llm import exact_dedup

    n = 200_000
    rows = spark.range(n + n // 20).select(F.unhex(F.sha2((F.col("id") % n).cast("string"), 256)).alias("sha"))
    rows = exact_dedup.pin(rows)
    passed = []
    for most in (8 * n, n // 5, n // 50):
        flagged = exact_dedup.flag_repeats(rows, n + n // 20, most_bytes=most)
        got = flagged.groupBy("sha").agg(F.count(F.lit(1)).alias("k"), F.bool_and("possible").alias("maybe")).groupBy("k", "maybe").count().collect()
        assert not [r for r in got if r["k"] > 1 and not r["maybe"]] and sum(r["count"] for r in got) == n
        passed.append(sum(r["count"] for r in got if not r["maybe"]) / (n * 19 / 20))
    assert exact_dedup.ranges_of(n + n // 20, n // 50) > 90 and min(passed) > 0.95


def test_components_raise_when_unfinished(spark):
    from cairn.llm.components import components

    path = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    with pytest.raises(ArithmeticError):
        components(path, rounds=1)
