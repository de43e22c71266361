"""Places of rows in a plane that keep neighbourhoods, for any number of rows.

1. Each row's NEIGHBOURS nearest others, exactly: blocks of rows meet all blocks where they are stored, without a shuffle.
2. Fuzzy weights by row (they add up to log2 of the number of neighbours), joined to one symmetric weight a pair. What
   draws at a row is bounded: of the rows that have it as a neighbour the REVERSE * NEIGHBOURS strongest.
3. Positions are a table, and begin as the first two principal components. In a round a task moves its own rows for some
   epochs, drawn together along neighbours and pushed apart from others, while the rows of other tasks stand where the
   round before has left them; neighbours in the same task move with it. Rows to be pushed from are drawn from a sample
   of fixed size, which is broadcast.

So nothing is gathered in one group: a task holds its rows, their lists and the sample.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.blocks import met, packed, pairs, slack, squares
from cairn.functions.stored import stored

#: Both sides of a matrix of distances, rows of a task that moves them.
ASKED, MET, MOVED = 256, 4096, 1 << 15
#: Reverse neighbours for each neighbour, positions that rows are pushed from, pushes for each pull.
REVERSE, PUSHED_FROM, PUSHES = 4, 4096, 3
ROUNDS, EPOCHS = 8, 25


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of each row of x to each of y. hamming: the share of columns that differ."""
    if metric == "euclidean":
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))
    if metric == "cosine":
        unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        return 1 - unit(x) @ unit(y).T
    d = np.zeros((len(x), len(y)))
    for c in range(x.shape[1]):
        if metric == "hamming":
            d += x[:, c][:, None] != y[:, c]
        else:
            gap = np.abs(x[:, c][:, None] - y[:, c])
            d = np.maximum(d, gap) if metric == "chebyshev" else d + gap
    return d / max(1, x.shape[1]) if metric == "hamming" else d


def _keep(best: list[np.ndarray], i: np.ndarray, d: np.ndarray, c: np.ndarray) -> None:
    """Put distances d to rows c among the nearest of rows i."""
    k = best[0].shape[1]
    rows = np.unique(i)
    i = np.concatenate([np.repeat(rows, k), i])
    d, c = np.concatenate([best[0][rows].ravel(), d]), np.concatenate([best[1][rows].ravel(), c])
    order = np.lexsort((d, i))
    i, d, c = i[order], d[order], c[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    first = place < k
    best[0][i[first], place[first]], best[1][i[first], place[first]] = d[first], c[first]


def _closer(own: tuple, other: tuple, best: list[np.ndarray], metric: str) -> None:
    """Keep in best (distances, numbers), in their order, the nearest of the rows own = (c, s, x) among the others. Euclidean distances are squared.

    Products find the few pairs that may be nearer than the farthest one kept; their distances are taken by differences.
    """
    (c, _, x), (c2, _, y) = own, other
    k, square = best[0].shape[1], metric == "euclidean"
    for m in range(0, len(c2), MET):
        part = y[m : m + MET]
        y2 = (part * part).sum(1)
        ones = np.column_stack([-2 * part, y2]).T if square else None
        for a in range(0, len(c), ASKED):
            mine = x[a : a + ASKED]
            if square:
                x2 = (mine * mine).sum(1)
                d = np.column_stack([mine, np.ones(len(mine))]) @ ones
                wide = slack(x2, y2, x.shape[1])
            else:
                x2 = wide = np.zeros(len(mine))
                d = distances(mine, part, metric)
            most = best[0][a : a + ASKED, -1] - x2
            most[best[0][a : a + ASKED, -1] == 0] = -np.inf
            new = np.flatnonzero(np.isinf(most) & (most > 0))
            if len(new) and d.shape[1] > k + 1:
                # One more than k, as a row may meet itself.
                limit = np.partition(d[new], k, axis=1)[:, k]
                most[new] = np.where(np.isnan(limit), np.inf, limit)
            # Much faster than nonzero of the matrix.
            i, j = np.divmod(np.flatnonzero(d <= (most + 2 * wide)[:, None]), d.shape[1])
            some = c[a + i] != c2[m + j]
            i, j = i[some], j[some]
            d = squares(mine, part, i, j) if square else d[i, j]
            some = np.isfinite(d) & (d < best[0][a + i, -1])
            if some.any():
                _keep(best, a + i[some], d[some], c2[m + j[some]])


def _near(batches: Iterator[pa.RecordBatch], k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """(c, near, far) of pairs of blocks: the k nearest of each asking row among those it met."""
    held: list[tuple[np.ndarray, list[np.ndarray]]] = []
    for i, own, other in pairs(batches):
        if i == len(held):
            n = len(own[0])
            held.append((own[0].copy(), [np.full((n, k), np.inf), np.full((n, k), 1 << 62)]))
        _closer(own, other, held[i][1], metric)
    for c, best in held:
        if metric == "euclidean":
            best[0] = np.sqrt(best[0])
        for i in range(0, len(c), 4096):
            d, j = best[0][i : i + 4096], best[1][i : i + 4096]
            there = np.isfinite(d)
            offsets = pa.array(np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 4096]), pa.ListArray.from_arrays(offsets, pa.array(j[there])), pa.ListArray.from_arrays(offsets, pa.array(d[there]))], names=["c", "near", "far"])


def neighbours(points: DataFrame, k: int, metric: str, n: int) -> DataFrame:
    """(c, near, far): the k nearest others of each of n points (c, x), in no order, and their distances.

    Blocks of points meet where they are stored (blocks.py), each row meets all others in one task.
    """
    width = points.select(F.size("x").alias("w")).limit(1).collect()
    blocks = packed(points.withColumn("s", F.lit(1.0)), n, width[0]["w"] if width else 0)
    return met(blocks, blocks).mapInArrow(lambda batches: _near(batches, k, metric), "c long, near array<long>, far array<double>")


def weights(far: np.ndarray) -> np.ndarray:
    """Weights of a row's neighbours by their distances: the nearest has 1, together they have log2 of their number."""
    least = far.min(1, keepdims=True)
    low, high = np.zeros((len(far), 1)), np.full((len(far), 1), max(far.max(initial=0), 1e-12) * 10)
    width = high
    for _ in range(50):
        width = (low + high) / 2
        above = np.exp(-(far - least) / np.maximum(width, 1e-12)).sum(1, keepdims=True) > np.log2(max(far.shape[1], 2))
        high, low = np.where(above, width, high), np.where(above, low, width)
    return np.exp(-(far - least) / np.maximum(width, 1e-12))


def _weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, p) of (c, near, far)."""
    for batch in batches:
        sizes = np.diff(batch.column(1).offsets.to_numpy())
        for size in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == size)
            part = batch.take(pa.array(rows))
            far = part.column(2).flatten().to_numpy().reshape(-1, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), size)), part.column(1).flatten(), pa.array(weights(far).ravel())], names=["a", "b", "p"])


def curve(min_dist: float) -> tuple[float, float]:
    """(s, t) with which 1 / (1 + s d^(2t)) is nearest to 1 up to min_dist and to an exponential fall from there."""
    grid = np.linspace(0.01, 3, 200)
    wanted = np.where(grid < min_dist, 1.0, np.exp(-(grid - min_dist)))
    return min(((p, q) for p in np.linspace(0.2, 6, 59) for q in np.linspace(0.4, 2, 33)), key=lambda u: float(((1 / (1 + u[0] * grid ** (2 * u[1])) - wanted) ** 2).sum()))


def move(place: np.ndarray, at: np.ndarray, inside: np.ndarray, fixed: np.ndarray, weight: np.ndarray, others: np.ndarray, steps: Sequence[float], s: float, t: float, r: np.random.Generator) -> np.ndarray:
    """Rows' places after some epochs. Pair i draws row at[i] to row inside[i], or where that is -1 to the place fixed[i]."""
    place = place.copy()
    most = max(float(weight.max(initial=0)), 1e-300)
    for step in steps:
        some = np.flatnonzero(r.random(len(weight)) < weight / most)
        i, j = at[some], inside[some]
        gap = place[i] - np.where((j >= 0)[:, None], place[j], fixed[some])
        d2 = np.maximum((gap**2).sum(1, keepdims=True), 1e-9)
        moved = np.zeros_like(place)
        np.add.at(moved, i, np.clip(-2 * s * t * d2 ** (t - 1) / (1 + s * d2**t) * gap, -4, 4) * step)
        ends = np.repeat(i, PUSHES)
        gap = place[ends] - others[r.integers(0, len(others), len(ends))]
        d2 = (gap**2).sum(1, keepdims=True)
        np.add.at(moved, ends, np.clip(2 * t / ((0.001 + d2) * (1 + s * d2**t)) * gap, -4, 4) * step)
        place += np.clip(moved, -4, 4)
    return place


def _moved(others: np.ndarray, steps: Sequence[float], s: float, t: float, seed: int):
    """(c, x, y) of (blk, c, b, x, y, w), a block's rows together, in order: places of its own rows (b is null) and of their neighbours b, with weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def flush():
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            own = table.column(2).is_null().to_numpy(zero_copy_only=False)
            row, b = table.column(1).to_numpy(), table.column(2).fill_null(-1).to_numpy()[~own]
            places = np.column_stack([table.column(3).to_numpy(), table.column(4).to_numpy()])
            c = row[own]
            find = lambda v: np.minimum(np.searchsorted(c, v), len(c) - 1)
            j = find(b)
            inside = np.where(c[j] == b, j, -1)
            place = move(places[own], find(row[~own]), inside, places[~own], table.column(5).to_numpy()[~own], others, steps, s, t, np.random.default_rng([seed, int(c[0]) & 0xFFFFFFFF]))
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(place[:, 0]), pa.array(place[:, 1])], names=["c", "x", "y"])

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    if held and blocks[i] != now:
                        yield from flush()
                    now = blocks[i]
                    held.append(batch.slice(i, j - i))
        yield from flush()

    return run


def edges(near: DataFrame, k: int) -> DataFrame:
    """(a, b, w): symmetric weights p + q - p q, each pair in both directions; of those that draw at a row from outside its own neighbours the strongest."""
    one = near.mapInArrow(_weighted, "a long, b long, p double")
    both = one.select("a", "b", "p", F.lit(1).alias("own")).unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "p", F.lit(0).alias("own")))
    # Pairs and the strongest are both told where the row is.
    both = both.repartition("a")
    pairs = both.groupBy("a", "b").agg((1 - F.min(1 - F.col("p")) * F.when(F.count(F.lit(1)) > 1, 1 - F.min("p")).otherwise(1.0)).alias("w"), F.max("own").alias("own"))
    strongest = pairs.withColumn("_k", F.row_number().over(Window.partitionBy("a", "own").orderBy(F.desc("w"), "b")))
    return strongest.where((F.col("own") == 1) | (F.col("_k") <= REVERSE * k)).select("a", "b", "w")


def place_rows(points: DataFrame, start: DataFrame, k: int, min_dist: float, metric: str, rounds: int = ROUNDS, epochs: int = EPOCHS, seed: int = 42) -> DataFrame:
    """(c, x, y) of points (c, x), which are stored, from a start (c, x, y)."""
    spark = points.sparkSession
    n = points.count()
    now = stored(start, "places")
    k = min(k, n - 1)
    if k < 1:
        return now
    drawn = stored(edges(stored(neighbours(points, k, metric, n), "near"), k), "edges")
    blocks = max(1, -(-n // MOVED), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 512))
    s, t = curve(min_dist)
    for round_ in range(rounds):
        # A sample of fixed size.
        others = np.array([(r["x"], r["y"]) for r in now.orderBy(F.xxhash64("c", F.lit(round_)), "c").limit(PUSHED_FROM).collect()])
        steps = [1 - (round_ * epochs + e) / (rounds * epochs) for e in range(epochs)]
        ends = drawn.join(now.select(F.col("c").alias("b"), "x", "y"), "b").select(F.col("a").alias("c"), "b", "x", "y", "w")
        both = now.select("c", F.lit(None).cast("long").alias("b"), "x", "y", F.lit(0.0).alias("w")).unionByName(ends)
        rows = both.select(F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int").alias("blk"), "*")
        moved = rows.repartitionById(blocks, F.col("blk")).sortWithinPartitions("blk", "c", "b").mapInArrow(_moved(others, steps, s, t, seed + round_), "c long, x double, y double")
        now = stored(moved, "places")
    return now


def layout(df: DataFrame, id_column: str, x: Column, first: Column, second: Column, k: int, min_dist: float, metric: str, **options: int) -> DataFrame:
    """(id, umap_dimension_1, umap_dimension_2). first, second: where rows start, of any scale."""
    rows = stored(df.select(F.col(f"`{id_column}`").alias("id"), x.alias("x"), first.alias("first"), second.alias("second")).withColumn("c", F.monotonically_increasing_id()), "points")
    most = rows.agg(F.greatest(F.max(F.abs("first")), F.max(F.abs("second")))).first()[0] or 0.0
    noise = lambda i: (F.pmod(F.xxhash64("c", F.lit(i)), F.lit(20_001)) - 10_000) / 1e8
    at = lambda c, i: F.col(c) / max(most, 1e-12) * 10 + noise(i)
    places = place_rows(rows.select("c", "x"), rows.select("c", at("first", 1).alias("x"), at("second", 2).alias("y")), k, min_dist, metric, **options)
    return rows.select("c", "id").join(places, "c").select(F.col("id").alias(id_column), F.col("x").alias("umap_dimension_1"), F.col("y").alias("umap_dimension_2"))
