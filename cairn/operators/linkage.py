"""Agglomerative clustering of any number of rows, in rounds of reciprocal nearest neighbours.

Clusters have a number, a weight and a centre, and are stored in blocks (blocks.py), those that ask for their nearest
neighbour apart from the others. In a round each cluster that lost its nearest neighbour looks for it anew; two clusters
that are nearest to each other merge, all such pairs at once. Ward and average linkage are reducible: no merge brings a
cluster nearer to a third than its parts were, so neighbours that weren't merged stay the nearest, and merges of one round
are merges of nearest-pair agglomeration, whose order by height they keep. When FINISH clusters are left, at most BYTES of
them, the rest is linked on the driver.

Equal vectors are one cluster to begin with. Ties go to the pair with the least numbers, which are drawn by hash, so that
rows in an order (a grid, say) don't merge one pair a round.

A round is three steps: asking blocks meet all blocks where they are stored, a small table (number, neighbour, distance) tells
what merges and who lost its neighbour, and one shuffle brings the two of a merge together and packs the blocks anew. Looking
for neighbours compares each asking cluster with all others, in single precision, and by differences what that can't tell.
That is the cost of exact linkage, some 2.5 * n * n * columns over all rounds. Clusters that know no neighbour need not ask at
once: those do whose last distance, which no distance of theirs is below, is among the least. The others wait, as they would
often lose what they found before they merge.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import blocks as stored_blocks
from cairn.functions.blocks import MOST, met, opened, packed, pairs, slack, squares, vectors
from cairn.functions.stored import stored

#: Clusters that the driver links and bytes of them at most, and both sides of a matrix of distances.
FINISH, BYTES, ASKED, MET = 8192, 32 << 20, 512, 4096
#: Shares of the clusters without a neighbour that may ask, and pairs that are worth a round: the least share with so many does, or all do.
SHARES, WORTH = (0.25, 0.5, 0.75), 3e9
#: Distances that differ by a smaller share are ties.
SAME = 1e-7


def _least(left: np.ndarray, right: np.ndarray, single: np.ndarray, bound: np.ndarray, err: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where left @ right may be at most bound, by row: products err by err, and their terms and the bounds add up to size.

    Single precision (the same right as single) tells it where it leaves few and can hold the numbers.
    """
    wide = right.shape[1]

    def true(few: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # By rows that have any, and of a flat array: several times as fast.
        rows = np.flatnonzero(few.any(1))
        at = np.flatnonzero(few[rows])
        return rows[at // wide], at % wide

    if size.max() < 1e30 and size.min() > 1e-25:
        i, j = true(left.astype(np.float32) @ single <= (bound + 1.2e-7 * (left.shape[1] + 8) * size).astype(np.float32)[:, None])
        if len(i) <= max(len(left), len(left) * wide // 64):
            return i, j
    return true(left @ right <= (bound + err)[:, None])


def _closer(own: tuple, other: tuple, best: list[np.ndarray], ward: bool) -> None:
    """Keep in best (distance, smaller number, larger number) the nearest of the clusters own = (c, s, x) among the others.

    Ward distances are 2 / (1 / s + 1 / s2) times the squares of those of centres. Whether one may be less than the best so
    far is told by one product; the few that may are taken by differences.
    """
    (c, s, x), (c2, s2, y) = own, other
    for m in range(0, len(c2), MET):
        part, over = y[m : m + MET], 1 / s2[m : m + MET]
        y2 = (part * part).sum(1)
        factors = np.column_stack([-2 * part, y2, over] if ward else [-part]).T
        with np.errstate(over="ignore"):  # then it isn't used
            single = np.asarray(factors, dtype=np.float32, order="F")
        for a in range(0, len(c), ASKED):
            mine, low = x[a : a + ASKED], best[0][a : a + ASKED].copy()
            half = 1 / s[a : a + ASKED]
            new = np.flatnonzero(np.isinf(low))
            if len(new):
                # The least in this matrix, itself left out: a bound to begin with.
                d = mine[new] @ part.T
                if ward:
                    d = np.maximum((mine[new] ** 2).sum(1)[:, None] + y2 - 2 * d, 0) * 2 / (half[new][:, None] + over)
                else:
                    d = 1 - d
                d[c[a + new][:, None] == c2[m : m + MET]] = np.inf
                low[new] = d.min(1)
            low += np.abs(low) * 2 * SAME + 1e-300
            # All may be nearer than nothing, as where a cluster is alone in the matrix.
            low[np.isinf(low)] = 1e300
            if ward:
                x2 = (mine * mine).sum(1)
                left = np.column_stack([mine, np.ones(len(mine)), -low / 2])
                i, j = _least(left, factors, single, low / 2 * half - x2, 2 * slack(x2, y2, x.shape[1]), 2 * (x2 + y2.max() + low * (half + over.max())))
            else:
                i, j = _least(mine, factors, single, low - 1, np.full(len(mine), 1e-15 * (x.shape[1] + 8)), 2 + low)
            some = c[a + i] != c2[m + j]
            i, j = i[some], j[some]
            if not len(i):
                continue
            if ward:
                d = squares(mine, part, i, j) * 2 / (half[i] + over[j])
            else:
                d = 1 - np.concatenate([(mine[i[k : k + 8192]] * part[j[k : k + 8192]]).sum(1) for k in range(0, len(i), 8192)])
            rows = np.unique(i)
            old = a + rows[best[0][a + rows] < np.inf]
            i = np.concatenate([a + i, old])
            low_, high = (np.concatenate([f(c[i[: len(d)]], c2[m + j]), b[old]]) for f, b in ((np.minimum, best[1]), (np.maximum, best[2])))
            d = np.concatenate([d, best[0][old]])
            least = np.full(len(c), np.inf)
            np.minimum.at(least, i, d)
            tied = np.flatnonzero(d <= least[i] + np.abs(least[i]) * SAME + 1e-300)
            order = tied[np.lexsort((high[tied], low_[tied], i[tied]))]
            _, first = np.unique(i[order], return_index=True)
            kept = order[first]
            for b, v in zip(best, (d, low_, high)):
                b[i[kept]] = v[kept]


def _nearest(batches: Iterator[pa.RecordBatch], ward: bool) -> Iterator[pa.RecordBatch]:
    """(c, a, b, d) of pairs of blocks: of each asking cluster the nearest pair a < b among those it met."""
    held: list[tuple[np.ndarray, list[np.ndarray]]] = []
    for i, own, other in pairs(batches):
        if i == len(held):
            n = len(own[0])
            held.append((own[0].copy(), [np.full(n, np.inf), np.full(n, 1 << 62), np.full(n, 1 << 62)]))
        _closer(own, other, held[i][1], ward)
    for c, best in held:
        some = best[0] < np.inf
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[some]), pa.array(best[1][some]), pa.array(best[2][some]), pa.array(best[0][some])], names=["c", "a", "b", "d"])


def _meet(c: np.ndarray, s: np.ndarray, x: np.ndarray, c2: np.ndarray, s2: np.ndarray, y: np.ndarray, best: list[np.ndarray], ward: bool) -> None:
    """Keep in best (distance, smaller number, larger number) the nearest pair of each of c, seen c2."""
    own = np.argsort(c2)
    square = (y * y).sum(1)
    for i in range(0, len(c), ASKED):
        part = slice(i, i + ASKED)
        d = x[part] @ y.T
        if ward:
            d *= -2
            d += (x[part] ** 2).sum(1)[:, None]
            d += square
            np.maximum(d, 0, out=d)
            if (s[part] == s[i]).all() and (s2 == s2[0]).all():
                d *= 2 * s[i] * s2[0] / (s[i] + s2[0])
            else:
                d *= 2 * s[part][:, None] * s2 / (s[part][:, None] + s2)
        else:
            d *= -1
            d += 1
        at = np.minimum(np.searchsorted(c2, c[part], sorter=own), len(c2) - 1)
        mine = np.flatnonzero(c2[own[at]] == c[part])
        d[mine, own[at[mine]]] = np.inf
        least = d.min(1)
        row, col = np.nonzero(d <= (least + np.abs(least) * SAME + 1e-300)[:, None])
        finite = least[row] < np.inf
        row, col = row[finite], col[finite]
        low, high = np.minimum(c[part][row], c2[col]), np.maximum(c[part][row], c2[col])
        order = np.lexsort((high, low, row))
        first = np.flatnonzero(np.concatenate((row[order][:1] == row[order][:1], row[order][1:] != row[order][:-1])))
        row, low, high = row[order][first], low[order][first], high[order][first]
        old = [b[part][row] for b in best]
        gap = SAME * np.abs(least[row]) + 1e-300
        nearer = (least[row] < old[0] - gap) | (np.abs(least[row] - old[0]) <= gap) & ((low < old[1]) | (low == old[1]) & (high < old[2]))
        for b, new in zip(best, (least[row], low, high)):
            b[i + row[nearer]] = new[nearer]


def _searched(asking: DataFrame, blocks: DataFrame, ward: bool) -> DataFrame:
    """(c, nn, d): the nearest of the clusters in blocks to each of those that ask."""
    found = met(asking, blocks).mapInArrow(lambda batches: _nearest(batches, ward), "c long, a long, b long, d double")
    return found.select("c", F.when(F.col("a") == F.col("c"), F.col("b")).otherwise(F.col("a")).alias("nn"), "d")


def nearest(asking: DataFrame, clusters: DataFrame, most: int, ward: bool) -> DataFrame:
    """(c, nn, d): the nearest of the clusters (c, s, x), which are most, to each of those that ask."""
    width = clusters.select(F.size("x").alias("w")).limit(1).collect()
    wide = width[0]["w"] if width else 0
    return _searched(packed(asking, most, wide, "asking"), packed(clusters, most, wide), ward)


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, s, x) of rows, x as bytes, whose numbers are in lists."""
    for batch in batches:
        yield _rows(batch.column(0), batch.column(1), vectors(batch.column(2)))


def _rows(c: pa.Array, s: pa.Array, x: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(len(c) + 1, dtype=np.int32) * np.int32(8 * x.shape[1]))
    x = pa.Array.from_buffers(pa.binary(), len(c), [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(x))])
    return pa.RecordBatch.from_arrays([c, s, x], names=["c", "s", "x"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, s, x) of rows, x as bytes, from blocks of them."""
    for batch in batches:
        for i in range(batch.num_rows):
            c, s, x = opened(batch, i, 0)
            yield _rows(pa.array(c), pa.array(s), x)


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's rows (c, asks, s, x); two rows with one number are merged."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    c, asks, s = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(3))
    x = np.frombuffer(b"".join(v for b in held for v in b.column(3).to_pylist()), dtype=np.float64).reshape(len(c), -1)
    del held
    order = np.argsort(c, kind="stable")
    c = c[order]
    second = np.flatnonzero(c[1:] == c[:-1]) + 1
    a, b = order[second - 1], order[second]
    size = s[a] + s[b]
    centre = (x[a] * s[a][:, None] + x[b] * s[b][:, None]) / size[:, None]
    x, s, asks = x.copy(), s.copy(), asks.copy()
    x[a], s[a], asks[a] = centre, size, asks[a] | asks[b]
    c, order = np.delete(c, second), np.delete(order, second)
    for ask in (True, False):
        some = np.flatnonzero(asks[order] == ask)
        for part in np.array_split(some, max(1, -(-len(some) // MOST))):
            if len(part):
                at = order[part]
                yield pa.RecordBatch.from_arrays([pa.array([ask]), *[pa.array([v.tobytes()], pa.binary()) for v in (c[part], s[at], x[at])]], names=["asks", "c", "s", "x"])


def _placed(rows: DataFrame, n: int, width: int) -> DataFrame:
    """Stored blocks (asks, c, s, x) of about n rows (c, asks, s, x), of which two with one number merge.

    So many files as there are cores, or as their bytes need, as a task holds one: asking clusters, also few, lie in so many blocks.
    """
    parts = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, n // 256), -(-n * (8 * width + 16) // stored_blocks.PART))
    return stored(rows.repartition(parts, "c").mapInArrow(_blocked, "asks boolean, c binary, s binary, x binary"), "blocks")


def _told(near: DataFrame) -> DataFrame:
    """(c, nn, d, into) of near (c, nn, d): into is the number after the round of those that merge, nn the neighbour that is left.

    Without a neighbour, d is what no distance is below.
    """
    other = near.select(F.col("c").alias("nn"), F.col("nn").alias("back"))
    both = near.join(other, "nn", "left").select("c", "nn", "d", F.col("back").eqNullSafe(F.col("c")).alias("gone"))
    taken = both.where("gone").select(F.col("c").alias("nn"), F.lit(True).alias("taken"))
    into = F.when(F.col("gone"), F.least("c", "nn"))
    return both.join(taken, "nn", "left").select("c", F.when(F.col("taken").isNull(), F.col("nn")).alias("nn"), "d", into.alias("into"))


def merges(clusters: DataFrame, ward: bool, finish: int = FINISH) -> DataFrame:
    """(c, into, h): all merges of clusters (c, s, x), which are stored; the larger number goes into the smaller one at height h."""
    spark = clusters.sparkSession
    first = clusters.select(F.size("x").alias("w")).limit(1).collect()
    width, n = first[0]["w"] if first else 0, clusters.count()
    finish = min(finish, max(256, BYTES // (8 * max(1, width))))
    rows = clusters.select("c", F.col("s").cast("double").alias("s"), "x").mapInArrow(_flat, "c long, s double, x binary")
    blocks = _placed(rows.withColumn("asks", F.lit(True)).select("c", "asks", "s", "x"), n, width)
    out, near = [], None
    while n > finish:
        found = _searched(blocks.where("asks").drop("asks"), blocks.drop("asks"), ward)
        near = stored(found if near is None else near.unionByName(found), "nearest")
        told = stored(_told(near), "told")
        lost = F.col("nn").isNull() & (F.coalesce("into", "c") == F.col("c"))
        merged, waiting, bounds = told.agg(F.count_if(F.col("c") != F.col("into")), F.count_if(lost), F.percentile_approx(F.when(lost, F.col("d")), list(SHARES), 1000)).first()
        # All ask where few do, and where waiting left nothing to merge.
        most = next((b for share, b in zip(SHARES, bounds or ()) if merged and share * waiting * n >= WORTH), float("inf"))
        if not merged and not waiting:  # rounding parted those that are nearest: the nearest of all merge
            pair = [F.least("c", "nn").alias("a"), F.greatest("c", "nn").alias("b"), F.col("d")]
            least = near.select(*pair).orderBy("d", "a", "b").first()
            if least is None:
                raise ValueError("no cluster has a nearest one: vectors must hold finite numbers")
            a, b, height = least
            both = F.col("c").isin(a, b)
            nn = F.when(~both & ~F.col("nn").isin(a, b), F.col("nn"))
            told = stored(near.select("c", nn.alias("nn"), F.when(both, F.lit(height)).otherwise(F.col("d")).alias("d"), F.when(both, F.lit(a)).alias("into")), "told")
            merged = 1
        out.append(told.where("c <> into").select("c", "into", F.col("d").alias("h")))
        asks = lost & (F.col("d") <= most)
        changes = told.where(F.col("into").isNotNull() | asks).select("c", "into", asks.alias("asks"))
        rows = blocks.select("c", "s", "x").mapInArrow(_unpacked, "c long, s double, x binary").join(changes, "c", "left")
        n -= merged
        blocks = _placed(rows.select(F.coalesce("into", "c").alias("c"), F.coalesce("asks", F.lit(False)).alias("asks"), "s", "x"), n, width)
        near = told.where(F.coalesce("into", "c") == F.col("c")).where(~asks).select("c", "nn", "d")
    # At most finish clusters.
    rest = [(np.frombuffer(r["c"], np.int64), np.frombuffer(r["s"]), np.frombuffer(r["x"]).reshape(-1, width)) for r in blocks.select("c", "s", "x").collect()]
    c, s, x = (np.concatenate(v) for v in zip(*rest)) if rest else (np.zeros(0, np.int64), np.zeros(0), np.zeros((0, width)))
    order = np.argsort(c)
    last = spark.createDataFrame(chained(c[order], s[order], x[order], ward), "c long, into long, h double")
    return reduce(DataFrame.unionByName, out, last)


def chained(c: np.ndarray, s: np.ndarray, x: np.ndarray, ward: bool) -> list[tuple[int, int, float]]:
    """merges of a few clusters, in rounds like those of the table."""
    out: list[tuple[int, int, float]] = []
    best = [np.full(len(c), np.inf), np.full(len(c), 1 << 62), np.full(len(c), 1 << 62)]
    asks = np.ones(len(c), dtype=bool)
    while len(c) > 1:
        found = [np.full(asks.sum(), np.inf), np.full(asks.sum(), 1 << 62), np.full(asks.sum(), 1 << 62)]
        _meet(c[asks], s[asks], x[asks], c, s, x, found, ward)
        for b, f in zip(best, found):
            b[asks] = f
        pairs, times = np.unique(np.column_stack(best[1:]), axis=0, return_counts=True)
        done = pairs[times == 2] if (times == 2).any() else np.array([best[1:]]).transpose(0, 2, 1)[0][[int(np.lexsort((best[2], best[1], best[0]))[0])]]
        order = np.argsort(c)
        a, b = (order[np.searchsorted(c, side, sorter=order)] for side in done.T)
        size = s[a] + s[b]
        h = 2 * s[a] * s[b] / size * ((x[a] - x[b]) ** 2).sum(1) if ward else 1 - (x[a] * x[b]).sum(1)
        out += zip(c[b].tolist(), c[a].tolist(), h.tolist())
        x[a], s[a] = (x[a] * s[a][:, None] + x[b] * s[b][:, None]) / size[:, None], size
        # Those ask whose pair is no more.
        asks = np.isin(best[1], done) | np.isin(best[2], done)
        asks[a] = True
        stay = np.ones(len(c), dtype=bool)
        stay[b] = False
        c, s, x, asks, best = c[stay], s[stay], x[stay], asks[stay], [v[stay] for v in best]
    return out


def roots(up: DataFrame) -> DataFrame:
    """(c, root) of a forest (c, into): where each node's way ends. Ways double in length each round."""
    now = stored(up.select("c", F.col("into").alias("root")), "ways")
    while True:
        ends = now.select(F.col("c").alias("root"), F.col("root").alias("next"))
        further = stored(now.join(ends, "root", "left").select("c", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        now = further.select("c", "root")
        if not further.where("moved").limit(1).count():
            return now


def linked(df: DataFrame, id_column: str, x: Column, clusters: int, ward: bool, finish: int = FINISH) -> DataFrame:
    """(id, cluster) of each row: the clusters that are left when merges, from the lowest on, leave so many. x: an array of doubles without nulls.

    Clusters are numbered in the order of their least id. There are fewer where there are fewer different vectors.
    """
    rows = df.select(F.col(f"`{id_column}`").alias("id"), x.alias("x"))
    if ward:
        width = rows.agg(F.max(F.size("x"))).first()[0] or 0
        means = rows.agg(*[F.avg(F.col("x")[i]) for i in range(width)]).first() if width else ()
        rows = rows.withColumn("x", F.array(*[F.col("x")[i] - F.lit(m) for i, m in enumerate(means)]).cast("array<double>"))
    else:
        length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v))
        rows = rows.withColumn("x", F.transform("x", lambda v: v / F.greatest(length, F.lit(1e-300))))
    rows = stored(rows, "points")
    different = rows.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("s"))
    table = stored(different.select(F.monotonically_increasing_id().alias("c"), "s", "x"), "clusters")
    found = stored(merges(table, ward, finish), "merges")
    # Fewer rows than there are clusters.
    cut = [r["c"] for r in found.orderBy(F.desc("h"), F.desc("c")).limit(max(0, clusters - 1)).collect()]
    way = roots(found.where(~F.col("c").isin(cut)) if cut else found)
    owner = stored(table.join(way, "c", "left").select("x", F.coalesce("root", "c").alias("root")), "owners")
    placed = stored(rows.join(owner, "x").select("id", "root"), "placed")
    names = {r["root"]: i for i, r in enumerate(placed.groupBy("root").agg(F.min("id").alias("first")).orderBy("first").collect())}
    number = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])[F.col("root")] if names else F.lit(0)
    return placed.select(F.col("id").alias(id_column), number.cast("int").alias("cluster"))
