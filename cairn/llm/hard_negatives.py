"""Hard-negative mining by a two-dimensional block matrix multiply (SUMMA-style).

Scores are integer inner products of anchors with all rows. Rows are sharded in blocks of ROWS, dimensions in chunks of
CHUNK, anchors in panels of PANEL. In a step, the chunks of a panel (PANEL vectors at most) are broadcast along the grid:
the task that has a chunk of a block of rows multiplies it with the panel's same chunk, and the partial tile, an int64 for
each anchor and row, is shuffled to the task that adds up the tiles of this panel and block. That task goes over its
blocks and keeps, for each anchor and window of scores, the best rows; only these leave it. So neither all scores of a
panel nor of a row are ever together, and disk holds the partial tiles of one panel at a time.

1. Rows are ordered by label, so blocks have narrow ranges of labels. Positives: a panel meets the blocks whose labels it
   shares, and keeps the best POSITIVES rows of an anchor's label.
2. Each positive gives its anchor a window of scores. A panel meets all blocks, and keeps, for each window, the best
   NEGATIVES rows of other labels. No score is computed twice but for the blocks that mix labels.

Products are exact: in double precision as long as no score can reach 2 ** 53 (BLAS), in 64-bit integers up to 2 ** 62,
beyond it an error. Partial tiles travel as their distances from the least, in as few bytes as these need.

Defined cases: rows without label or vector, or with a null or non-finite entry, take no part; vectors shorter than the
longest end in zeros; a null vec_id is no anchor, keeps its label, and comes last among ties; rows of one vec_id are rows
of their own (each an anchor, each the other's partner), ties among them follow the order of the stored rows; an anchor
without a positive or a negative has no rows; an empty table gives none; other columns don't pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.blocks import keyed, pack, record, unpack
from cairn.llm.common import map_arrow, shards, short_batches, stash
from cairn.llm.vectors import finite, matrix, narrow, widen

ROWS, CHUNK, PANEL = 1024, 32, 1024
SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Percent of a positive's score that a negative may have.
LEAST, MOST = 50, 95
_NO_ID = (1 << 63) - 1
_LOWEST, _HIGHEST = -(1 << 63) + 1, (1 << 63) - 1

#: A chunk of a block: number of the block and of the chunk, least and largest label, who the rows are (first chunk only), and their entries.
SHARD = "block long, chunk int, low long, high long, meta binary, data binary"


def _shards(rows: DataFrame, width: int, size: int, chunk: int, scale: int) -> DataFrame:
    """SHARD of rows (row, vec_id, label, vector, least, most): in their order, size at a time. least, most: windows of an anchor's scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        many = done = 0

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal done
            batch = table.combine_chunks().to_batches()[0]
            row, ids, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = np.floor(matrix(batch.column(3), width) * scale).astype(np.int64)
            windows = [np.array(batch.column(i).to_pylist(), dtype=np.int64).ravel() for i in (4, 5)]
            for k in range(max(1, -(-width // chunk))):
                meta = pack(row, ids, label, *windows) if k == 0 else b""
                yield record(SHARD, [TaskContext.get().partitionId() << 32 | done], [k], [int(label.min())], [int(label.max())], [meta], [narrow(x[:, k * chunk : (k + 1) * chunk])])
            done += 1

        for batch in batches:
            while len(batch):
                part, batch = batch.slice(0, size - many), batch.slice(size - many)
                held.append(part)
                many += len(part)
                if many == size:
                    yield from flush(pa.Table.from_batches(held))
                    held, many = [], 0
        if many:
            yield from flush(pa.Table.from_batches(held))

    short_batches(rows.sparkSession)
    return rows.select("row", "vec_id", "label", "vector", "least", "most").mapInArrow(run, SHARD)


#: A partial tile of a panel and a block.
TILE = "panel long, block long, chunk int, anchors binary, rows binary, tile binary"


def _partial(exact: bool):
    """TILE of a panel's chunks beside a block's: entries of anchors times entries of rows. exact: no score reaches 2 ** 53."""

    def make():
        def each(batch: pa.RecordBatch):
            for panel, block, chunk, anchors, rows, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = widen(a), widen(b)
                tile = (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64) if exact else x @ y.T
                yield record(TILE, [panel], [block], [chunk], [anchors], [rows], [narrow(tile)])

        return each

    return make


@dataclass
class Best:
    """The best k rows of each slot: higher scores first, ties by smaller id."""

    k: int
    slots: int
    held: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0, dtype=np.int64)] * 4)

    def __post_init__(self) -> None:
        #: Scores below it can't enter a slot any more, nor can equal ones of a larger id than last.
        self.bound = np.full(self.slots, _LOWEST, dtype=np.int64)
        self.last = np.full(self.slots, _NO_ID, dtype=np.int64)

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        slot, score, ids, row = (np.concatenate(c) for c in zip(self.held, (slot, score, ids, row)))
        order = np.lexsort((row, ids, -score, slot))
        slot = slot[order]
        first = np.flatnonzero(np.concatenate((slot[:1] == slot[:1], slot[1:] != slot[:-1])))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        stay = rank < self.k
        self.held = [slot[stay], *(x[order][stay] for x in (score, ids, row))]
        full = rank[stay] == self.k - 1
        self.bound[self.held[0][full]], self.last[self.held[0][full]] = self.held[1][full], self.held[2][full]


FOUND = "anchor long, slot int, score long, vec_id long, row long"


def _reduced(k: int, same: bool):
    """FOUND of TILE in the order of panels and blocks: the best k rows in each window of an anchor, of its label if same, else of others.

    All anchors of a panel that came from one task have as many windows; empty ones begin above where they end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tiles in keyed(batches, 1):
            best = who = None
            for block, parts in _by_block(tiles):
                tile, meta, theirs = None, None, None
                for _, anchors, rows, data in parts:
                    part = widen(data)
                    tile = part if tile is None else tile + part
                    meta, theirs = anchors or meta, rows or theirs
                row, ids, label, least, most = unpack(meta)
                other_row, other_id, other_label, _, _ = unpack(theirs)
                windows = len(least) // len(row)
                if best is None:
                    best, who = Best(k, len(least)), row
                fits = label[:, None] == other_label[None, :]
                fits = fits & (row[:, None] != other_row[None, :]) if same else ~fits
                for w in range(windows):
                    slot = np.arange(len(row)) * windows + w
                    low, high = np.maximum(least[slot], best.bound[slot]), most[slot]
                    i, j = np.nonzero((tile >= low[:, None]) & (tile <= high[:, None]) & fits)
                    may = (tile[i, j] > best.bound[slot[i]]) | (other_id[j] <= best.last[slot[i]])
                    i, j = i[may], j[may]
                    if len(i):
                        best.offer(slot[i], tile[i, j], other_id[j], other_row[j])
            slot, score, ids, other = best.held
            yield record(FOUND, who[slot // windows], (slot % windows).astype(np.int32), score, ids, other)

    return run


def _by_block(tiles: Iterator[tuple]) -> Iterator[tuple[int, list[tuple]]]:
    """(block, its partial tiles) from rows in the order of blocks."""
    last, held = None, []
    for block, *rest in tiles:
        if held and block != last:
            yield last, held
            held = []
        last = block
        held.append(tuple(rest))
    if held:
        yield last, held


def _multiply(blocks: DataFrame, panels: DataFrame, k: int, same: bool, exact: bool) -> DataFrame:
    """(anchor, slot, rank, score, vec_id, row): the best k rows of all blocks in each window of an anchor, panel by panel."""
    numbers = [r[0] for r in panels.where("chunk = 0").select("block").orderBy("block").collect()]
    out = None
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    for number in numbers:
        panel = panels.where(F.col("block") == number).select(
            F.col("block").alias("panel"), "chunk", F.col("low").alias("a_low"), F.col("high").alias("a_high"), F.col("meta").alias("anchors"), F.col("data").alias("a")
        )
        # A chunk of a panel is a row of PANEL * CHUNK entries at most.
        met = blocks.withColumnsRenamed({"meta": "rows", "data": "b"}).join(F.broadcast(panel), "chunk")
        if same:
            met = met.where("low <= a_high AND high >= a_low")
        tiles = map_arrow(met.select("panel", "block", "chunk", "anchors", "rows", "a", "b"), _partial(exact), TILE)
        dealt = tiles.repartition(shards(blocks.sparkSession), "panel", "block").sortWithinPartitions("panel", "block", "chunk")
        best = dealt.mapInArrow(_reduced(k, same), FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = stash(best, "best")
        out = best if out is None else out.unionByName(best)
    return out


def hard_negatives(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, rows: int = ROWS, chunk: int = CHUNK, panel: int = PANEL,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the first negatives of each anchor's first positives.

    anchor: whether a row of df is an anchor. A negative has least to most percent of the positive's score.
    """
    spark = df.sparkSession
    parts = shards(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    label = F.col(label) if isinstance(label, str) else label
    taken = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    taken = taken.where(F.col("label").isNotNull() & finite("vector"))
    ordered = taken.repartitionByRange(parts, "label", F.xxhash64("vec_id")).sortWithinPartitions("label", "vec_id")
    numbered = stash(ordered.withColumn("row", F.monotonically_increasing_id()), "vectors")
    entries = F.aggregate("vector", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    width, largest, n = numbered.agg(F.max(F.size("vector")), F.max(entries), F.count_if("anchor")).first()
    if not n:
        return spark.createDataFrame([], schema)
    bound = (float(largest) * scale + 1) ** 2 * max(1, width)
    if bound >= 2.0**62:
        raise ValueError("vectors have entries for which scores may exceed 64 bits")
    exact = bound < 2.0**53
    none = F.array().cast("array<long>")
    blocks = stash(_shards(numbered.withColumns({"least": none, "most": none}), width, rows, chunk, scale), "blocks", "none")
    anchors = numbered.where("anchor")
    cuts = -(-n // panel)

    def paneled(windows: DataFrame) -> DataFrame:
        return stash(_shards(windows.repartitionByRange(cuts, "row").sortWithinPartitions("row"), width, panel, chunk, scale), "panels", "none")

    everything = anchors.withColumns({"least": F.array(F.lit(_LOWEST)), "most": F.array(F.lit(_HIGHEST))})
    liked = _multiply(blocks, paneled(everything), positives, True, exact).select(F.col("anchor").alias("row"), "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # ceil(least * p / 100) and floor(most * p / 100), in whole numbers.
    low = -F.expr("(-(positive_score) * CAST({0} AS BIGINT) - pmod(-(positive_score) * CAST({0} AS BIGINT), 100L)) div 100L".format(least))
    high = F.expr("(positive_score * CAST({0} AS BIGINT) - pmod(positive_score * CAST({0} AS BIGINT), 100L)) div 100L".format(most))
    limits = liked.select("row", "rank", low.alias("low"), high.alias("high"))
    windows = limits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))
    # Each anchor of a panel has as many windows: those it lacks are empty.
    slots = F.sequence(F.lit(1), F.lit(positives))

    def limit(name: str, empty: int) -> Column:
        return F.transform(slots, lambda i: F.coalesce(F.get(F.col("w"), i - 1)[name], F.lit(empty)))

    asked = anchors.join(windows, "row").withColumns({"least": limit("low", _HIGHEST), "most": limit("high", _LOWEST)})
    worst = _multiply(blocks, paneled(asked), negatives, False, exact)
    if worst is None:
        return spark.createDataFrame([], schema)
    worst = worst.select(F.col("anchor").alias("row"), (F.col("slot") + 1).alias("pos"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select("row", F.col("vec_id").alias("anchor_id")).join(liked.withColumnRenamed("rank", "pos"), "row").join(worst, ["row", "pos"])

    def shown(c: str) -> Column:
        return F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)

    return named.select("anchor_id", shown("positive_id"), "rank", shown("negative_id"), "positive_score", "negative_score")


SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.ar, p.k ORDER BY s.score DESC, s.vec_id, s.r) AS INTEGER) AS rank
  FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n
"""
