"""SimHash near-duplicates by vantage-point trees.

A fingerprint has 64 bits: bit i is 1 if it is set in over half the XXH64 values (seed 42) of a text's shingles of WIDTH
words, repeats included. Fingerprints within RADIUS bits link; documents are grouped by what they reach over links.

1. Fingerprints are computed a batch of texts at a time, and distinct ones continue: copies collapse before any search.
2. A vantage-point tree is fitted on a bounded sample of fingerprints and dealt to all tasks. Its inner nodes split by the
   Hamming distance to a vantage point at a radius near the median; its leaves are shards. Each fingerprint is at home in
   one shard. By the triangle inequality a partner's distance to the vantage point differs by the search radius at most,
   so a fingerprint goes as a query to the other side only if it lies that near the boundary, and every pair meets in
   exactly one shard, the home of one of the two.
3. Random fingerprints lie 32 +- 4 bits from any vantage point, so a band of 3 bits around the median holds a third of
   them. Of a pair within 3 bits, though, one half of 32 bits differs in 1 bit at most: a tree for each half is searched
   with radius 1, whose bands are three times narrower, and what is found is compared on all 64 bits.
4. A task carries the tree on within its shard down to LEAF fingerprints, which are compared with each other and with the
   queries that came this far. A node that a half can't split (equal halves) is split by all 64 bits and radius 3.
   Shards of more than BLOCK homes are cut in blocks, and pairs of blocks are tasks of their own.
5. Pairs aren't rows: a task returns edges to one fingerprint of each component it saw, and `components` joins these.

The search is exact. The sample decides only how evenly shards are filled.

Defined cases: null and empty texts have fingerprint zero, linked like any other; fewer than WIDTH words make one shingle
of all of them; a null doc_id is larger than any and, where a component has no other, its component_id is null; repeated
rows have equal results; an empty table gives no rows; other columns don't pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import map_arrow, pin, shards, slices, stash, texts_of
from cairn.llm.components import components
from cairn.llm.near_dup import _groups

WIDTH, RADIUS, SEED = 3, 3, 42
#: Fingerprints that a shard is meant to have, and shards at most.
SHARD, MOST_SHARDS = 1 << 14, 1 << 14
#: Sampled fingerprints for each shard; with MOST_SHARDS they have 2 MB.
SAMPLED = 16
#: Homes of a block, and fingerprints that are compared each with each.
BLOCK, LEAF = 1 << 18, 192
#: Halves of a fingerprint, each searched with a third of the radius.
HALVES = (np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000))
WHOLE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A fingerprint with at least 1/HOT_SHARE of all rows is hot; there are at most HOT_SHARE, so they are broadcast.
HOT_SHARE = 1024

_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, width: int = WIDTH) -> list[bytes]:
    """XXH64 of each width words in a row as 8 bytes, the highest first; of all words where there are fewer."""
    words = text.encode().lower().split()
    if len(words) < width:
        return [xxhash.xxh64_digest(b" ".join(words), SEED)] if words else []
    return list(map(xxhash.xxh64_digest, map(b" ".join, zip(*(words[i:] for i in range(width)))), repeat(SEED)))


def bit_counts(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often each bit is set in successive groups of n[i] hashes: 64 numbers a group. Bytes of a word count eight bits at a time."""
    most = 255
    pieces = -(-n // most)
    group = np.repeat(np.arange(len(n)), pieces)
    first = np.cumsum(pieces) - pieces
    starts = (np.cumsum(n) - n)[group] + (np.arange(len(group)) - first[group]) * most
    out = np.zeros((len(n), 64), dtype=np.int64)
    if not len(group):
        return out
    lanes = np.empty((len(group), 8, 8), dtype=np.uint8)
    for bit in range(8):
        lanes[:, :, bit] = np.add.reduceat(h >> np.uint64(bit) & _LANES, starts).view(np.uint8).reshape(-1, 8)
    some = np.flatnonzero(n)
    out[some] = np.add.reduceat(lanes.reshape(-1, 64).astype(np.int64), first[some], axis=0)
    return out


def fingerprint(texts: list[str]) -> np.ndarray:
    """The fingerprints of texts, as uint64."""
    held = [shingle_hashes(t) for t in texts]
    n = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
    h = np.frombuffer(b"".join(x for each in held for x in each), dtype=">u8").astype(np.uint64)
    return np.packbits(2 * bit_counts(h, n) > n[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of each row; fp as a signed long."""

    def make():
        def each(batch: pa.RecordBatch):
            for part, texts in slices(batch, budget=1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprint(texts).view(np.int64))], names=["doc_id", "fp"])

        return each

    return map_arrow(texts_of(df, id_col, text_col), make, "doc_id long, fp long")


def _distance(x: np.ndarray, v: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((x ^ v) & mask)


def split(values: np.ndarray, mask: np.uint64, tries: int = 4) -> tuple[np.uint64, int] | None:
    """(vantage point, radius): values nearer than the radius lie inside, about half of them; None if nothing splits off a fair part."""
    best = None
    for v in values[:: max(1, len(values) // tries)][:tries]:
        below = np.cumsum(np.bincount(_distance(values, v, mask), minlength=65))
        radius = int(np.argmin(np.abs(below - len(values) / 2))) + 1
        inside = int(below[radius - 1])
        if len(values) <= 64 * min(inside, len(values) - inside) and (best is None or abs(2 * inside - len(values)) < best[0]):
            best = abs(2 * inside - len(values)), v, radius
            if best[0] * 8 <= len(values):
                break
    return best and best[1:]


@dataclass(frozen=True)
class Tree:
    """Nodes of a vantage-point tree: a child is a node's number, or -1 - shard."""

    mask: np.uint64
    reach: int
    vantage: np.ndarray
    radius: np.ndarray
    inside: np.ndarray
    outside: np.ndarray
    shards: int

    @staticmethod
    def fit(sample: np.ndarray, leaf: int, mask: np.uint64, reach: int) -> Tree:
        vantage, radius, child = [], [], []
        n_shards = 0
        todo = [(sample, -1, 0)]  # values, the parent's number, which of its children this is
        while todo:
            values, parent, side = todo.pop()
            cut = split(values, mask) if len(values) > leaf else None
            if cut is None:
                me = -1 - n_shards
                n_shards += 1
            else:
                me = len(vantage)
                vantage.append(cut[0])
                radius.append(cut[1])
                child.append([0, 0])
                near = _distance(values, *cut[:1], mask) < cut[1]
                todo += [(values[near], me, 0), (values[~near], me, 1)]
            if parent >= 0:
                child[parent][side] = me
        both = np.array(child, dtype=np.int64).reshape(-1, 2)
        return Tree(mask, reach, np.array(vantage, dtype=np.uint64), np.array(radius, dtype=np.int64), both[:, 0], both[:, 1], n_shards)

    def deal(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, homes, queries): which of x are at home in the shard, and which only ask there."""
        todo = [(0 if len(self.vantage) else -1, x, x[:0])]
        while todo:
            node, homes, queries = todo.pop()
            if not len(homes) and not len(queries):
                continue
            if node < 0:
                yield -1 - node, homes, queries
            else:
                inner, outer = parted(homes, queries, self.vantage[node], int(self.radius[node]), self.mask, self.reach)
                todo += [(int(self.inside[node]), *inner), (int(self.outside[node]), *outer)]


def parted(homes: np.ndarray, queries: np.ndarray, v: np.uint64, radius: int, mask: np.uint64, reach: int, within: bool = True) -> tuple:
    """(homes, queries) inside and outside of a ball. A home asks outside if it lies near the boundary; a query goes wherever a partner may be."""
    d, q = _distance(homes, v, mask).astype(np.int16), _distance(queries, v, mask).astype(np.int16)
    near = d < radius
    asks = homes[near & (d >= radius - reach)] if within else homes[:0]
    return (homes[near], queries[q < radius + reach]), (homes[~near], np.concatenate([queries[q >= radius - reach], asks]))


def _compared(homes: np.ndarray, queries: np.ndarray, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within RADIUS: of homes and queries, and of homes if within."""
    for at in range(0, len(queries), 4096):
        i, j = np.nonzero(np.bitwise_count(homes[:, None] ^ queries[None, at : at + 4096]) <= RADIUS)
        if len(i):
            yield homes[i], queries[at + j]
    for at in range(0, len(homes) if within else 0, 4096):
        part = homes[at : at + 4096]
        for to in range(at, len(homes), 4096):
            other = homes[to : to + 4096]
            i, j = np.nonzero(np.bitwise_count(part[:, None] ^ other[None, :]) <= RADIUS)
            stay = i < j if to == at else slice(None)
            if len(i):
                yield part[i[stay]], other[j[stay]]


def close_pairs(homes: np.ndarray, queries: np.ndarray, mask: np.uint64, within: bool = True, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within RADIUS of a shard, by a vantage-point tree over its homes. Pairs of queries are found elsewhere."""
    todo = [(homes, queries, mask)]
    while todo:
        homes, queries, mask = todo.pop()
        if not len(homes) or not within and not len(queries):
            continue
        if len(homes) > leaf:
            sample = homes[:: max(1, len(homes) // 512)]
            cut = split(sample, mask)
            if cut is None and mask != WHOLE:
                todo.append((homes, queries, WHOLE))
                continue
            if cut is not None:
                inner, outer = parted(homes, queries, *cut, mask, RADIUS if mask == WHOLE else RADIUS // 2, within)
                todo += [(*inner, mask), (*outer, mask)]
                continue
        yield from _compared(homes, queries, within)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the components of edges a-b, without the roots themselves: the root is the least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        before = root.copy()
        for side in (x, y):
            np.minimum.at(root, root[side], least)
            np.minimum.at(root, side, least)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            some = root != np.arange(len(nodes))
            return nodes[some], nodes[root[some]]


def _route(trees: list[Tree], homes_only: bool):
    """(key, side, fp) of (fp): key is tree << 32 | shard; side 0 at home, 2 a query. If homes_only: (key, n) in place of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        many = 0

        def flush() -> Iterator[pa.RecordBatch]:
            x = np.concatenate(held).view(np.uint64)
            held.clear()
            for t, tree in enumerate(trees):
                keys, sides, out = [], [], []
                for shard, homes, queries in tree.deal(x):
                    if homes_only:
                        keys.append([t << 32 | shard])
                        out.append(np.array([len(homes)]))
                        continue
                    for side, y in ((0, homes), (2, queries)):
                        keys.append(np.full(len(y), t << 32 | shard))
                        sides.append(np.full(len(y), side, dtype=np.int32))
                        out.append(y.view(np.int64))
                if homes_only:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(out))], names=["key", "n"])
                else:
                    whole = pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(sides)), pa.array(np.concatenate(out))], names=["key", "side", "fp"])
                    yield from (whole.slice(i, 1 << 16) for i in range(0, len(whole), 1 << 16))

        for batch in batches:
            held.append(batch.column(0).to_numpy())
            many += batch.num_rows
            if many >= 1 << 19:
                yield from flush()
                many = 0
        if many:
            yield from flush()

    return run


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): edges to one fingerprint of each component that shards (key, bi, bj, side, fp), in this order, show."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []

    def pressed() -> tuple[np.ndarray, np.ndarray]:
        x, y = stars(np.concatenate(a), np.concatenate(b))
        a[:], b[:] = [x], [y]
        return x, y

    many = 0
    for held in _groups(batches, []):
        table = pa.Table.from_batches(held)
        fp, side = table["fp"].to_numpy().view(np.uint64), table["side"].to_numpy()
        key, within = table["key"][0].as_py(), table["bi"][0].as_py() == table["bj"][0].as_py()
        first, rest = fp[side == 0], fp[side > 0]
        for x, y in close_pairs(first, rest, HALVES[key >> 32], within):
            a.append(x)
            b.append(y)
            many += len(x)
            if many > 1 << 20:
                many = len(pressed()[0])
    if a:
        x, y = pressed()
        for i in range(0, len(x), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)].view(np.int64)), pa.array(y[i : i + (1 << 16)].view(np.int64))], names=["a", "b"])


def linked(fps: DataFrame, n: int, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(a, b): edges that connect what links connect, of n distinct fingerprints (fp), which are stored."""
    parts = shards(fps.sparkSession)
    wanted = min(MOST_SHARDS, max(parts, -(-n // shard)))
    drawn = fps.orderBy(F.xxhash64("fp"), "fp").limit(wanted * SAMPLED).toArrow()
    sample = drawn.column("fp").to_numpy().view(np.uint64)
    trees = [Tree.fit(sample, SAMPLED, half, RADIUS // 2) for half in HALVES]
    sizes = fps.mapInArrow(_route(trees, True), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # At most as many rows as the trees have shards.
    large = pin(sizes.where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    rows = fps.mapInArrow(_route(trees, False), "key long, side int, fp long")
    rows = rows.join(F.broadcast(large), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine, each = F.pmod(F.xxhash64("fp", F.lit(5)), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    # A home meets each block of homes once; a query meets all homes, block by block.
    home = F.transform(each, lambda o: F.struct(F.least(mine, o).alias("bi"), F.greatest(mine, o).alias("bj"), (mine > o).cast("int").alias("side")))
    ask = F.transform(each, lambda o: F.struct(o.alias("bi"), o.alias("bj"), F.lit(2).alias("side")))
    placed = rows.select("key", "fp", F.explode(F.when(F.col("side") == 0, home).otherwise(ask)).alias("at")).select("key", "at.*", "fp")
    dealt = placed.repartition(parts, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return dealt.mapInArrow(_links, "a long, b long")


def simhash(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, group_size (rows of this fingerprint) of each row."""
    rows = stash(fingerprints(df, id_col, text_col), "fingerprints")
    groups = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    total, n = groups.agg(F.sum("n"), F.count(F.lit(1))).first()
    edges = linked(groups.select("fp"), n, shard, block)
    found = pin(components(edges).select(F.col("node").alias("fp"), "root"))
    placed = pin(found.join(groups, "fp"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    info = pin(groups.join(named.withColumn("linked", F.lit(True)), "fp", "left").select("fp", "n", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id")))
    hot_size = max(2, -(-(total or 0) // HOT_SHARE))
    hot = info.where(F.col("n") >= hot_size)
    # Rows of hot fingerprints find theirs in a broadcast of at most HOT_SHARE rows, so the shuffled join has no hot key.
    met = rows.join(F.broadcast(hot), "fp", "left")
    cold = met.where("n is null").select("doc_id", "fp").join(info.where(F.col("n") < hot_size).hint("shuffle_merge"), "fp")
    both = met.where("n is not null").select("doc_id", "fp", "n", "component_id").unionByName(cold)
    return both.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("n").alias("group_size"))
