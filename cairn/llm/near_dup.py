"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of hashes of WIDTH words in a row; links are pairs of different sets with Jaccard similarity of
THRESHOLD or more. Documents of equal sets form a class, which its smallest id represents; links join classes.

1. Candidates: MinHash values in BANDS bands of ROWS (a pair at the threshold shares none with probability 5e-8).
   Which bands really repeat is found on narrow rows; signatures move for these alone, and for the few that a Bloom
   filter of bounded size takes for them.
2. Within a band's bucket, pairs compare their MinHash values STEP at a time. After n values with m agreements and a
   uniform prior, the similarity is Beta(m + 1, n - m + 1); a pair is dropped when the posterior probability that it
   reaches the threshold is below TOLERANCE. The pairs that survive connect classes to clumps.
3. Within a clump every pair goes through the same pruning once, and what survives is verified on the whole sets. So no
   link is counted twice, and pairs are never rows: a task returns link counts, and edges to one member a component.

Buckets and clumps of more than BLOCK members or SET_BYTES of sets are split in blocks, and pairs of blocks are tasks of
their own: no group is gathered in one place, and none is capped. A pair is lost only with the probabilities above.

A class is known by the row that represents it, and its text by 128 bits of hash of id and text: ids may be null or
repeat.

Defined cases: fewer than WIDTH words make one shingle of all of them; null and empty texts have no shingle, are equal
to each other and link to nothing; a null doc_id is larger than any; equal ids with different texts count as they are;
an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.blocks import by_bucket
from cairn.llm.common import map_arrow, pin, shards, slices, stash, texts_of
from cairn.llm.components import components
from cairn.llm.exact_dedup import FILTER_BYTES, exact_dedup, flag_members, repeats

WIDTH, THRESHOLD = 5, 0.8
VALUES, ROWS = 128, 4
BANDS = VALUES // ROWS
STEP, TOLERANCE = 8, 1e-6
BLOCK, SET_BYTES = 1024, 16 << 20

_ODD = np.random.default_rng(2718).integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(3141).integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of each width words in a row; of all words where there are fewer."""
    words = text.encode().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(width, len(h))):
        out = (out ^ h[i : i + n]) * _MIX[i]
        out ^= out >> np.uint64(32)
    out *= _ODD[0]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def minhash(s: np.ndarray) -> np.ndarray:
    """VALUES minima of a set's hashes times odd numbers."""
    out = np.full(VALUES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(s), 1024):
        np.minimum(out, (s[i : i + 1024, None] * _ODD[None, :]).min(0), out=out)
    return out


@functools.cache
def fewest(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest agreements in n values with which a pair stays: P(similarity >= threshold | m of n) = P(Binomial(n + 1, threshold) <= m)."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def prune(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs a[i], b[j] of signatures stay when their values are compared step by step."""
    alive = np.arange(len(i))
    agree = np.zeros(len(i), dtype=np.int16)
    for at in range(0, VALUES, STEP):
        agree += (a[i[alive], at : at + STEP] == b[j[alive], at : at + STEP]).sum(1).astype(np.int16)
        stay = agree >= fewest(at + STEP)
        alive, agree = alive[stay], agree[stay]
        if not len(alive):
            break
    return alive


def pairs(a: np.ndarray, b: np.ndarray | None, size_a: np.ndarray, size_b: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of pairs that pruning leaves, of a with b, or within a. Sizes of sets must allow the threshold."""
    same = b is None
    b = a if same else b
    rows_ = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), rows_):
        part = np.arange(at, min(at + rows_, len(a)))
        low, high = size_a[part][:, None] * threshold, size_a[part][:, None] / threshold
        ok = (size_b[None, :] >= low - 1e-9) & (size_b[None, :] <= high + 1e-9)
        if same:
            ok &= np.arange(len(b))[None, :] > part[:, None]
        i, j = np.nonzero(ok)
        i = part[i]
        if len(i):
            stay = prune(a, b, i, j)
            if len(stay):
                yield i[stay], j[stay]


class Forest:
    """Union-find over ids."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in self.up if (r := self.root(x)) != x]


def signatures(df: DataFrame) -> DataFrame:
    """(doc_id, h, g, n, digest, sig, bands) of (doc_id, text, h, g): size and digest of the set, 16 bits of each MinHash value, keys of its bands."""

    def make():
        def each(batch: pa.RecordBatch):
            for part, texts in slices(batch):
                n, digest, sig, bands = [], [], [], []
                for text in texts:
                    s = shingles(text)
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    values = minhash(s)
                    sig.append((values >> np.uint64(8)).astype(np.uint16).tobytes())
                    keys = np.arange(BANDS, dtype=np.uint64)
                    for column in values.reshape(BANDS, ROWS).T:
                        keys = (keys ^ column) * _ODD[1]
                        keys ^= keys >> np.uint64(31)
                    bands.append(keys.astype(np.int64) if len(s) else np.zeros(0, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "h", "g", "n", "digest", "sig", "bands"],
                )

        return each

    return map_arrow(df.select("doc_id", "text", "h", "g"), make, "doc_id long, h long, g long, n int, digest binary, sig binary, bands array<long>")


def _blocked(rows: DataFrame, key: str, block: int, set_bytes: int | None = None) -> DataFrame:
    """rows with (bi, bj, side): once for each pair of blocks of its group that its block is in. Groups up to block members (and set_bytes of sets) have one."""
    blocks = F.ceil(F.count(F.lit(1)) / block)
    if set_bytes is not None:
        blocks = F.greatest(blocks, F.ceil(F.sum(F.col("n").cast("long")) * 8 / set_bytes))
    sizes = rows.groupBy(key).agg(blocks.cast("int").alias("blocks")).where("blocks > 1")
    numbered = rows.join(sizes, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int"))
    each = numbered.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.withColumn("bi", F.least("mine", "other")).withColumn("bj", F.greatest("mine", "other")).withColumn("side", (F.col("mine") == F.col("bj")).cast("int")).drop("blocks", "mine", "other")


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list]:
    """Rows of one (key, bi, bj) at a time, from batches sorted by these; columns as arrays or lists."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "bi", "bj")])
        if not len(keys):
            continue
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if held and (keys[i] != last).any():
                yield held
                held = []
            held.append(batch.slice(i, j - i))
            last = keys[i]
    if held:
        yield held


def _sides(held: list[pa.RecordBatch]) -> tuple:
    table = pa.Table.from_batches(held)
    rep, n, side = (table[c].to_numpy() for c in ("rep", "n", "side"))
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), dtype=np.uint16).reshape(-1, VALUES)
    within = table["bi"][0].as_py() == table["bj"][0].as_py()
    return table, rep, n.astype(np.int64), side, sig, within


def _found_pairs(rep, n, side, sig, within) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of surviving pairs of a group."""
    left = np.arange(len(rep)) if within else np.flatnonzero(side == 0)
    right = None if within else np.flatnonzero(side == 1)
    for i, j in pairs(sig[left], None if within else sig[right], n[left], n[left] if within else n[right]):
        yield left[i], (left if within else right)[j]


def _pruned_edges(rows: DataFrame) -> DataFrame:
    """(a, b): the components of surviving pairs in each band bucket, as edges to their least member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []

        def flush() -> pa.RecordBatch:
            seen = sorted(set(zip(a, b)))
            a.clear()
            b.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in seen], pa.int64()), pa.array([y for _, y in seen], pa.int64())], names=["a", "b"])

        for held in _groups(batches, []):
            if sum(x.num_rows for x in held) < 2:
                continue
            _, rep, n, side, sig, within = _sides(held)
            forest = Forest()
            for i, j in _found_pairs(rep, n, side, sig, within):
                for x, y in zip(rep[i].tolist(), rep[j].tolist()):
                    if forest.root(x) != forest.root(y):
                        forest.join(x, y)
            for x, y in forest.edges():
                a.append(x)
                b.append(y)
            if len(a) > 200_000:
                yield flush()
        yield flush()

    return rows.mapInArrow(run, "a long, b long")


def common(sets: list[np.ndarray], i: int, j: np.ndarray) -> np.ndarray:
    """How many values the sorted set i shares with each of the sets j (none is empty)."""
    mine = sets[i]
    theirs = np.concatenate([sets[k] for k in j])
    ends = np.cumsum([len(sets[k]) for k in j])
    hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
    return np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], ends[:-1])))


def _links(rows: DataFrame) -> DataFrame:
    """(a, b, n): b null: a has n links in this pair of blocks; else an edge of a component of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches, []):
            table, rep, n, side, sig, within = _sides(held)
            if len(rep) < 2:
                continue
            sets = [np.frombuffer(x, dtype=np.uint64) for x in table["sets"].to_pylist()]
            count = np.zeros(len(rep), dtype=np.int64)
            forest = Forest()
            for i, j in _found_pairs(rep, n, side, sig, within):
                for x, some in by_bucket(i):
                    # Some megabytes of sets at a time.
                    for others in np.array_split(j[some], max(1, int(n[j[some]].sum()) >> 20)):
                        if not len(others):
                            continue
                        both = common(sets, x, others)
                        linked = others[both >= THRESHOLD * (n[x] + n[others] - both) - 1e-9]
                        count[x] += len(linked)
                        np.add.at(count, linked, 1)
                        for y in linked.tolist():
                            forest.join(int(rep[x]), int(rep[y]))
            some = np.flatnonzero(count)
            edges = forest.edges()
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[some].tolist() + [x for x, _ in edges], pa.int64()), pa.array([None] * len(some) + [y for _, y in edges], pa.int64()), pa.array(count[some].tolist() + [None] * len(edges), pa.int64())],
                names=["a", "b", "n"],
            )

    return rows.mapInArrow(run, "a long, b long, n long")


def _with_sets(df: DataFrame) -> DataFrame:
    """(rep, key, n, sig, sets) from (rep, key, n, sig, text)."""

    def make():
        def each(batch: pa.RecordBatch):
            for part, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(4)], pa.array([shingles(t).tobytes() for t in texts], pa.binary())], names=["rep", "key", "n", "sig", "sets"])

        return each

    return map_arrow(df.select("rep", "key", "n", "sig", "text"), make, "rep long, key long, n int, sig binary, sets binary")


def _matched(wide: DataFrame, narrow: DataFrame, on: str, how: str, most_bytes: int) -> DataFrame:
    """wide joined to narrow, which is stored: rows of wide that have no partner don't shuffle, but for what a filter of bounded size lets through."""
    marked = flag_members(wide, narrow.select(on), on, most_bytes)
    some = marked.where("possible").drop("possible").join(narrow.hint("shuffle_merge"), on, how)
    if how == "inner":
        return some
    rest = marked.where("not possible").drop("possible")
    if how == "left":
        for field in narrow.schema.fields:
            if field.name != on:
                rest = rest.withColumn(field.name, F.lit(None).cast(field.dataType))
    return rest.select(*[F.col(f"`{c}`") for c in some.columns]).unionByName(some)


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, most_bytes: int = FILTER_BYTES, set_bytes: int = SET_BYTES) -> DataFrame:
    """doc_id, class_id (of the component of links), copy_id (of the class of equal sets), n_copies, n_links (to other classes), kept (one of each component) of each row."""
    parts = shards(df.sparkSession)
    docs = texts_of(df, id_col, text_col).withColumns({"h": F.xxhash64("doc_id", "text", F.lit(1)), "g": F.xxhash64("doc_id", "text", F.lit(2))})
    made = signatures(docs)
    # Classes: exact dedup of the sets' digests. Their rows carry what the join needs, and a number that is stored with them.
    extras = {c: F.col(c) for c in ("h", "g", "n", "sig", "bands")}
    members = exact_dedup(made.withColumn("digest", F.hex("digest")), "doc_id", "digest", False, extras=extras, most_bytes=most_bytes)
    members = stash(members.withColumns({"rep": F.monotonically_increasing_id(), "sha": F.unhex("text_sha256")}).drop("text_sha256"), "members")
    reps = members.where("kept and n > 0")
    keys = reps.select(F.explode("bands").alias("key"))
    rows = reps.select("rep", "n", "sig", F.explode("bands").alias("key"))
    shared = flag_members(rows, repeats(keys, "key", most_bytes), "key", most_bytes).where("possible").drop("possible")
    shared = _blocked(shared, "key", block).repartition(parts, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    clumps = stash(components(_pruned_edges(shared)).select(F.col("node").alias("rep"), F.col("root").alias("key")), "components")
    # Sets are needed of classes in clumps alone.
    chosen = stash(_matched(reps.select("rep", "h", "g", "n", "sig"), clumps, "rep", "inner", most_bytes), "clumps")
    texts = flag_members(docs, chosen.select("h"), "h", most_bytes).where("possible").groupBy("h", "g").agg(F.first("text").alias("text"))
    sets = stash(_with_sets(texts.join(chosen.hint("shuffle_merge"), ["h", "g"])), "sets")
    whole = _blocked(sets, "key", block, set_bytes).repartition(parts, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    links = stash(_links(whole), "links")
    counts = links.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    roots = pin(components(links.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "root"))
    # The class id is the least id in each component.
    placed = pin(_matched(reps.select("rep", "sha", F.col("doc_id").alias("least")), roots, "rep", "inner", most_bytes).join(counts, "rep", "left"))
    named = placed.groupBy("root").agg(F.min("least").alias("class_id"))
    info = pin(placed.join(named, "root").select("sha", "class_id", "n_links"))
    out = _matched(members.select("doc_id", "keep_id", "group_size", "kept", "sha"), info, "sha", "left", most_bytes)
    class_id = F.coalesce("class_id", "keep_id")
    return out.select(
        "doc_id", class_id.alias("class_id"), F.col("keep_id").alias("copy_id"), F.col("group_size").alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (F.col("kept") & F.col("doc_id").eqNullSafe(class_id)).alias("kept"),
    )


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = FILTER_BYTES) -> DataFrame:
    """The rows of df, all columns, one of each component of links. Rows of one id stay if one of them stays; rows without an id stay."""
    found = jaccard_join(df, id_col, text_col, most_bytes=most_bytes)
    gone = pin(found.groupBy("doc_id").agg(F.bool_or("kept").alias("stays")).where("doc_id is not null and not stays").select(F.col("doc_id").alias("_cairn_id")))
    return _matched(df.withColumn("_cairn_id", F.col(id_col).cast("long")), gone, "_cairn_id", "left_anti", most_bytes).select(*[F.col(f"`{c}`") for c in df.columns])


#: All pairs, and components by the least id that is reached. For small tables.
SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
c AS (SELECT s, min(doc_id) AS copy_id, count(*) AS n_copies, len(s) AS n FROM s GROUP BY s),
e AS (SELECT copy_id, n, unnest(s) AS g FROM c),
p AS (SELECT a.copy_id AS a, b.copy_id AS b FROM e a JOIN e b ON a.g = b.g AND a.copy_id <> b.copy_id AND a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9 GROUP BY a.copy_id, b.copy_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
reach AS (SELECT copy_id AS a, copy_id AS b FROM c UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
least AS (SELECT a AS copy_id, min(b) AS class_id FROM reach GROUP BY a),
links AS (SELECT a AS copy_id, count(*) AS n_links FROM p GROUP BY a)
SELECT s.doc_id, class_id, c.copy_id, n_copies, coalesce(n_links, 0) AS n_links, s.doc_id = class_id AS kept
FROM s JOIN c USING (s) JOIN least USING (copy_id) LEFT JOIN links USING (copy_id)
"""
