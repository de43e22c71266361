"""LM scoring by context-tree weighting over bytes.

Each byte is coded as eight binary decisions; a decision's context is the path to it within the byte and the last d
bytes, for every depth d from 0 to DEPTH. Each (context, path) node holds counts of zeros and ones and predicts by the
Krichevsky-Trofimov rule. A node's weighted block probability is half its own KT probability plus half the product of
its children's, so the prediction of the next bit mixes all depths by how well each has coded the training text. KT
block probabilities depend on counts alone, so training is one distributed count of (DEPTH + 1)-grams, and then sums
from the leaves to the root; no pass over the text in order is needed.

1. Texts are packed in blocks (stored once, so that nothing depends on how an input is partitioned when it is read
   again). GROUP blocks of a task merge their distinct grams, with their counts in training texts, and send each bucket
   its part. A bucket has whole subtrees: all contexts that share their TOP most recent bytes.
2. Grams are merged by (bucket, salt), then by bucket, where levels DEPTH to TOP are summed. A bucket has as many salts as
   its grams ask for, so a hot one is split. What its parents need, the sums at depth TOP - 1, goes to the driver: at most
   65,536 * 255 rows, whatever the input.
3. The driver finishes the levels above and broadcasts them, with how they enter the mixture of deeper nodes.
4. Buckets, again by salts, answer each group's grams with their log10 probabilities, in one pass.
5. Blocks meet the answers of their group, and sum them by text.

The base is an add-one unigram of words. A group's distinct words go to the buckets beside its grams, and come back with
their counts in the same order.

Defined cases: a null text is empty; an empty text has the end token and the end symbol; a null doc_id is not held
out; without training texts every bit has probability 1/2; an empty table gives no rows; equal texts, equal scores.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.blocks import blocks, by_bucket, firsts, freeze, keyed, merge_counts, pack, pack_sorted, record, spread, thaw, trim, unpack, unpack_sorted
from cairn.llm.common import shards, stash, texts_of

#: Bytes of context. Five is the most that fits beside a row number in 64 bits.
DEPTH = 5
#: Bytes of text in a block, and blocks that merge their grams and words.
BLOCK, GROUP = 1 << 20, 16
#: Grams that one task takes of a bucket, about; a bucket with more has salts. Grams in one stored row.
SALT_GRAMS, ROW_GRAMS = 1 << 24, 1 << 20
#: Buckets at most: a row of a group's grams should stay worth sending.
MOST_BUCKETS = 1024
#: No byte of UTF-8: the end symbol, and what stands before a text.
END = 255
LOG10_2 = float(np.log10(2))
#: Depth of the nodes that root a bucket's subtrees.
TOP = 3


def stream(texts: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """Sorted (gram << 16 | text) of all bytes and end symbols of these lower-cased texts. A gram is its context, recent byte first, then the byte itself."""
    pad = bytes([END]) * depth
    data = np.frombuffer(pad + (bytes([END]) + pad).join(texts) + bytes([END]) + bytes(8), dtype=np.uint8)
    text = np.repeat(np.arange(len(texts), dtype=np.uint64), np.array([len(t) + 1 for t in texts], dtype=np.int64))
    at = np.arange(len(text), dtype=np.int64) + text.astype(np.int64) * depth
    eight = np.lib.stride_tricks.as_strided(data, (len(data) - 8, 8), (1, 1))[at].view("<u8").ravel()
    context = eight & np.uint64((1 << 8 * depth) - 1)
    keys = (context << np.uint64(8) | eight >> np.uint64(8 * depth) & np.uint64(255)) << np.uint64(16) | text
    keys.sort()
    return keys


_TABLE = 1 << 14
_HALF = np.concatenate(([0.0], np.cumsum(np.log(np.arange(_TABLE) + 0.5))))
_WHOLE = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, _TABLE + 1)))))


def _log_rising(n: np.ndarray, start: float, table: np.ndarray) -> np.ndarray:
    """log of start (start + 1) ... (start + n - 1)."""
    out = table[np.minimum(n, _TABLE).astype(np.int64)]
    big = n > _TABLE
    if big.any():
        stirling = lambda x: (x - 0.5) * np.log(x) - x + 1 / (12 * x) - 1 / (360 * x**3)
        out[big] = table[_TABLE] + stirling(n[big] + start) - stirling(np.float64(_TABLE) + start)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the KT probability of any sequence with these counts."""
    return _log_rising(zeros, 0.5, _HALF) + _log_rising(ones, 0.5, _HALF) - _log_rising(zeros + ones, 1.0, _WHOLE)


def _parents(key: np.ndarray) -> np.ndarray:
    return key >> np.uint64(16) << np.uint64(8) | key & np.uint64(255)


class Level:
    """Nodes of one depth: key (context << 8 | path), counts, log weighted probability, weight of the node's own KT."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> None:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
        total = lambda x: np.add.reduceat(x[order], first) if len(key) else x
        self.key, self.zeros, self.ones = key[first], total(zeros), total(ones)
        own = log_kt(self.zeros, self.ones)
        self.kt = (self.ones + 0.5) / (self.zeros + self.ones + 1)
        if below is None:
            self.log_weighted, self.stay = own, np.ones(len(first))
        else:
            children = total(below)
            self.log_weighted = np.log(0.5) + np.logaddexp(own, children)
            self.stay = 1 / (1 + np.exp(np.clip(children - own, -700, 700)))

    def parents(self) -> np.ndarray:
        """Key of each node's parent: one byte of context less."""
        return _parents(self.key)

    def above(self) -> "Level":
        """The level with one byte of context less."""
        return Level(self.parents(), self.zeros, self.ones, self.log_weighted)


def leaves(grams: np.ndarray, counts: np.ndarray) -> Level:
    """The deepest level from gram counts."""
    byte, context = grams & np.uint64(255), grams >> np.uint64(8) << np.uint64(8)
    key, zeros, ones = [], [], []
    for t in range(8):
        key.append(context | np.uint64(1 << t) | byte >> np.uint64(8 - t))
        bit = (byte >> np.uint64(7 - t) & np.uint64(1)).astype(bool)
        zeros.append(np.where(bit, 0, counts).astype(np.float64))
        ones.append(np.where(bit, counts, 0).astype(np.float64))
    return Level(np.concatenate(key), np.concatenate(zeros), np.concatenate(ones), None)


def collapse(levels: list[Level], base: np.ndarray | None = None, factor: np.ndarray | None = None, deepest: bool = True) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level from the top: (where the level is the deepest known, the probability of a one; base; factor).

    A node's prediction p counts as base + factor * p; base and factor of the first level are given (0 and 1 for the root).
    deepest: the last level has no children; else those of its nodes that are not known predict 1/2.
    """
    out = []
    if base is None or factor is None:
        base, factor = np.zeros(len(levels[0].key)), np.ones(len(levels[0].key))
    for i, level in enumerate(levels):
        if i:
            up = np.searchsorted(levels[i - 1].key, level.parents())
            base, factor = (x[up] for x in entering(levels[i - 1], base, factor))
        own = level.kt if deepest and i == len(levels) - 1 else level.stay * level.kt + (1 - level.stay) * 0.5
        out.append((base + factor * own, base, factor))
    return out


def entering(level: Level, base: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base and factor of the children of this level's nodes."""
    return base + factor * level.stay * level.kt, factor * (1 - level.stay)


Table = tuple[np.ndarray, np.ndarray]


def subtree(grams: np.ndarray, counts: np.ndarray, depth: int) -> list[Level]:
    """Levels TOP to depth of these grams."""
    levels = [leaves(grams, counts)]
    for _ in range(depth - TOP):
        levels.append(levels[-1].above())
    return levels[::-1]


class Shallow:
    """The levels above TOP: their nodes' probabilities, and how the last of them enters depth TOP."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> None:
        levels = [Level(key, zeros, ones, below)]
        for _ in range(TOP - 1):
            levels.append(levels[-1].above())
        levels.reverse()
        collapsed = collapse(levels, deepest=False)
        self.tables: list[Table] = [(level.key, p) for level, (p, _, _) in zip(levels, collapsed)]
        self.parents = levels[-1].key
        self.base, self.factor = entering(levels[-1], *collapsed[-1][1:])


class Model:
    """Nodes of a bucket's subtrees with those above them, and the scores of its training grams."""

    def __init__(self, shallow: Shallow, grams: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> None:
        self.depth, self.tables = depth, list(shallow.tables)
        if len(grams):
            levels = subtree(grams, counts, depth)
            up = np.searchsorted(shallow.parents, levels[0].parents())
            self.tables += [(level.key, p) for level, (p, _, _) in zip(levels, collapse(levels, shallow.base[up], shallow.factor[up]))]
        nothing = (np.zeros(0, dtype=np.uint64), np.zeros(0))
        self.tables += [nothing] * (depth + 1 - len(self.tables))
        self.grams, self.scores = grams, self.log10(grams)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte after its context."""
        total = np.zeros(len(grams))
        byte, context = grams & np.uint64(255), grams >> np.uint64(8)
        for t in range(8):
            path = np.uint64(1 << t) | byte >> np.uint64(8 - t)
            p = np.full(len(grams), 0.5)
            open_ = np.arange(len(grams))
            for d in range(self.depth, -1, -1):
                keys, values = self.tables[d]
                if len(keys) and len(open_):
                    key = context[open_] >> np.uint64(8 * (self.depth - d)) << np.uint64(8) | path[open_]
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    hit = keys[at] == key
                    p[open_[hit]] = values[at[hit]]
                    open_ = open_[~hit]
            p = np.clip(p, 1e-7, 1 - 1e-7)
            total += np.log10(np.where(byte >> np.uint64(7 - t) & np.uint64(1), p, 1 - p))
        return total

    def score(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram: those of training are known."""
        if not len(self.grams):
            return self.log10(grams)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        out = self.scores[at]
        new = np.flatnonzero(self.grams[at] != grams)
        out[new] = self.log10(grams[new])
        return out


def _lower(texts: list[str | None]) -> list[bytes]:
    return [t.encode().lower() for t in texts]  # bytes.lower() is for A-Z alone


def _pack_words(words: list[bytes], counts) -> bytes:
    """Words (none has a line's end) and their counts."""
    return pack(np.frombuffer(b"\n".join(words), dtype=np.uint8), np.asarray(counts, dtype=np.int64))


def _unpack_words(data: bytes) -> tuple[list[bytes], list[int]]:
    text, counts = unpack(data)
    return (text.tobytes().split(b"\n") if len(counts) else []), counts.tolist()


#: Rows of the first pass. kind 0: a block (data) of group grp; 1: a group's grams (data) and words for a bucket (at), n grams and words of them.
GATHERED = "kind int, grp long, at int, n long, data binary, words binary"


def gather(docs: DataFrame, buckets: int, depth: int = DEPTH, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """GATHERED of (doc_id, text, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, many = TaskContext.get().partitionId(), 0, 0
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        words: Counter = Counter()  # in training texts
        others: set[bytes] = set()  # in other texts

        def flush():
            key, n = merge_counts(keys, counts)
            grams = dict(by_bucket(_bucket(key, buckets, depth)))
            lists: dict[int, list[bytes]] = {}
            for w in itertools.chain(words, others.difference(words)):
                lists.setdefault(zlib.crc32(w) % buckets, []).append(w)
            none = np.zeros(0, dtype=np.int64)
            out = []
            for bucket in sorted(grams.keys() | lists.keys()):
                some, mine = grams.get(bucket, none), lists.pop(bucket, [])
                out.append((bucket, len(some) + len(mine), pack_sorted(key[some], n[some].astype(np.uint32)), _pack_words(mine, [words[w] for w in mine])))
            for x in (keys, counts, words, others):
                x.clear()
            for i in range(0, len(out), 64):
                at, n, data, packed = zip(*out[i : i + 64])
                yield record(GATHERED, [1] * len(at), [task << 24 | done] * len(at), at, n, data, packed)

        for batch in blocks(batches, block):
            yield record(GATHERED, [0], [task << 24 | done], [many], [batch.num_rows], [freeze(batch)], [None])
            lower = _lower(batch.column(1).to_pylist())
            train = ~batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for t, learn in zip(lower, train.tolist()):
                words.update(t.split()) if learn else others.update(t.split())
            every = stream(lower, depth)
            grams = every >> np.uint64(16)
            first = firsts(grams)
            keys.append(grams[first])
            counts.append(np.add.reduceat(train[(every & np.uint64(0xFFFF)).astype(np.int64)].astype(np.int64), first))
            # The end is a token too, which no word can be.
            words[b""] += int(train.sum())
            many += 1
            if many == group:
                yield from flush()
                done, many = done + 1, 0
                trim()
        if many:
            yield from flush()

    return docs.mapInArrow(run, GATHERED)


def _bucket(grams: np.ndarray, buckets: int, depth: int) -> np.ndarray:
    """The bucket of sorted grams, by the TOP most recent bytes of their contexts."""
    recent = grams >> np.uint64(8 * (depth + 1 - TOP))
    first = firsts(recent)
    return np.repeat(spread(recent[first], buckets), np.diff(np.append(first, len(grams))))


def _merge(packed: Iterator[bytes], learnt: bool = False, hold: int = 1 << 21) -> Table:
    """Sums of packed grams, merged as they come. learnt: those without a count go."""
    keys, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for data in packed:
        key, n = unpack_sorted(data)
        if learnt:
            key, n = key[n > 0], n[n > 0]
        keys.append(key)
        counts.append(n.astype(np.int64))
        if sum(map(len, keys)) > max(hold, 2 * len(keys[0])):
            key, n = merge_counts(keys, counts)
            keys, counts = [key], [n]
    return merge_counts(keys, counts)


def _merge_words(packed: Iterator[bytes]) -> Counter:
    """Sums of packed words; those without a count go."""
    out: Counter = Counter()
    for data in packed:
        for w, n in zip(*_unpack_words(data)):
            if n:
                out[w] += n
    return out


MERGED = "bucket int, data binary, words binary"
#: kind 0: a bucket's training grams (data) and words; 1: a node of depth TOP - 1 (key) with its counts and the log of its children's product, as far as the bucket has it; 2: ones words, zeros of them distinct.
SUMMED = "kind int, bucket int, data binary, words binary, key long, zeros double, ones double, below double"


def _packed_rows(key: np.ndarray, n: np.ndarray, words: Counter) -> Iterator[tuple[bytes | None, bytes | None]]:
    """Grams and words, some in a row."""
    for i in range(0, len(key), ROW_GRAMS):
        yield pack_sorted(key[i : i + ROW_GRAMS], n[i : i + ROW_GRAMS]), None
    every = iter(words.items())
    while some := list(itertools.islice(every, ROW_GRAMS)):
        yield None, _pack_words(*zip(*some))


def _merge_both(rows: Iterator[list], learnt: bool = False) -> tuple[np.ndarray, np.ndarray, Counter]:
    """Merged grams and words of rows (data, words)."""
    packed: list[bytes] = []

    def grams():
        for data, words in rows:
            if words is not None:
                packed.append(words)
            if data is not None:
                yield data

    key, n = _merge(grams(), learnt)
    return key, n, _merge_words(iter(packed))


def _merge_salts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MERGED of (bucket, salt, data, words) in this order."""
    for (bucket, _), rows in keyed(batches, 2):
        for data, words in _packed_rows(*_merge_both(rows, learnt=True)):
            yield record(MERGED, [bucket], [data], [words])


def _sum_buckets(depth: int):
    """SUMMED of (bucket, data, words) in this order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in keyed(batches, 1):
            key, n, counts = _merge_both(rows)
            for data, words in _packed_rows(key, n, counts):
                yield record(SUMMED, [0], [bucket], [data], [words], [None], [None], [None], [None])
            yield record(SUMMED, [2], [bucket], [None], [None], [None], [len(counts)], [sum(counts.values())], [None])
            del counts
            if not len(key):
                continue
            level = subtree(key, n, depth)[0]
            up = level.parents()
            order = np.argsort(up, kind="stable")
            first = firsts(up[order])
            sums = [np.add.reduceat(x[order], first) for x in (level.zeros, level.ones, level.log_weighted)]
            for i in range(0, len(first), 100_000):
                part = slice(i, i + 100_000)
                m = len(first[part])
                yield record(SUMMED, [1] * m, [bucket] * m, [None] * m, [None] * m, up[order][first][part].astype(np.int64), *(x[part] for x in sums))

    return run


ANSWERS = "grp long, at int, data binary, words binary"


def _answer(broadcast, depth: int):
    """ANSWERS of (bucket, salt, kind, grp, data, words) in this order: kind 0 are the bucket's training grams and words, 1 a group's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shallow = broadcast.value
        out: list[tuple] = []
        for _, rows in keyed(batches, 2):
            learnt: list[tuple] = []
            model = None
            for kind, grp, data, words in rows:
                if kind == 0:
                    learnt.append((data, words))
                    continue
                if model is None:
                    grams, n, counts = _merge_both(iter(learnt))
                    model = Model(shallow, grams, n, depth)
                    learnt.clear()
                grams = unpack_sorted(data)[0]
                asked = _unpack_words(words)[0]
                out.append((grp, -1, pack_sorted(grams, model.score(grams).astype(np.float32)), _pack_words(asked, list(map(counts.__getitem__, asked)))))
                if len(out) >= 64:
                    yield record(ANSWERS, *zip(*out))
                    out.clear()
        if out:
            yield record(ANSWERS, *zip(*out))

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, value double, n_bytes long"


def _sum_texts(depth: int):
    """SCORED of (grp, at, data, words) in this order: a group's answers at -1, then its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in keyed(batches, 1):
            grams, scores = [], []
            logs: dict[bytes, float] = {}
            table = None
            for at, data, words in rows:
                if at < 0:
                    key, value = unpack_sorted(data)
                    grams.append(key)
                    scores.append(value)
                    found, counts = _unpack_words(words)
                    logs.update(zip(found, np.log10(np.array(counts) + 1.0).tolist()))
                    continue
                if table is None:
                    key = np.concatenate(grams)
                    order = np.argsort(key, kind="stable")
                    table = key[order], np.concatenate(scores)[order].astype(np.float64)
                    grams.clear()
                    scores.clear()
                batch = thaw(data)
                lower = _lower(batch.column(1).to_pylist())
                every = stream(lower, depth)
                key = every >> np.uint64(16)
                first = firsts(key)
                value = table[1][np.searchsorted(table[0], key[first])]
                value = np.bincount((every & np.uint64(0xFFFF)).astype(np.int64), np.repeat(value, np.diff(np.append(first, len(key)))), len(lower))
                sums, known, sizes = [], [], []
                for t in lower:
                    found = [*map(logs.__getitem__, t.split()), logs[b""]]
                    sizes.append(len(found))
                    sums.append(sum(found))
                    known.append(len(found) - found.count(0.0))
                yield record(SCORED, batch.column(0), batch.column(2), sizes, known, sums, value, [len(t) for t in lower])

    return run


def score(df: DataFrame, held_out, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, group: int = GROUP, salt_grams: int = SALT_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of each row.

    held_out: a boolean Column over doc_id; those rows are not learnt from.
    """
    spark = df.sparkSession
    parts = shards(spark)
    buckets = min(MOST_BUCKETS, 2 * parts)
    docs = texts_of(df, id_col, text_col).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    gathered = stash(gather(docs, buckets, depth, block, group), "gathered", "none")
    sent = gathered.where("kind = 1").select(F.col("at").alias("bucket"), "grp", "n", "data", "words")
    # At most MOST_BUCKETS rows: the salts of each bucket, and the salts before it, so that tasks get equal numbers of them.
    salts, before = [], 0
    for r in sent.groupBy("bucket").agg(F.sum("n").alias("n")).orderBy("bucket").collect():
        many = -(-r["n"] // salt_grams)
        salts.append((r["bucket"], many, before))
        before += many
    salted = F.broadcast(spark.createDataFrame(salts or [(0, 1, 0)], "bucket int, salts int, before int"))
    task = (F.col("before") + F.col("salt")) % parts
    asked = sent.join(salted, "bucket").withColumn("salt", F.pmod(F.xxhash64("grp"), "salts").cast("int"))
    merged = asked.repartitionById(parts, task).select("bucket", "salt", "data", "words").sortWithinPartitions("bucket", "salt").mapInArrow(_merge_salts, MERGED)
    summed = stash(merged.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket").mapInArrow(_sum_buckets(depth), SUMMED), "summed", "none")
    top = summed.where("kind = 1").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toArrow()
    shallow = spark.sparkContext.broadcast(Shallow(top["key"].to_numpy().astype(np.uint64), *(top[c].to_numpy() for c in ("zeros", "ones", "below"))))
    del top
    totals = summed.where("kind = 2").agg(F.sum("zeros").alias("v"), F.sum("ones").alias("n")).first()
    n, v = int(totals["n"] or 0), int(totals["v"] or 0)
    learnt = summed.where("kind = 0").join(salted, "bucket").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    columns = ["bucket", "salt", "kind", "grp", "data", "words"]
    asks = learnt.withColumn("grp", F.lit(None).cast("long")).select("before", *columns).unionByName(asked.withColumn("kind", F.lit(1)).select("before", *columns))
    answers = asks.repartitionById(parts, task).select(*columns).sortWithinPartitions("bucket", "salt", "kind").mapInArrow(_answer(shallow, depth), ANSWERS)
    # A task of the first pass made groups 0, 1, ... of its own: numbered through, they fill the partitions evenly.
    most = gathered.where("kind = 0").agg(F.max(F.col("grp").bitwiseAND((1 << 24) - 1))).first()[0] or 0
    number = F.shiftright("grp", 24) * (most + 1) + F.col("grp").bitwiseAND((1 << 24) - 1)
    groups = answers.unionByName(gathered.where("kind = 0").select("grp", "at", "data", "words"))
    rows = groups.repartitionById(parts, (number % parts).cast("int")).sortWithinPartitions("grp", "at").mapInArrow(_sum_texts(depth), SCORED)
    rows = stash(rows, "scored")
    base = F.col("logs") - F.col("n_tokens") * float(np.log10(n + v + 1))
    return rows.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.round(base, 7).alias("base_score"),
        F.round("value", 7).alias("score"), "n_bytes", (-F.round("value", 7) / LOG10_2 / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
