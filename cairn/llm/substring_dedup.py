"""Suffix-array dedup: bytes covered by a LENGTH-byte string that a document with a smaller id has too are removed.

Suffixes are sorted by bucket-pointer refinement (bucket_classes): buckets of equal first Q bytes are refined by sorting
their suffixes on the bucket pointers at later offsets, and every round uses the pointers that the rounds before have
refined, so the known depth doubles. Refinement stops at LENGTH bytes, where a bucket is a class of equal strings.

Sorting all suffixes of the corpus would move many times its size. Only what may repeat is sorted:

1. Initial buckets are anchors: each LENGTH-byte string has one, the least hash of its SEED-byte parts, and equal strings
   have equal anchors. Successive strings of one anchor form a run. Texts are packed in blocks; GROUP blocks of a task
   send the distinct anchors they have (48 bits each) and get back those that another run has: a bucket of one run is
   sorted already.
2. Runs of the other anchors move as digests of their bytes (128 bits of BLAKE2b). Copies of one run collapse to the one in
   the smallest document, and the others are settled: all their strings repeat. Copies within a group are told by their
   bytes and collapse there, so a passage that many documents share sends a row a group.
3. Where a bucket still has different runs of different documents, their text moves, and bucket-pointer refinement finds
   which strings repeat. An anchor with more than SPREAD runs is hot: its runs are dealt by the hash of all their bytes
   (equal ones still meet), and what is left of them sends each string to a bucket of its own.

So copies that move are told as equal documents are, by a cryptographic digest (SHA-256 there), and all other strings by
their bytes. The quick hashes of anchors and runs only deal out and sort: whatever collides among them costs time alone.

Defined cases: a null text is empty; texts shorter than LENGTH keep all; a null doc_id is larger than any; rows of one
doc_id don't remove from each other, and repeated rows have equal results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.blocks import blocks, by_bucket, firsts, freeze, keyed, merge_counts, pack, pack_sorted, record, thaw, trim, unpack, unpack_sorted
from cairn.llm.common import shards, stash, texts_of
from cairn.llm.exact_dedup import FILTER_BYTES, drop_copies, exact_dedup

LENGTH, SEED, Q = 50, 16, 8
#: Bytes of text in a block, and blocks of a group (16 at most: a document's number has 4 bits for its block and 16 for its row).
BLOCK, GROUP = 1 << 20, 16
#: Bytes of runs whose suffixes are sorted at a time, about; the runs of one key stay together.
COMPARE = 1 << 20
#: Bytes of text for which there is a bucket.
BUCKET_BYTES = 8 << 20
#: An anchor with more runs than this is hot.
SPREAD = 4096

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, base, dtype=np.uint64)
            factors[0] = 1
            _powers[i] = np.cumprod(factors, dtype=np.uint64)
    return _powers[0], _powers[1]


def _octets(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number; zeros follow the end."""
    padded = np.concatenate([x, np.zeros(8, dtype=np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(x), 8), (1, 1)).copy().view("<u8").ravel()


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each window of width."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if span < width else h


def runs(texts: list[bytes], length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(document, at, count, anchor, hash) of all runs: count successive strings from at on have this anchor; hash is of all their bytes."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    x = np.frombuffer(b"".join(texts), dtype=np.uint8)
    nothing = np.zeros(0, dtype=np.int64)
    if len(x) < length:
        return nothing, nothing, nothing, nothing.astype(np.uint64), nothing.astype(np.uint64)
    h = _octets(x) * _C1
    h ^= h >> np.uint64(32)
    seeds = h * _C2
    seeds[: len(h) - (seed - 8)] ^= h[seed - 8 :]
    seeds ^= seeds >> np.uint64(29)
    seeds *= _C3
    anchor = _least(seeds[: len(x) - seed + 1], length - seed + 1)
    n = len(anchor)
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    inside = doc[:n] == doc[length - 1 : length - 1 + n]
    change = np.ones(n, dtype=bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:n] != doc[: n - 1]) | (inside[1:] != inside[:-1])
    edges = np.flatnonzero(change)
    ends = np.append(edges[1:], n)
    good = inside[edges]
    edges, ends = edges[good], ends[good]
    power, inverse = _power(len(x) + 1)
    prefix = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(h * power[: len(h)], dtype=np.uint64, out=prefix[1:])
    whole = (prefix[ends + length - 8] - prefix[edges]) * inverse[edges]
    whole ^= whole >> np.uint64(31)
    of = doc[edges].astype(np.int64)
    return of, edges - starts[of], ends - edges, anchor[edges], whole * _C2


def bucket_classes(data: np.ndarray, room: np.ndarray, starts: np.ndarray, depth: int = LENGTH, q: int = Q) -> np.ndarray:
    """Classes of equal depth-byte strings at starts, by bucket-pointer refinement: equal numbers, equal strings.

    room: bytes from each position to its string's end; each of starts has room for depth or more. A bucket pointer is
    the place of the bucket's first suffix in the order of all suffixes; a refined bucket's pointers stay within it.
    """
    known = min(q, depth)
    value = _octets(data)
    if known < 8:
        value &= np.uint64((1 << 8 * known) - 1)
    live = np.flatnonzero(room >= known)
    pointer = np.zeros(len(data), dtype=np.int64)
    key = value[live]
    while True:
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        head = np.flatnonzero(new)
        if known == min(q, depth):
            pointer[live] = head[np.cumsum(new) - 1]
        else:
            # The suffixes of a bucket lie together; each finer bucket starts as far behind the bucket's start as it does here.
            old = pointer[live]
            first = np.concatenate(([True], old[1:] != old[:-1]))
            begin = np.flatnonzero(first)[np.cumsum(first) - 1]
            pointer[live] = old + head[np.cumsum(new) - 1] - begin
        if known == depth:
            return pointer[starts]
        sizes = np.diff(np.append(head, len(live)))
        live = live[np.repeat(sizes > 1, sizes)]
        step = min(known, depth - known)
        live = live[room[live] >= known + step]
        known += step
        key = pointer[live].astype(np.uint64) << np.uint64(32) | pointer[live + step].astype(np.uint64)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t.encode() for t in batch.column("text").to_pylist()]


def _kinds(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Where, in this order, one of the columns changes."""
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for x in columns:
        y = x[order]
        new[1:] |= y[1:] != y[:-1]
    return new


#: kind 0: a block (data) of group grp at place at; 1: a group's anchors for a bucket (at), with how many runs each has.
GATHERED = "kind int, grp long, at int, data binary"
_HIGH = np.uint64(16)


def _gather(reps: DataFrame, buckets: int, length: int, block: int, group: int, spread: int) -> DataFrame:
    """GATHERED of documents (doc, text, ...). doc: the id, for the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, many = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def flush():
            doc, anchor, whole = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((whole, anchor))
            anchor >>= _HIGH
            first = np.flatnonzero(_kinds(order, anchor))
            if not len(first):
                return
            runs_ = np.add.reduceat(_kinds(order, anchor, whole).astype(np.int64), first)
            many_docs = np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first)
            # Runs of one document alone ask for nothing: they count as one.
            n = np.where(many_docs, np.maximum(runs_, 2), 1)
            key = anchor[order][first]
            bucket = (key * np.uint64(buckets) >> np.uint64(48)).astype(np.int64) if buckets < 1 << 16 else (key % np.uint64(buckets)).astype(np.int64)
            for b, some in by_bucket(bucket):
                yield record(GATHERED, [1], [task << 24 | done], [b], [pack_sorted(key[some], np.minimum(n[some], max(1, spread) + 1).astype(np.uint16))])

        for batch in blocks(batches, block):
            yield record(GATHERED, [0], [task << 24 | done], [many], [freeze(batch)])
            of, _, _, anchor, whole = runs(_texts(batch), length)
            held.append((batch.column("doc").to_numpy()[of], anchor, whole))
            many += 1
            if many == group:
                yield from flush()
                done, many = done + 1, 0
                trim()
        if many:
            yield from flush()

    return reps.mapInArrow(run, GATHERED)


#: What a group is told, at -1 in front of its blocks: kind 0: anchors that other runs have, and which are hot; 1: strings that repeat; 2: runs whose text must be compared.
TOLD = "kind int, grp long, at int, size long, data binary"


def _shared_anchors(spread: int):
    """TOLD of (bucket, grp, data) in this order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in keyed(batches, 1):
            held = list(rows)
            keys, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
            for _, data in held:
                key, n = unpack_sorted(data)
                keys.append(key)
                counts.append(n.astype(np.int64))
                if sum(map(len, keys)) > max(1 << 21, 2 * len(keys[0])):
                    key, n = merge_counts(keys, counts)
                    keys, counts = [key], [n]
            key, n = merge_counts(keys, counts)
            shared, hot = key[n > 1], n[n > 1] > spread
            if not len(shared):
                continue
            for grp, data in held:
                key = unpack_sorted(data)[0]
                at = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
                mine = shared[at] == key
                if mine.any():
                    yield record(TOLD, [0], [grp], [-1], [0], [pack_sorted(key[mine], hot[at[mine]].astype(np.uint8))])

    return run


#: Runs of a group for a bucket.
SENT = "bucket int, grp long, data binary"
_FOUND = ("<i8", "<u4", "<u4")
#: Bytes that are compared at a time.
_STEP = 1 << 20


def _told(grp: int, kind: int, uid: np.ndarray, at: np.ndarray, count: np.ndarray, key: np.ndarray, length: int) -> pa.RecordBatch:
    order = np.argsort(uid, kind="stable")
    data = pack(*(x[order].astype(t) for x, t in zip((uid, at, count, key), ("<i8", "<u4", "<u4", "<u4"))))
    return record(TOLD, [kind], [grp], [-1], [int(count.sum()) + (length - 1) * len(count)], [data])


def _uids(grp: int, at: int, rows: np.ndarray) -> np.ndarray:
    """A document's number, by its row."""
    return (grp << 20 | at << 16) + rows


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... size[i] numbers each, one behind the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _same_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size[i] bytes (some each) from a[i] and from b[i] are the same."""
    out = np.ones(len(a), dtype=bool)
    ends = np.cumsum(size)
    first = 0
    while first < len(a):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _STEP)))
        part = slice(first, last)
        differ = text[_places(a[part], size[part])] != text[_places(b[part], size[part])]
        out[part] = ~np.logical_or.reduceat(differ, np.cumsum(size[part]) - size[part])
        first = last
    return out


def _copies(text: np.ndarray, begin: np.ndarray, doc: np.ndarray, count: np.ndarray, anchor: np.ndarray, whole: np.ndarray, length: int) -> np.ndarray:
    """Which runs have the bytes of a run of a smaller document. Anchors and hashes sort, the bytes decide.

    Runs whose hashes agree are compared with the first of them; one that differs from it stays, as if it had another hash.
    """
    order = np.lexsort((doc, count, whole, anchor))
    new = _kinds(order, anchor, whole, count)
    first = order[new][np.cumsum(new) - 1]
    some = doc[order] > doc[first]
    mine, theirs = order[some], first[some]
    out = np.zeros(len(doc), dtype=bool)
    out[mine] = _same_bytes(text, begin[mine], begin[theirs], count[mine].astype(np.int64) + length - 1)
    return out


def _digests(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> bytes:
    """16 bytes of BLAKE2b of each of these pieces."""
    view = memoryview(text)
    return b"".join([hashlib.blake2b(view[i:j], digest_size=16).digest() for i, j in zip(begin.tolist(), (begin + size).tolist())])


def _send_runs(buckets: int, length: int):
    """SENT of (grp, at, kind, data) in this order: a group's shared anchors, then its blocks. What repeats within the group goes back to it, with a bucket below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp,), rows in keyed(batches, 1):
            told: list[list[np.ndarray]] = []
            held: list[tuple] = []
            flat: list[bytes] = []
            size = 0
            shared = hot = None
            for at, _, data in rows:
                if at < 0:
                    told.append(unpack_sorted(data))
                    continue
                if not told:
                    continue
                if shared is None:
                    key = np.concatenate([k for k, _ in told])
                    order = np.argsort(key, kind="stable")
                    shared, hot = key[order], np.concatenate([h for _, h in told])[order].astype(bool)
                batch = thaw(data)
                texts = _texts(batch)
                of, start, count, anchor, whole = runs(texts, length)
                place = np.minimum(np.searchsorted(shared, anchor >> _HIGH), len(shared) - 1)
                mine = np.flatnonzero(shared[place] == anchor >> _HIGH)
                of = of[mine]
                sizes = np.array([len(t) for t in texts], dtype=np.int64)
                begin = size + (np.cumsum(sizes) - sizes)[of] + start[mine]
                held.append((batch.column("doc").to_numpy()[of], _uids(grp, at, of), start[mine], count[mine], anchor[mine], whole[mine], hot[place[mine]], begin))
                flat.extend(texts)
                size += int(sizes.sum())
            if not held:
                continue
            doc, uid, start, count, anchor, whole, much, begin = (np.concatenate(c) for c in zip(*held))
            text = np.frombuffer(b"".join(flat), dtype=np.uint8)
            held.clear()
            flat.clear()
            if not len(doc):
                continue
            done = _copies(text, begin, doc, count, anchor, whole, length)
            if done.any():
                told_ = _told(grp, 1, uid[done], start[done], count[done], np.zeros(int(done.sum())), length)
                yield record(SENT, [-1], [grp], [told_.column("data")[0].as_py()])
            left = np.flatnonzero(~done)
            bucket = (np.where(much[left], anchor[left] ^ whole[left], anchor[left]) % np.uint64(buckets)).astype(np.int64)
            for b, some in by_bucket(bucket):
                i = left[some]
                i = i[np.argsort(uid[i], kind="stable")]
                high, low = np.ascontiguousarray(np.frombuffer(_digests(text, begin[i], count[i] + length - 1), dtype=np.uint64).reshape(-1, 2).T)
                columns = (doc[i].astype("<i8"), uid[i].astype("<i8"), start[i].astype("<u4"), count[i].astype("<u4"), (anchor[i] >> np.uint64(32)).astype("<u4"), high, low, much[i].astype(np.uint8))
                yield record(SENT, [b], [grp], [pack(*columns)])

    return run


def _settle(length: int):
    """TOLD of SENT in order of buckets: copies of runs, as their digests say, and (kind 2) those whose bytes must be compared with other runs of their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in keyed(batches, 1):
            held = []
            for grp, data in rows:
                if bucket < 0:
                    yield record(TOLD, [1], [grp], [-1], [0], [data])
                else:
                    held.append(unpack(data))
            if not held:
                continue
            doc, uid, at, count, anchor, high, low, hot = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((doc, count, low, high, anchor))
            doc, uid, at, count, anchor, high, low, hot = (x[order] for x in (doc, uid, at, count, anchor, high, low, hot))
            same = np.arange(len(doc))
            new_anchor, new = _kinds(same, anchor), _kinds(same, anchor, high, low, count)
            head = np.flatnonzero(new)
            least = doc[head]  # the smallest document with these bytes, for each kind of run
            group = np.cumsum(new_anchor)[head] - 1
            first, last = (f.reduceat(least, firsts(group)) for f in (np.minimum, np.maximum))
            each = np.cumsum(new) - 1
            settled = doc > least[each]
            # Without a smaller document under this anchor there is nothing to compare; a hot anchor's runs lie in other buckets too.
            unsure = ~settled & ((first != last)[group[each]] | hot.astype(bool))
            kind = np.where(settled, 1, np.where(unsure, 2, 0))
            key = np.where(hot.astype(bool), 0, anchor | np.uint32(1))
            for mine in np.unique(kind[kind > 0]).tolist():
                some = np.flatnonzero(kind == mine)
                for grp, part in by_bucket(uid[some] >> 20):
                    i = some[part]
                    yield _told(grp, mine, uid[i], at[i], count[i], key[i], length)

    return run


def _refined(text: np.ndarray, begin: np.ndarray, doc: np.ndarray, uid: np.ndarray, at: np.ndarray, count: np.ndarray, key: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """TOLD, kind 1, of runs whose strings can only equal such of the same key: runs of a key are sorted together, some keys at a time, so that the suffixes' arrays stay small."""
    order = np.lexsort((doc, key))
    head = firsts(key[order])
    # A key of one document has nothing to compare.
    ends = np.append(head[1:], len(order)) if len(head) else head
    many = doc[order[head]] != doc[order[ends - 1]] if len(head) else np.zeros(0, dtype=bool)
    order = order[np.repeat(many, ends - head)]
    sizes = count + length - 1
    new = firsts(key[order])
    done = np.concatenate(([0], np.cumsum(sizes[order])))
    first = 0
    while first < len(order):
        limit = int(np.searchsorted(done, done[first] + COMPARE, side="left"))
        last = int(new[j]) if (j := int(np.searchsorted(new, max(limit, first + 1), side="left"))) < len(new) else len(order)
        some = order[first:last]
        first = last
        part = text[_places(begin[some], sizes[some])]
        for string, offset, n in _smaller(part, doc[some], count[some], length):
            i = some[string]
            for grp, mine in by_bucket(uid[i] >> 20):
                k = i[mine]
                yield _told(grp, 1, uid[k], at[k] + offset[mine], n[mine], np.zeros(len(k)), length)


def _send_texts(buckets: int, length: int):
    """SENT of (grp, at, kind, data) in this order: a group's runs to compare, then its blocks. Strings of hot anchors that repeat within a block go back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp,), rows in keyed(batches, 1):
            told: list[list[np.ndarray]] = []
            for at, _, data in rows:
                if at < 0:
                    told.append(unpack(data))
                    continue
                if not told:
                    continue
                if len(told) > 1:
                    told = [[np.concatenate(c) for c in zip(*told)]]
                uid, start, count, key = told[0]
                mine = np.flatnonzero(uid >> 16 == grp << 4 | at)
                if not len(mine):
                    continue
                batch = thaw(data)
                texts, docs = batch.column("text"), batch.column("doc").to_numpy()
                strings: list[bytes] = []
                out: list[tuple] = []
                last, text = -1, b""
                seen: dict[bytes, tuple] = {}
                again: list[tuple] = []
                mine = mine[np.argsort(docs[uid[mine] & 0xFFFF], kind="stable")]
                for u, s, n, k in zip(*(x[mine].tolist() for x in (uid, start, count, key))):
                    row = u & 0xFFFF
                    if row != last:
                        last, text = row, texts[row].as_py().encode()
                    d = int(docs[row])
                    if k:
                        strings.append(text[s : s + n + length - 1])
                        out.append((d, u, s, n, k))
                        continue
                    for i in range(s, s + n):
                        string = text[i : i + length]
                        # Documents come in their order: one before this has the string, or this itself.
                        if seen.setdefault(string, (d,))[0] < d:
                            again.append((u, i))
                        else:
                            strings.append(string)
                            out.append((d, u, i, 1, int.from_bytes(hashlib.blake2b(string, digest_size=4).digest())))
                if again:
                    u, i = np.array(again, dtype=np.int64).T
                    yield record(SENT, [-1], [grp], [_told(grp, 1, u, i, np.ones(len(u), dtype=np.int64), np.zeros(len(u)), length).column("data")[0].as_py()])
                if not out:
                    continue
                doc, u, s, n, k = np.array(out, dtype=np.int64).T
                for b, some in by_bucket(k % buckets):
                    raw = np.frombuffer(b"".join([strings[i] for i in some]), dtype=np.uint8)
                    yield record(SENT, [b], [grp], [pack(doc[some], u[some], s[some].astype("<u4"), n[some].astype("<u4"), k[some].astype("<u4"), raw)])

    return run


def _smaller(text: np.ndarray, doc: np.ndarray, count: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(string, offset, n): n successive strings from this offset that a smaller document has. text: the runs one behind the other."""
    sizes = count + length - 1
    begin = np.cumsum(sizes) - sizes
    string = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count)
    room = np.repeat(begin + sizes, sizes) - np.arange(len(text))
    classes = bucket_classes(text, room, begin[string] + offset, length)
    order = np.argsort(classes, kind="stable")
    new = np.concatenate(([True], np.diff(classes[order]) != 0))
    least = np.empty(len(order), dtype=np.int64)
    least[order] = np.minimum.reduceat(doc[string][order], np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = least < doc[string]
    same = string[1:] == string[:-1]
    first = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1] & same)))
    last = np.flatnonzero(hit & ~np.concatenate((hit[1:] & same, [False])))
    if len(first):
        yield string[first], offset[first], last - first + 1


def _compare(length: int):
    """TOLD of SENT in order of buckets: the strings that a smaller document has, by bucket-pointer refinement."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in keyed(batches, 1):
            held = []
            for grp, data in rows:
                if bucket < 0:
                    yield record(TOLD, [1], [grp], [-1], [0], [data])
                else:
                    held.append(unpack(data))
            if held:
                doc, uid, at, count, key, text = (np.concatenate(c) for c in zip(*held))
                held.clear()
                count = count.astype(np.int64)
                sizes = count + length - 1
                yield from _refined(text, np.cumsum(sizes) - sizes, doc, uid, at, count, key, length)

    return run


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text_sha256 string, kept_text binary"


def _cut(length: int):
    """CUT of (grp, at, kind, data) in this order: a group's strings that repeat, then its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp,), rows in keyed(batches, 1):
            told: list[list[np.ndarray]] = [[np.zeros(0, dtype=t) for t in (*_FOUND, "<u4")]]
            for place, _, data in rows:
                if place < 0:
                    told.append(unpack(data))
                    continue
                if len(told) > 1:
                    told = [[np.concatenate(c) for c in zip(*told)]]
                uid, at, count, _ = told[0]
                batch = thaw(data)
                texts = _texts(batch)
                mine = np.flatnonzero(uid >> 16 == grp << 4 | place)
                row = uid[mine] & 0xFFFF
                # A byte between texts, so that no span reaches over.
                sizes = np.array([len(t) for t in texts], dtype=np.int64)
                starts = np.cumsum(sizes + 1) - sizes - 1
                begin = starts[row] + at[mine]
                change = np.zeros(int(sizes.sum()) + len(texts) + 1, dtype=np.int32)
                np.add.at(change, begin, 1)
                np.add.at(change, begin + count[mine] + (length - 1), -1)
                gone = np.cumsum(change)[:-1] > 0
                left = ~gone
                left[starts + sizes] = False
                flat = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
                kept, ends = flat[left].tobytes(), np.concatenate(([0], np.cumsum(left)))
                ends = ends[starts + sizes]
                parts = [kept[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]
                removed = sizes - np.diff(ends, prepend=0)
                edge = np.concatenate((gone[:1], gone[1:] & ~gone[:-1])).astype(np.int64)
                spans = np.add.reduceat(edge, starts)
                yield record(
                    CUT, batch.column("doc_id"), sizes, removed, spans, [hashlib.sha256(p).hexdigest() for p in parts], [hashlib.sha256(t).hexdigest() for t in texts], parts
                )

    return run


def cut_representatives(reps: DataFrame, n_bytes: int, length: int = LENGTH, block: int = BLOCK, group: int = GROUP, bucket_bytes: int = BUCKET_BYTES, spread: int = SPREAD) -> DataFrame:
    """CUT of documents (doc_id, doc, text) of different texts, which have n_bytes together."""
    spark = reps.sparkSession
    parts = shards(spark)
    gathered = stash(_gather(reps.select("doc_id", "doc", "text"), parts, length, block, group, spread), "gathered", "none")
    held = gathered.where("kind = 0").select("grp", "at", "kind", "data")
    # A task of the first pass made groups 0, 1, ... of its own: numbered through, they fill the partitions evenly.
    most = held.agg(F.max(F.col("grp").bitwiseAND((1 << 24) - 1))).first()[0] or 0
    number = F.shiftright("grp", 24) * (most + 1) + F.col("grp").bitwiseAND((1 << 24) - 1)

    def by_group(told: DataFrame) -> DataFrame:
        """What groups are told, in front of their blocks."""
        both = told.select("grp", "at", "kind", "data").unionByName(held)
        return both.repartitionById(parts, (number % parts).cast("int")).sortWithinPartitions("grp", "at")

    def by_buckets(sent: DataFrame, n: int) -> DataFrame:
        """Rows by bucket; those with a bucket below 0 stay about where they are."""
        task = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("grp"), F.lit(n)).cast("int")).otherwise(F.col("bucket"))
        return sent.repartitionById(n, task).sortWithinPartitions("bucket")

    anchors = gathered.where("kind = 1").select(F.col("at").alias("bucket"), "grp", "data")
    shared = by_buckets(anchors, parts).mapInArrow(_shared_anchors(spread), TOLD)
    # What is sent of runs is less than their texts.
    buckets = max(parts, -(-n_bytes // (4 * bucket_bytes)))
    found = stash(by_buckets(by_group(shared).mapInArrow(_send_runs(buckets, length), SENT), buckets).mapInArrow(_settle(length), TOLD), "runs", "none")
    unsure = found.where("kind = 2")
    size = unsure.agg(F.sum("size")).first()[0] or 0
    buckets = max(parts, -(-size // bucket_bytes))
    sent = by_group(unsure).mapInArrow(_send_texts(buckets, length), SENT)
    more = stash(by_buckets(sent, buckets).mapInArrow(_compare(length), TOLD), "strings", "none")
    cut = by_group(found.where("kind = 1").unionByName(more)).mapInArrow(_cut(length), CUT)
    return cut


def substring_dedup(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, most_bytes: int = FILTER_BYTES, **sizes: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, if with_text) of each row. sizes: block, group, bucket_bytes and spread."""
    docs = texts_of(df, id_col, text_col)
    rows = stash(exact_dedup(docs, normalise=False, extras={"n_bytes": F.octet_length("text").cast("long")}, most_bytes=most_bytes), "copies")
    repeated = stash(rows.where("kept and group_size > 1").select(F.unhex("text_sha256").alias("_cairn_sha")), "repeated")
    reps = drop_copies(docs, normalise=False, most_bytes=most_bytes, repeated=repeated).withColumn("doc", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    n_bytes = rows.where("kept").agg(F.sum("n_bytes")).first()[0] or 0
    cut = cut_representatives(reps, n_bytes, length, **sizes)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
    # Rows of one text and one id share their result; there is one for each text, so only such repeated rows are joined.
    copy = F.col("keep_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("keep_id")))
    # Of a text too short to repeat all is kept, and it is short: its bytes come from the table again.
    long = F.col("n_bytes") >= length
    copies = rows.where(copy).select(
        "doc_id",
        "n_bytes",
        F.when(long, F.col("n_bytes")).otherwise(0).alias("n_removed"),
        long.cast("long").alias("n_spans"),
        F.when(long, F.lit(hashlib.sha256().hexdigest())).otherwise(F.col("text_sha256")).alias("kept_sha256"),
        "text_sha256",
    )
    again = rows.where(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "text_sha256")
    if with_text or again.limit(1).count():
        cut = stash(cut, "cut")
        if with_text:
            short = cut.where(F.col("n_bytes") < length).select("text_sha256", "kept_text")
            copies = copies.join(short, "text_sha256", "left").withColumn("kept_text", F.coalesce("kept_text", F.lit(b"")))
        copies = copies.select(*names).unionByName(again.join(cut.drop("doc_id"), "text_sha256").select(*names))
    return cut.select(*names).unionByName(copies.select(*names))
