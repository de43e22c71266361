"""Blocks of baskets as vertical bitmaps: for each item the bits of the baskets that have it.

A block's baskets are different and have weights. Weights are sums of powers of two: a basket has a bit in the plane of each
power of its weight, so a set's weight is the sum of its bits times their powers. The bits of 64 baskets are counted at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A block: its number and weight, the items it has, the power of two of each word, and words of all its items.
BLOCK = "block int, weight long, items array<int>, powers binary, words binary"
_SETS = 20_000


def bitmaps(row: np.ndarray, item: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items, powers, words) of baskets: basket row[i] has item[i]; weight of each basket. words: a row for each item."""
    ids, at = np.unique(item, return_inverse=True)
    order = np.argsort(row, kind="stable")
    row, at = row[order], at[order]
    powers, parts = [], []
    for plane in range(int(weight.max(initial=0)).bit_length()):
        has = weight >> plane & 1 == 1
        place = np.cumsum(has) - 1
        mine = has[row]
        words = np.zeros((len(ids), -(-int(has.sum()) // 64)), dtype=np.uint64)
        p = place[row[mine]]
        np.bitwise_or.at(words, (at[mine], p >> 6), np.uint64(1) << (p & 63).astype(np.uint64))
        powers.append(np.full(words.shape[1], float(1 << plane)))
        parts.append(words)
    return ids, np.concatenate(powers or [np.zeros(0)]), np.concatenate(parts or [np.zeros((len(ids), 0), dtype=np.uint64)], axis=1)


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """BLOCK of (block, ids, w) in the order of blocks."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, weight = table["ids"].chunk(0), table["w"].to_numpy()
        row = np.repeat(np.arange(len(weight)), np.diff(ids.offsets.to_numpy()))
        items, powers, words = bitmaps(row, ids.flatten().to_numpy(), weight)
        columns = [[table["block"][0].as_py()], [int(weight.sum())], [items.astype(np.int32).tolist()], [powers.tobytes()], [words.tobytes()]]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "weight", "items", "powers", "words"])

    now = None
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if held and blocks[i] != now:
                yield whole()
                held = []
            now = blocks[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield whole()


def opened(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items, powers, words) of a row of BLOCK."""
    at = {n: k for k, n in enumerate(batch.schema.names)}
    items = np.array(batch.column(at["items"])[i].as_py(), dtype=np.int64)
    powers = np.frombuffer(batch.column(at["powers"])[i].as_buffer(), dtype=np.float64)
    return items, powers, np.frombuffer(batch.column(at["words"])[i].as_buffer(), dtype=np.uint64).reshape(len(items), len(powers))


def weigh(words: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """The weight of each row of words; exact below 2 ** 53."""
    return np.bitwise_count(words).astype(np.float64) @ powers


def mine(items: np.ndarray, powers: np.ndarray, words: np.ndarray, least: float, size: int, firsts: np.ndarray) -> Iterator[tuple[list[int], int]]:
    """Sets of up to size items of at least that weight whose first item is one of firsts (places in items), and their weights.

    Depth first: a set is extended by later items that are frequent with it, whose words are kept with its own; words in
    which the set has no basket are left out as it grows.
    """
    single = weigh(words, powers)
    some = np.flatnonzero(single >= least)
    for j in firsts[single[firsts] >= least].tolist():
        later = some[some > j]
        yield [int(items[j])], int(single[j])
        if size > 1 and len(later):
            yield from _extend([int(items[j])], items[later], powers, words[later], words[j], least, size - 1)


def _extend(prefix: list[int], items: np.ndarray, powers: np.ndarray, words: np.ndarray, own: np.ndarray, least: float, size: int) -> Iterator[tuple[list[int], int]]:
    live = np.flatnonzero(own)
    if len(live) * 2 < len(own):
        words, own, powers = words[:, live], own[live], powers[live]
    both = words & own
    weight = weigh(both, powers)
    some = np.flatnonzero(weight >= least)
    items, both, weight = items[some], both[some], weight[some]
    for k in range(len(some)):
        found = [*prefix, int(items[k])]
        yield found, int(weight[k])
        if size > 1 and k + 1 < len(some):
            yield from _extend(found, items[k + 1 :], powers, both[k + 1 :], both[k], least, size - 1)


def _batches(found: Iterator[tuple[list[int], int]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[list[int], int]] = []

    def whole() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.list_(pa.int32())), pa.array([n for _, n in held], pa.int64())], names=["ids", "n"])

    for pair in found:
        held.append(pair)
        if len(held) == _SETS:
            yield whole()
            held.clear()
    if held:
        yield whole()


def mined(support: float, size: int):
    """(ids, n) of rows of BLOCK with slot and slots: the sets of the block with at least that share of its weight, from every slots-th item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                items, powers, words = opened(batch, i)
                slot, slots, weight = (batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("slot", "slots", "weight"))
                yield from _batches(mine(items, powers, words, least_of(weight, support), size, np.arange(slot, len(items), slots)))

    return run


def least_of(rows: int, support: float) -> int:
    """The fewest rows that are this share of all, one at least."""
    return max(1, -int(-(rows * support - 1e-9) // 1))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, n) of (block, slot, at, ..., of, ids): a row of BLOCK (at 0), then candidate sets (of: their numbers, ids: their items) in order.

    Sets that follow each other share the words of the items that they begin with.
    """
    block = None
    for batch in batches:
        at, numbers, sets = (batch.column(batch.schema.get_field_index(c)) for c in ("at", "of", "sets"))
        for i, kind in enumerate(at.to_pylist()):
            if kind == 0:
                block = opened(batch, i)
                continue
            items, powers, words = block
            place = dict(zip(items.tolist(), range(len(items))))
            held: list[tuple[int, np.ndarray | None]] = []
            counts = []
            for ids in sets[i].as_py():
                same = 0
                while same < len(held) and same < len(ids) and held[same][0] == ids[same]:
                    same += 1
                del held[same:]
                for x in ids[same:]:
                    mine_ = words[place[x]] if x in place else None
                    before = held[-1][1] if held else mine_
                    held.append((x, None if mine_ is None or before is None else before & mine_))
                own = held[-1][1]
                counts.append(0 if own is None else int(np.bitwise_count(own).astype(np.float64) @ powers))
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(numbers[i].as_py(), dtype=np.int64)[some]), pa.array(np.array(counts, dtype=np.int64)[some])], names=["of", "n"])
