"""Simple-8b: word-aligned integer coding, and a segment format for token ids.

A 64-bit word holds a 4-bit selector and COUNT[selector] values of BITS[selector] bits each; a value of 60 bits or
more follows an ESCAPE word as a raw word. Ids are coded in blocks of BLOCK; blocks begin at a word of their own whose
offset the segment lists, so blocks decode independently and together (vectorised over all words of one selector).

Segment: magic "S8B1", block size u32, ids u64, blocks u32, word offsets u32 * (blocks + 1), words u64 ... (little-endian).
"""

from __future__ import annotations

import struct

import numpy as np

# Values in a word, and bits of each, by selector.
COUNT = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
BITS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
ESCAPE = 15
MAGIC = b"S8B1"
BLOCK = 4096
_HEAD = struct.Struct("<4sIQI")


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, 1 at least."""
    out = np.ones(values.shape, dtype=np.uint8)
    small = values.max(initial=0) < 1 << 32
    probe = values.astype(np.uint32) if small else values
    for bit in range(1, 32 if small else 64):
        limit = 1 << bit
        if int(probe.max(initial=0)) < limit:
            break
        out += probe >= probe.dtype.type(limit)
    return out


def _selectors(widths: np.ndarray) -> np.ndarray:
    """At each position (blocks x BLOCK) the selector of the fullest word that can start there; past the block, zeros follow."""
    blocks, block = widths.shape
    padded = np.zeros((blocks, block + 60), dtype=np.uint8)
    padded[:, :block] = widths
    best = np.zeros((blocks, block), dtype=np.uint8)
    window, span = padded, 1
    for s in range(1, len(COUNT)):
        n = int(COUNT[s])
        while span * 2 <= n:
            window = np.maximum(window[:, : window.shape[1] - span], window[:, span:])
            span *= 2
        # Two windows of span overlap to one of n.
        wide = np.maximum(window[:, :block], window[:, n - span : n - span + block]) if n > span else window[:, :block]
        fits = wide <= BITS[s]
        if not fits.any():
            break
        best += fits
    best[widths > 60] = ESCAPE
    return best


def encode(ids: np.ndarray) -> bytes:
    """A segment of these unsigned integers."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return _HEAD.pack(MAGIC, BLOCK, 0, 0) + np.zeros(1, dtype="<u4").tobytes()
    # Each block in a row of its own with zeros behind it, which fill up its last word.
    values = np.zeros((blocks, BLOCK + 60), dtype=np.uint64)
    values[:-1, :BLOCK] = ids[: (blocks - 1) * BLOCK].reshape(blocks - 1, BLOCK)
    values[-1, : n - (blocks - 1) * BLOCK] = ids[(blocks - 1) * BLOCK :]
    lengths = np.full(blocks, BLOCK, dtype=np.int64)
    lengths[-1] = n - (blocks - 1) * BLOCK
    widths = _widths(values[:, :BLOCK])
    values = values.ravel()
    selectors = _selectors(widths)
    takes = np.ones(16, dtype=np.int64)
    takes[: len(COUNT)] = COUNT
    at, alive, steps = np.zeros(blocks, dtype=np.int64), np.arange(blocks), []
    while len(alive):  # one word of every block a round
        chosen = selectors[alive, at[alive]]
        steps.append((alive, at[alive], chosen))
        at[alive] += takes[chosen]
        alive = alive[at[alive] < lengths[alive]]
    block = np.concatenate([s[0] for s in steps])
    order = np.argsort(block, kind="stable")
    block = block[order]
    start = (np.concatenate([s[1] for s in steps])[order] + block * (BLOCK + 60)).astype(np.int64)
    chosen = np.concatenate([s[2] for s in steps])[order]
    words_each = 1 + (chosen == ESCAPE)
    place = np.cumsum(words_each) - words_each
    words = np.zeros(int(words_each.sum()), dtype=np.uint64)
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        head = np.uint64(int(s) << 60)
        if s == ESCAPE:
            words[place[mine]] = head
            words[place[mine] + 1] = values[start[mine]]
            continue
        word = np.full(len(mine), head, dtype=np.uint64)
        from_ = start[mine]
        for j in range(int(COUNT[s])):
            word |= values[from_ + j] << np.uint64(j * int(BITS[s]))
        words[place[mine]] = word
    offsets = np.zeros(blocks + 1, dtype="<u4")
    offsets[1:] = np.cumsum(np.bincount(block, weights=words_each, minlength=blocks).astype(np.int64))
    return _HEAD.pack(MAGIC, BLOCK, n, blocks) + offsets.tobytes() + words.astype("<u8").tobytes()


def decode(segment: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (all by default), as uint64. A damaged segment raises ValueError."""
    if len(segment) < _HEAD.size:
        raise ValueError("not a Simple-8b segment")
    magic, size, n, blocks = _HEAD.unpack_from(segment)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b segment")
    offsets = np.frombuffer(segment, dtype="<u4", count=blocks + 1, offset=_HEAD.size).astype(np.int64)
    last = blocks if last is None else min(last, blocks)
    body = _HEAD.size + 4 * (blocks + 1)
    if len(segment) < body + 8 * int(offsets[-1]):
        raise ValueError("a Simple-8b segment is cut short")
    if first >= last:
        return np.zeros(0, dtype=np.uint64)
    words = np.frombuffer(segment, dtype="<u8", count=int(offsets[last] - offsets[first]), offset=body + 8 * int(offsets[first]))
    selectors = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words), dtype=bool)
    if (selectors == ESCAPE).any():  # what follows an escape is a value, whatever its top bits are
        for i in np.flatnonzero(selectors == ESCAPE):
            if not raw[i]:
                raw[i + 1] = True
    takes = np.zeros(16, dtype=np.int64)
    takes[: len(COUNT)] = COUNT
    counts = np.where(raw, 1, takes[selectors])
    block_of = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1]))
    totals = np.add.reduceat(counts, (offsets[first:last] - offsets[first]))
    begins = np.cumsum(counts) - counts
    # Each block in a row of its own with room for what its last word has to spare.
    begins += (np.arange(last - first) * (size + 60) - (np.cumsum(totals) - totals))[block_of]
    out = np.zeros((last - first) * (size + 60), dtype=np.uint64)
    for s in np.unique(selectors[~raw])[::-1]:
        if s == ESCAPE:
            continue
        mine = np.flatnonzero((selectors == s) & ~raw)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        word, at = words[mine], begins[mine]
        for j in range(int(COUNT[s])):
            out[at + j] = word & mask
            word = word >> np.uint64(int(BITS[s]))
    out[begins[raw]] = words[raw]
    out = out.reshape(-1, size + 60)[:, :size].ravel()
    return out[: min(n, last * size) - first * size]
