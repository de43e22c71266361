"""Texts in blocks, and sorted keys that blocks exchange with hash buckets.

Operators that must look up many keys of a text in corpus-wide tables don't send a row a key. A task packs some MB of texts
as one compressed row, merges the keys of several such rows (a group) to one sorted list, and sends each bucket its part as
differences; the bucket's answers come back in the same order. So what moves is a few percent of the texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of a block at most, so that a row number has 16 bits.
BLOCK_ROWS = 1 << 16
_IPC = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))


def trim() -> None:
    """Give back to the system what a group needed: the executor's memory has to do for two workers and the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def blocks(batches: Iterator[pa.RecordBatch], size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of batches in blocks of about size bytes of that column each (one long text may exceed it)."""
    held: list[pa.RecordBatch] = []
    total = many = 0

    def whole() -> pa.RecordBatch:
        out = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        return out

    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(sizes[at - 1]) if at else 0
            end = min(int(np.searchsorted(sizes, before + size - total)) + 1, batch.num_rows, at + BLOCK_ROWS - many)
            held.append(batch.slice(at, end - at))
            many += end - at
            total += int(sizes[end - 1]) - before
            at = end
            if total >= size or many >= BLOCK_ROWS:
                yield whole()
                total = many = 0
    if held:
        yield whole()


def freeze(batch: pa.RecordBatch) -> bytes:
    """A block as bytes, compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_IPC) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def thaw(data) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of any lengths as bytes: their bytes by significance (small numbers compress), compressed."""
    head, body = [], []
    for x in columns:
        head.append(f"{x.dtype.str}:{len(x)}")
        body.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes())
    raw = b"".join(body)
    title = ",".join(head).encode()
    return len(title).to_bytes(2, "little") + title + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    n = int.from_bytes(data[:2], "little")
    kinds = [x.split(":") for x in bytes(data[2 : 2 + n]).decode().split(",")]
    sizes = [(np.dtype(kind), int(m)) for kind, m in kinds]
    raw = pa.Codec("zstd").decompress(data[2 + n :], decompressed_size=sum(k.itemsize * m for k, m in sizes), asbytes=True)
    out, at = [], 0
    for kind, m in sizes:
        planes = np.frombuffer(raw, dtype=np.uint8, count=m * kind.itemsize, offset=at)
        out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, m).T).view(kind).ravel())
        at += m * kind.itemsize
    return out


def pack_sorted(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """As pack, with ascending uint64 keys in front as their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)), *columns)


def unpack_sorted(data: bytes) -> list[np.ndarray]:
    first, *rest = unpack(data)
    return [np.cumsum(first, dtype=np.uint64), *rest]


def firsts(x: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, dtype=np.int64)


def merge_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = firsts(key)
    return key[first], (np.add.reduceat(count, first) if len(key) else count)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, where it is) for each that occurs, in the order of the rows."""
    order = np.argsort(bucket, kind="stable")
    head = firsts(bucket[order])
    for i, j in zip(head.tolist(), [*head[1:].tolist(), len(order)]):
        yield int(bucket[order[i]]), order[i:j]


def keyed(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, Iterator[list]]]:
    """(key, other columns row by row) of runs of rows with equal values in the first n columns. A run must be used up before the next."""
    each = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    row = next(each, None)

    def run():
        nonlocal row
        key = row[:n]
        while row is not None and row[:n] == key:
            yield row[n:]
            row = next(each, None)

    since = 0
    while row is not None:
        yield row[:n], run()
        since += 1
        if since % 16 == 0 or n == 1:
            trim()


def spread(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each number."""
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def record(schema: str, *columns) -> pa.RecordBatch:
    """A batch of the columns of a schema of Spark's, given as arrays or lists."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c.cast(kinds[kind]) if isinstance(c, pa.Array) else pa.array(c, type=kinds[kind]) for (_, kind), c in zip(names, columns)], names=[name for name, _ in names])
