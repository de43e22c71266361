"""Tables of vectors as rows that hold a block of them, and all pairs of such blocks.

Two tables meet as a cartesian product of their stored blocks: a task holds a few files of the asking blocks and reads the
other blocks one by one where they lie. So nothing is shuffled or sent to the driver, also of what is found: a task meets all.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.stored import stored

#: Vectors of a block at least and at most; bytes of a file of blocks, which a task holds whole.
LEAST, MOST, PART = 256, 4096, 64 << 20
_BLOCK = "c binary, s binary, x binary"


def vectors(lists: pa.Array) -> np.ndarray:
    """The rows of a matrix; they must be of one length and without nulls."""
    x = lists.flatten().to_numpy(zero_copy_only=False)
    width = len(lists[0]) if len(lists) else 0
    if lists.null_count or x.dtype != np.float64 or len(x) != len(lists) * width or (np.diff(lists.offsets.to_numpy()) != width).any() or lists.values.null_count:
        raise ValueError("vectors must have the same length and no nulls")
    return x.reshape(len(lists), width)


def _packed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def whole(parts: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(v).tobytes()], pa.binary()) for v in zip(*parts)], names=["c", "s", "x"])

        for batch in batches:
            part = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), vectors(batch.column(2)))
            while len(part[0]):
                room = size - sum(len(p[0]) for p in held)
                held.append(tuple(v[:room] for v in part))
                part = tuple(v[room:] for v in part)
                if sum(len(p[0]) for p in held) == size:
                    yield whole(held)
                    held = []
        if held:
            yield whole(held)

    return run


def packed(points: DataFrame, n: int, width: int, name: str = "blocks") -> DataFrame:
    """Stored blocks of n points (c, s, x), or about so many: numbers, weights and vectors of this width."""
    size = min(MOST, max(LEAST, 4 * isqrt(max(n, 1))))
    blocks = max(1, -(-n // size))
    parts = min(blocks, max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * (8 * width + 16) // PART)))
    # A part of one block may be a little larger.
    return stored(points.select("c", F.col("s").cast("double").alias("s"), "x").repartition(parts).mapInArrow(_packed(2 * size if parts == blocks else size), _BLOCK), name)


def met(asking: DataFrame, others: DataFrame) -> DataFrame:
    """All pairs of stored blocks (c2, s2, x2, c, s, x), those of one asking block in one task.

    Of a cartesian product the left side is read row by row, the right one is held.
    """
    other = others.select(*[F.col(f).alias(f"{f}2") for f in ("c", "s", "x")]).coalesce(1)
    return other.hint("shuffle_replicate_nl").crossJoin(asking)


def opened(batch: pa.RecordBatch, i: int, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, s, x) of a block in a row's columns from at on."""
    c, s, x = (np.frombuffer(batch.column(at + k)[i].as_buffer(), dtype=d) for k, d in enumerate((np.int64, np.float64, np.float64)))
    return c, s, x.reshape(len(c), -1)


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple, tuple]]:
    """(which of the task's asking blocks, from 0 in the order they come, that block, other block) of rows of met."""
    seen: dict[bytes, int] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            yield seen.setdefault(batch.column(3)[i].as_buffer().to_pybytes(), len(seen)), opened(batch, i, 3), opened(batch, i, 0)


def slack(x2: np.ndarray, y2: np.ndarray, width: int) -> np.ndarray:
    """What squared distances by products may err, of rows with these squares."""
    return 1e-15 * (width + 8) * (x2 + y2.max(initial=0))


def squares(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs, by differences."""
    return np.concatenate([np.zeros(0)] + [((x[i[k : k + 8192]] - y[j[k : k + 8192]]) ** 2).sum(1) for k in range(0, len(i), 8192)])
