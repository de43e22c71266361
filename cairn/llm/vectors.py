"""Vectors as rows of integer matrices, stored in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.blocks import pack, unpack


def finite(column: str):
    """Whether the vector and all its entries are there and finite. An empty vector is."""
    bad = F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of doubles; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def narrow(x: np.ndarray) -> bytes:
    """Integers as bytes: their distances from the least, in as few bytes as these need, compressed."""
    low = int(x.min()) if x.size else 0
    high = int(x.max()) - low if x.size else 0
    kind = np.uint16 if high < 1 << 16 else np.uint32 if high < 1 << 32 else np.uint64
    return pack(np.array([low], dtype=np.int64), np.array(x.shape, dtype=np.int64), (x.ravel().view(np.uint64) - np.uint64(low & (1 << 64) - 1)).astype(kind))


def widen(data: bytes) -> np.ndarray:
    """What narrow stored, as int64."""
    low, shape, x = unpack(data)
    return (x.astype(np.uint64) + low.view(np.uint64)).view(np.int64).reshape(shape)


def width_of(df: DataFrame, column: str) -> int:
    """Entries of the longest vector."""
    return df.agg(F.max(F.size(column))).first()[0] or 0
