"""Embedding whitening by matrix-free block subspace iteration.

Vectors become whole numbers x = floor(SCALE * c) + OFFSET and are stored in blocks. Of x only sums are needed: each pass
over the blocks computes X'(XQ), X the centred rows and Q a block of orthonormal directions, and adds it up; a covariance
matrix is never formed. The driver orthonormalises (QR), rotates to the best directions in the block (Rayleigh-Ritz) and
goes on until the residual |Vq - eq| of each of the k components is below TOLERANCE times the largest eigenvalue.

Directions converge as the ratio of the eigenvalue behind the block to theirs. Where the residuals of two passes say that
more than PATIENCE passes would follow, the block doubles, up to all dimensions, where one more pass ends it: so nearly
equal eigenvalues cost width and not passes.

Centring is exact: n * x - S (S the sums of x) is a whole number, and so is its square, the deviation. The sums of a pass
are added in a fixed order, so equal tables give equal results.

Defined cases: rows whose vector is null or has null or non-finite entries take no part; vectors shorter than the longest
end in zeros; components whose eigenvalue is zero (below ZERO times the largest) don't exist, so constant vectors, a
single one or none give no rows; repeated rows and a null vec_id count as they are; entries for which a deviation exceeds
64 bits are an error; other columns don't pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.blocks import record
from cairn.llm.common import map_arrow, shards, short_batches, stash
from cairn.llm.vectors import finite, matrix, narrow, widen, width_of

COMPONENTS, SCALE, OFFSET = 32, 64, 1_000_000
#: Directions beside those that are wanted, to begin with.
SPARE = 16
TOLERANCE, PATIENCE, PASSES, ZERO = 1e-13, 8, 200, 1e-12
#: Rows of a block, and rows of the summed matrix that one task adds up.
BLOCK, STRIPE = 4096, 8


def _blocks(rows: DataFrame, width: int, scale: int, offset: int) -> DataFrame:
    """(ids, data): blocks of rows (vec_id, vector), the vectors as whole numbers."""

    def make():
        def each(batch: pa.RecordBatch):
            for i in range(0, len(batch), BLOCK):
                part = batch.slice(i, BLOCK)
                x = np.floor(matrix(part.column(1), width) * scale)
                if (np.abs(x) >= 2.0**62).any():
                    raise ValueError("a vector has an entry that 64 bits don't hold")
                ids = part.column(0)
                gaps = np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes() if ids.null_count else b""
                yield record("ids binary, gaps binary, data binary", [narrow(ids.fill_null(0).to_numpy())], [gaps], [narrow(x.astype(np.int64) + offset)])

        return each

    return map_arrow(rows, make, "ids binary, gaps binary, data binary")


def summed(blocks: DataFrame, of: Callable[[np.ndarray], np.ndarray], kind: type = np.float64) -> np.ndarray:
    """The sum of of(x) over all blocks x: matrices of one shape.

    A task adds up its blocks and sends stripes of rows of the sum; each stripe is added up in a task, in the order of
    the tasks they come from. So the driver gets one matrix, whatever the number of tasks.
    """
    schema = "stripe int, task int, shape binary, data binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column(0).to_pylist():
                part = of(widen(data)).astype(kind)
                total = part if total is None else total + part
        if total is not None:
            for i in range(0, len(total), STRIPE):
                x = np.ascontiguousarray(total[i : i + STRIPE])
                yield record(schema, [i // STRIPE], [TaskContext.get().partitionId()], [np.array(x.shape).tobytes()], [x.tobytes()])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for stripe, _, shape, data in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(data, dtype=kind).reshape(np.frombuffer(shape, dtype=np.int64))
                held[stripe] = held[stripe] + x if stripe in held else x
        for stripe, x in held.items():
            yield record(schema, [stripe], [0], [np.array(x.shape).tobytes()], [x.tobytes()])

    short_batches(blocks.sparkSession)
    parts = blocks.select("data").mapInArrow(add, schema)
    whole = parts.repartition(min(64, shards(blocks.sparkSession)), "stripe").sortWithinPartitions("stripe", "task").mapInArrow(join, schema)
    found = sorted((r["stripe"], np.frombuffer(r["data"], dtype=kind).reshape(np.frombuffer(r["shape"], dtype=np.int64))) for r in whole.collect())
    return np.concatenate([x for _, x in found]) if found else np.zeros((0, 0), dtype=kind)


@dataclass(frozen=True)
class Whitening:
    """Components as columns, their eigenvalues, and the sums by which rows are centred."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    residual: float


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x less the mean, from whole numbers."""
    return (n * x - sums) / n


def subspace(apply: Callable[[np.ndarray], np.ndarray], width: int, k: int, spare: int = SPARE, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int, float]:
    """(values, vectors, passes, residual) of the k largest eigenvalues of a symmetric matrix that apply multiplies with a block."""
    draw = np.random.default_rng(seed)
    k = min(k, width)
    q = np.linalg.qr(draw.standard_normal((width, min(width, k + spare))))[0]
    last = math.inf
    for passes in range(1, PASSES + 1):
        z = apply(q)
        values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, z = q @ turn, z @ turn
        residual = float(np.linalg.norm(z[:, :k] - q[:, :k] * values[:k], axis=0).max())
        if residual <= TOLERANCE * max(values[0], 0):
            return values[:k], q[:, :k], passes, residual
        more = math.inf if residual >= last or math.isinf(last) else math.log(TOLERANCE * values[0] / residual) / math.log(residual / last)
        if q.shape[1] < width:
            new = q.shape[1] if passes > 1 and more > PATIENCE else 0
            last = math.inf if new else residual
            z = np.concatenate([z, draw.standard_normal((width, min(new, width - q.shape[1])))], axis=1)
            q = np.linalg.qr(z)[0]
        else:
            # The block spans everything: another pass only polishes the rotation.
            q = np.linalg.qr(q)[0]
    raise ArithmeticError(f"{k} components have a residual of {residual / values[0]:.1e} after {PASSES} passes")


def fit(blocks: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Components of the stored blocks; None without a row."""
    counts = summed(blocks, lambda x: np.stack([np.full(x.shape[1], len(x), dtype=np.int64), x.sum(0)], axis=1), np.int64)
    if not counts.size:
        return None
    n, sums = int(counts[0, 0]), np.ascontiguousarray(counts[:, 1])

    def apply(q: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            y = centred(x, n, sums)
            return y.T @ (y @ q)

        return summed(blocks, product) / n

    trace = float(summed(blocks, lambda x: (centred(x, n, sums) ** 2).sum(0)[:, None]).sum() / n)
    if not trace > 0:
        return Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0, 0, 0.0)
    values, vectors, passes, residual = subspace(apply, len(sums), k)
    some = values > ZERO * values[0]
    return Whitening(n, sums, vectors[:, some], values[some], trace, passes, residual)


def _whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    return centred(x, model.n, model.sums) @ (model.vectors / np.sqrt(model.values))


def identity_error(blocks: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity."""
    k = len(model.values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = _whitened(x, model)
        return np.concatenate([w.T @ w, w.sum(0)[None]])

    found = summed(blocks, moments) / model.n
    return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """The sum of (n * x - S) ** 2 of each row, exactly."""
    y = n * x - sums
    most = int(np.abs(y).max(initial=0))
    if most * most * x.shape[1] < 1 << 63:
        return (y * y).sum(1)
    exact = [sum(v * v for v in row) for row in y.tolist()]
    if max(exact) >= 1 << 63:
        raise ValueError("a deviation exceeds 64 bits")
    return np.array(exact, dtype=np.int64)


def whiten(df: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row that takes part and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where(finite("vector"))
    blocks = stash(_blocks(rows, width_of(rows, "vector"), scale, offset), "vectors", "none")
    model = fit(blocks, k)
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema)
    error, explained = identity_error(blocks, model), model.values / model.trace
    components = len(explained)

    def make():
        def each(batch: pa.RecordBatch):
            for ids, gaps, data in zip(*(c.to_pylist() for c in batch.columns)):
                x, ids_ = widen(data), widen(ids)
                w, dev = _whitened(x, model), deviations(x, model.n, model.sums)
                null = np.unpackbits(np.frombuffer(gaps, dtype=np.uint8))[: len(x)].astype(bool) if gaps else np.zeros(len(x), dtype=bool)
                for i in range(0, len(x), 512):
                    m = len(x[i : i + 512])
                    whole = m * components
                    yield record(
                        schema, pa.array(np.repeat(ids_[i : i + m], components), mask=np.repeat(null[i : i + m], components)), np.tile(np.arange(1, components + 1, dtype=np.int32), m), np.full(whole, model.n),
                        np.repeat(dev[i : i + m], components), w[i : i + m].ravel(), np.tile(explained, m), np.full(whole, error),
                    )

        return each

    return map_arrow(blocks, make, schema)
