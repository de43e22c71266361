"""Association of categorical columns: contingency tables, conditional probabilities, Cramér's V, mutual information."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn import presets
from cairn.operators.clean import quoted, recode


def crosstab(df: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right, n): counts of the pairs of values without nulls."""
    return df.select(quoted(left).cast("string").alias("left"), quoted(right).cast("string").alias("right")).dropna().groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))


def conditional_table(df: DataFrame, group: str, target: str, labels: Sequence[str] = (), missing: str = presets.MISSING, undo: dict | None = None) -> DataFrame:
    """(grp, target, n, p): P(target | group) for all pairs of values, absent ones 0. A group column that doesn't exist is constant."""
    rows = df.where(quoted(target).isin(list(labels))) if labels else df
    g = F.coalesce(quoted(group).cast("string"), F.lit(missing)) if group in df.columns else F.lit(missing)
    rows = rows.select(recode(g, undo or {}).alias("grp"), F.coalesce(quoted(target).cast("string"), F.lit(missing)).alias("target"))
    counts = rows.groupBy("grp", "target").agg(F.count(F.lit(1)).alias("n"))
    # Distinct groups times distinct targets: sizes of a table that is read by people.
    every = counts.select("grp").distinct().crossJoin(F.broadcast(counts.select("target").distinct()))
    full = every.join(counts, ["grp", "target"], "left").select("grp", "target", F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("grp")))


def _chi2_parts(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., n, r, c, s, yates): totals, categories, sum of o^2 / (row * column), and for 2 x 2 tables chi^2 with the continuity correction, of each table of cells (by..., left, right, n)."""
    each = cells.withColumn("_row", F.sum("n").over(Window.partitionBy(*by, "left"))).withColumn("_column", F.sum("n").over(Window.partitionBy(*by, "right"))).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    # Every cell of a 2 x 2 table is as far from its expectation; an absent one counts by the others of its row.
    expected = F.col("_row") * F.col("_column") / F.col("_all")
    gap = F.max(F.abs(F.col("n") - expected))
    sums = each.groupBy(*by).agg(
        F.sum("n").alias("total"), F.count_distinct("left").alias("r"), F.count_distinct("right").alias("c"), F.sum(F.col("n") * F.col("n") / (F.col("_row") * F.col("_column"))).alias("s"),
        gap.alias("_gap"), F.max("_row").alias("_r1"), F.max("_column").alias("_c1"),
    )
    # The sum of the inverse expectations of the four cells is n * n * n / (r1 * r2 * c1 * c2).
    n = F.col("total").cast("double")
    less = F.greatest(F.col("_gap") - F.least(F.lit(0.5), F.col("_gap")), F.lit(0.0))
    r2, c2 = n - F.col("_r1"), n - F.col("_c1")
    yates = F.when((F.col("r") == 2) & (F.col("c") == 2), less * less * F.try_divide(n * n * n, F.col("_r1") * r2 * F.col("_c1") * c2))
    return sums.select(*by, "total", "r", "c", "s", yates.alias("yates"))


def _cramers(parts: DataFrame, by: Sequence[str], corrected: bool, continuity: bool = False) -> DataFrame:
    n, r, c = F.col("total"), F.col("r"), F.col("c")
    chi2 = F.greatest(n * (F.col("s") - 1), F.lit(0.0))
    if continuity:
        chi2 = F.coalesce(F.col("yates"), chi2)
    if corrected:
        m = F.greatest(n - 1, F.lit(1))
        phi2 = F.greatest(F.lit(0.0), chi2 / n - (c - 1) * (r - 1) / m)
        least = F.least(r - (r - 1) * (r - 1) / m - 1, c - (c - 1) * (c - 1) / m - 1)
    else:
        phi2, least = chi2 / n, F.least(r - 1, c - 1).cast("double")
    v = F.when(least > 0, F.sqrt(phi2 / least)).otherwise(F.lit(0.0))
    return parts.select(*by, n.alias("n"), chi2.alias("chi2"), v.alias("cramers_v"))


def cramers_v(df: DataFrame, left: str, right: str, corrected: bool = True, continuity: bool | None = None) -> DataFrame:
    """(n, chi2, cramers_v) of two columns; bias-corrected by default; a constant column gives 0. continuity: chi^2 of 2 x 2 tables with Yates' correction, by default where the coefficient is not corrected for bias."""
    cells = crosstab(df, left, right).withColumn("_one", F.lit(1))
    return _cramers(_chi2_parts(cells, ["_one"]), ["_one"], corrected, not corrected if continuity is None else continuity).drop("_one")


#: Columns of a block: a task counts a pair of blocks of them at a time, as one matrix of codes.
PAIR_BLOCK = 24


def pair_cells(df: DataFrame, columns: Sequence[str], width: int = PAIR_BLOCK) -> DataFrame:
    """(variable_a, variable_b, left, right, n) of all pairs of columns, a before b in the given order, for rows in which neither is null.

    Each task codes the values of its rows' columns, and keeps for a pair of blocks of columns the matrix of how often their
    codes occur together, a product of indicator matrices. What moves is a row for each cell that a task has seen: it
    depends on columns and values, and not on the number of rows.
    """
    names = list(columns)
    cells = df.select(*[quoted(c).cast("string").alias(f"_{i}") for i, c in enumerate(names)]).mapInArrow(lambda batches: cooccurrences(batches, len(names), width), CELLS)
    summed = cells.groupBy("a", "b", "left", "right").agg(F.sum("n").alias("n"))
    of = F.array(*[F.lit(c) for c in names])
    return summed.select(F.get(of, F.col("a")).alias("variable_a"), F.get(of, F.col("b")).alias("variable_b"), "left", "right", "n")


CELLS = "a int, b int, left string, right string, n long"
#: Codes with which a task hands on what it has counted, so that columns of many values don't fill it.
CODES = 1 << 12


def cooccurrences(batches: Iterator[pa.RecordBatch], columns: int, width: int) -> Iterator[pa.RecordBatch]:
    """CELLS of rows of texts: counts of all pairs of values of two columns, summed over many batches."""
    codes: list[dict[str, int]] = [{} for _ in range(columns)]
    counts: dict[tuple[int, int], np.ndarray] = {}
    blocks = [range(i, min(i + width, columns)) for i in range(0, columns, width)]

    def flush() -> Iterator[pa.RecordBatch]:
        values = [np.array(list(c), dtype=object) for c in codes]
        for (a, b), n in counts.items():
            left, right = np.nonzero(n)
            if len(left):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(left), a, dtype=np.int32)), pa.array(np.full(len(left), b, dtype=np.int32)), pa.array(values[a][left], pa.string()), pa.array(values[b][right], pa.string()), pa.array(n[left, right])], names=["a", "b", "left", "right", "n"])
        counts.clear()
        for c in codes:
            c.clear()

    for whole in batches:
        # As many rows as have CODES new values in a column at most: so many cells has a pair's matrix at a time.
        for start in range(0, whole.num_rows, CODES):
            batch = whole.slice(start, CODES)
            coded = []
            for i in range(columns):
                d = batch.column(i).dictionary_encode()
                own = np.array([codes[i].setdefault(v, len(codes[i])) for v in d.dictionary.to_pylist()] + [-1], dtype=np.int64)
                coded.append(own[d.indices.fill_null(len(own) - 1).to_numpy()])
            wide = max(map(len, codes), default=0) > 64
            indicators = [_indicators([coded[c] for c in block], [len(codes[c]) for c in block]) for block in blocks] if not wide else []
            for p in range(len(blocks)):
                for q in range(p, len(blocks)):
                    if wide:
                        pairs = [(a, b, _crossed(coded[a], coded[b], len(codes[a]), len(codes[b]))) for a in blocks[p] for b in blocks[q] if a < b]
                    else:
                        (x, sx), (y, sy) = indicators[p], indicators[q]
                        both = (x.T @ y).astype(np.int64)
                        pairs = [(a, b, both[sx[i] : sx[i + 1], sy[j] : sy[j + 1]]) for i, a in enumerate(blocks[p]) for j, b in enumerate(blocks[q]) if a < b]
                    for a, b, n in pairs:
                        old = counts.get((a, b))
                        if old is not None and old.shape != n.shape:
                            old = np.pad(old, [(0, n.shape[0] - old.shape[0]), (0, n.shape[1] - old.shape[1])])
                        counts[a, b] = n.copy() if old is None else old + n
            if sum(n.size for n in counts.values()) > CODES * CODES:
                yield from flush()
    yield from flush()


def _indicators(coded: Sequence[np.ndarray], sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """A 0/1 column for each code of each column, and where each column's begin."""
    starts = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros((len(coded[0]), int(starts[-1])), dtype=np.float32)
    for c, s in zip(coded, starts):
        some = np.flatnonzero(c >= 0)
        out[some, s + c[some]] = 1
    return out, starts


def _crossed(a: np.ndarray, b: np.ndarray, m: int, n: int) -> np.ndarray:
    some = (a >= 0) & (b >= 0)
    return np.bincount(a[some] * n + b[some], minlength=m * n).reshape(m, n)


def cramers_v_pairs(df: DataFrame, columns: Sequence[str], corrected: bool = True, continuity: bool | None = None) -> DataFrame:
    """(variable_a, variable_b, n, chi2, cramers_v) of each pair of columns, a before b in the given order."""
    by = ["variable_a", "variable_b"]
    return _cramers(_chi2_parts(pair_cells(df, columns), by), by, corrected, not corrected if continuity is None else continuity)


def cramers_v_matrix(df: DataFrame, columns: Sequence[str], corrected: bool = True) -> DataFrame:
    """(variable_a, variable_b, cramers_v): the whole symmetric matrix, 1 on its diagonal."""
    half = cramers_v_pairs(df, columns, corrected).select("variable_a", "variable_b", "cramers_v")
    other = half.select(F.col("variable_b").alias("variable_a"), F.col("variable_a").alias("variable_b"), "cramers_v")
    diagonal = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "variable_a string, variable_b string, cramers_v double")
    return half.unionByName(other).unionByName(diagonal)


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The k strongest pairs; ties by name."""
    return pairs.orderBy(F.desc("cramers_v"), "variable_a", "variable_b").limit(k)


def mutual_information(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable_a, variable_b, mutual_information): natural logarithm, symmetric, the diagonal 1 by convention."""
    by = ["variable_a", "variable_b"]
    cells = pair_cells(df, columns)
    each = cells.withColumn("_t", F.sum("n").over(Window.partitionBy(*by))).withColumn("_r", F.sum("n").over(Window.partitionBy(*by, "left"))).withColumn("_c", F.sum("n").over(Window.partitionBy(*by, "right")))
    half = each.groupBy(*by).agg(F.sum(F.col("n") / F.col("_t") * F.log(F.col("n") * F.col("_t") / (F.col("_r") * F.col("_c")))).alias("mutual_information"))
    other = half.select(F.col("variable_b").alias("variable_a"), F.col("variable_a").alias("variable_b"), "mutual_information")
    return half.unionByName(other).unionByName(df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "variable_a string, variable_b string, mutual_information double"))


def matrix_wide(matrix: DataFrame, columns: Sequence[str], value: str = "cramers_v") -> DataFrame:
    """A matrix as a table with a column for each variable, for export."""
    return matrix.groupBy("variable_a").pivot("variable_b", list(columns)).agg(F.first(value)).orderBy("variable_a")
