"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > k) = logistic(w . x - theta_k): one weight vector on hashed text, shared by all cuts, and ordered thresholds
theta_0 < theta_1 < ... It gives the expected grade and the tail probabilities that selection uses.

Fitted on the driver on at most MAX_ROWS labelled rows of WIDTH numbers each (a fixed 49 MB), chosen by hash.

Defined cases: null and empty texts have all-zero features but the length, and get the score these give; without any
label, or with one grade only, every text has that share of grades; equal texts, equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import map_arrow, slices, texts_of
from cairn.llm.features import WIDTH, labelled_sample, trigram_features

#: Labelled rows that a fit uses at most.
MAX_ROWS = 6000


@dataclass
class Ordinal:
    """Weights and thresholds; grades are 0 to len(theta)."""

    weights: np.ndarray
    theta: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, columns in order."""
        return 1 / (1 + np.exp(np.clip(self.theta[None, :] - (x @ self.weights)[:, None], -40, 40)))


def fit(x: np.ndarray, grade: np.ndarray, grades: int, penalty: float = 2e-5, steps: int = 300) -> Ordinal:
    """Maximum likelihood with a ridge, by Nesterov's accelerated gradient on centred features. theta's gaps are exponentials, so ordered."""
    n, cuts = len(grade), grades - 1
    above = np.array([(grade > k).sum() + 0.5 for k in range(cuts)]) / (n + 1)
    base = np.log((1 - above) / above)
    if not n or len(np.unique(grade)) < 2:
        return Ordinal(np.zeros(x.shape[1]), np.maximum.accumulate(base + 1e-9 * np.arange(cuts)))
    centre = x.mean(0, dtype=np.float64)
    x = (x - centre).astype(np.float32)
    gaps = np.log(np.maximum(np.diff(base), 1e-3))
    z = np.concatenate([np.zeros(x.shape[1]), [base[0]], gaps])
    pad = lambda t: np.concatenate([[-np.inf], t, [np.inf]])

    def gradient(z: np.ndarray) -> np.ndarray:
        w = z[: x.shape[1]]
        theta = z[x.shape[1]] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(z[x.shape[1] + 1 :], -20, 20)))])
        t = pad(theta)
        score = x @ w.astype(np.float32)
        with np.errstate(over="ignore"):
            hi, lo = 1 / (1 + np.exp(-(t[grade + 1] - score))), 1 / (1 + np.exp(-(t[grade] - score)))
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        of_score = (dhi - dlo) / n
        of_theta = np.array([(dlo[grade == k + 1].sum() - dhi[grade == k].sum()) / n for k in range(cuts)])
        reach = of_theta[::-1].cumsum()[::-1]
        return np.concatenate([x.T @ of_score.astype(np.float32) + penalty * w, [reach[0]], reach[1:] * np.exp(np.clip(z[x.shape[1] + 1 :], -20, 20))])

    direction = np.random.default_rng(0).standard_normal(x.shape[1]).astype(np.float32)
    for _ in range(12):  # the largest curvature bounds the step
        direction = x.T @ (x @ direction)
        direction /= np.linalg.norm(direction) + 1e-12
    rate = 1 / (0.25 * float(np.linalg.norm(x @ direction)) ** 2 / n * 1.2 + 0.5)
    old = ahead = z
    for step in range(steps):
        new = ahead - rate * gradient(ahead)
        ahead = new + step / (step + 3) * (new - old)
        old = new
    return Ordinal(old[: x.shape[1]], old[: x.shape[1]] @ centre + old[x.shape[1]] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(old[x.shape[1] + 1 :], -20, 20)))]))


def train(docs: DataFrame, labels: DataFrame, grade: Column, grades: int, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Ordinal:
    """Fit on the labelled rows; grade: an integer Column over labels, 0 to grades - 1."""
    graded = labels.select(F.col(id_col), grade.cast("int").alias("grade")).where(F.col("grade").between(0, grades - 1))
    sample = labelled_sample(texts_of(docs, id_col, text_col), graded, ["grade"], max_rows, id_col)

    def make():
        def each(batch: pa.RecordBatch):
            for part, texts in slices(batch, budget=1 << 20):
                x = trigram_features(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "grade", "x"])

        return each

    rows = map_arrow(sample.select("doc_id", "text", "grade"), make, "doc_id long, grade int, x binary").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), dtype=np.float32).reshape(-1, WIDTH)[order]
    return fit(x, rows.column("grade").to_numpy()[order].astype(np.int64), grades)


def score(df: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tails array<double> (P(grade > k)) of each row."""

    def make():
        def each(batch: pa.RecordBatch):
            for part, texts in slices(batch, budget=1 << 20):
                for i in range(0, len(texts), 512):
                    tails = model.tails(trigram_features(texts[i : i + 512]))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(i, 512), pa.array(tails.sum(1)), pa.ListArray.from_arrays(pa.array(np.arange(0, tails.size + 1, tails.shape[1], dtype=np.int32)), pa.array(tails.ravel()))],
                        names=["doc_id", "expected_grade", "tails"],
                    )

        return each

    return map_arrow(texts_of(df, id_col, text_col), make, "doc_id long, expected_grade double, tails array<double>")


def select(df: DataFrame, model: Ordinal, above: int = 0, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose P(grade > above) is least or more. Rows pass through in place."""
    names = df.columns

    def make():
        def each(batch: pa.RecordBatch):
            texts = ["" if t is None else t for t in batch.column(len(names)).to_pylist()]
            keep = np.concatenate([model.tails(trigram_features(texts[i : i + 256]))[:, above] >= least for i in range(0, len(texts), 256)])
            yield batch.select(list(range(len(names)))).filter(pa.array(keep))

        return each

    return map_arrow(df.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).cast("string").alias("_cairn_text")), make, df.schema)
