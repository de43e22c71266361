"""Mixing sources to target weights by soft membership.

A softmax classifier fitted on a labelled table gives each document its posterior p over the domains. A document of n
tokens then counts n * p[d] expected tokens to domain d. Projected-gradient least squares finds nonnegative document
rates r whose expected domain totals A r, A[d, i] = n_i p_i[d], match the targets:

    r_i <- max(0, r_i - step * sum_d p_i[d] g_d),   g = C^-1 (A r - t)

which is the gradient of the squared errors, in the metric that weighs a document by its tokens, scaled by the inverse
of the curvature C over the documents whose rate isn't zero; it needs some ten iterations where the plain gradient
needs hundreds. Each iteration is one distributed sum of domains * (domains + 1) numbers; the rates are no stored
state: a row replays the few gradients so far. The step is halved when the error grows.

Fitted on at most MAX_ROWS labelled rows, chosen by hash. Domains: the values of a label column, at most MAX_DOMAINS.

Defined cases: null and empty texts have no tokens, the posterior of an empty text, and a rate that follows from it;
an empty table gives no rows; a single domain gives all documents one rate; a domain without expected tokens leaves
its target unmet. Equal texts, equal rates.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import map_arrow, pin, slices, texts_of
from cairn.llm.features import WIDTH, labelled_sample, trigram_features

MAX_ROWS, MAX_DOMAINS = 6000, 64


@dataclass
class Softmax:
    domains: list[str]
    weights: np.ndarray  # WIDTH x domains
    bias: np.ndarray

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, domains: list[str], penalty: float = 1e-6, steps: int = 1000) -> Softmax:
    """Maximum likelihood with a ridge, by Nesterov's accelerated gradient on centred features."""
    n, k = len(y), len(domains)
    share = (np.bincount(y, minlength=k) + 0.5) / (n + 0.5 * k)
    if n == 0 or k < 2:
        return Softmax(domains, np.zeros((x.shape[1], k)), np.log(share))
    centre = x.mean(0, dtype=np.float64)
    x = np.hstack([x - centre, np.ones((n, 1))]).astype(np.float32)
    direction = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(12):  # the largest curvature bounds the step
        direction = x.T @ (x @ direction)
        direction /= np.linalg.norm(direction) + 1e-12
    rate = 1 / (0.5 * float(np.linalg.norm(x @ direction)) ** 2 / n * 1.2 + penalty)
    hot = np.eye(k, dtype=np.float32)[y]
    old = ahead = np.vstack([np.zeros((x.shape[1] - 1, k)), np.log(share)[None]])
    for step in range(steps):
        z = x @ ahead.astype(np.float32)
        z = np.exp(z - z.max(1, keepdims=True))
        gradient = x.T @ (z / z.sum(1, keepdims=True) - hot) / n
        gradient[:-1] += penalty * ahead[:-1]
        new = ahead - rate * gradient
        ahead = new + step / (step + 3) * (new - old)
        old = new
    return Softmax(domains, old[:-1], old[-1] - centre @ old[:-1])


def train(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Softmax:
    """Fit on labelled rows; domain: a string Column over labels. Labels outside domains are left out."""
    if not 0 < len(domains) <= MAX_DOMAINS or len(set(domains)) < len(domains):
        raise ValueError(f"from 1 to {MAX_DOMAINS} different domains are needed")
    known = labels.select(F.col(id_col), domain.alias("domain")).where(F.col("domain").isin(domains))
    sample = labelled_sample(texts_of(docs, id_col, text_col), known, ["domain"], max_rows, id_col)

    def make():
        def each(batch: pa.RecordBatch):
            for part, texts in slices(batch, budget=1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r.tobytes() for r in trigram_features(texts)], pa.binary())], names=["doc_id", "domain", "x"])

        return each

    rows = map_arrow(sample.select("doc_id", "text", "domain"), make, "doc_id long, domain string, x binary").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), dtype=np.float32).reshape(-1, WIDTH)[order]
    number = {d: i for i, d in enumerate(domains)}
    return fit(x, np.array([number[d] for d in rows.column("domain").to_pylist()], dtype=np.int64)[order], domains)


def memberships(df: DataFrame, model: Softmax, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens (words between white space), p array<double> (by domain) of each row."""

    def make():
        def each(batch: pa.RecordBatch):
            for part, texts in slices(batch, budget=1 << 20):
                for i in range(0, len(texts), 512):
                    p = model.posterior(trigram_features(texts[i : i + 512]))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(i, 512), pa.array([len(t.encode().split()) for t in texts[i : i + 512]], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))],
                        names=["doc_id", "n_tokens", "p"],
                    )

        return each

    return map_arrow(texts_of(df, id_col, text_col), make, "doc_id long, n_tokens long, p array<double>")


def _rate(start: float, history: list[list[float]]) -> Column:
    """A row's rate after these steps (each a number for each domain), from its posterior p."""
    rate = F.lit(float(start))
    if not history:
        return rate
    steps = F.array(*[F.array(*[F.lit(float(g)) for g in step]) for step in history])
    return F.aggregate(steps, rate, lambda r, step: F.greatest(F.lit(0.0), r - F.aggregate(F.zip_with(F.col("p"), step, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)))


@dataclass
class Mix:
    start: float
    history: list[list[float]]
    totals: np.ndarray  # expected tokens by domain at these rates
    targets: np.ndarray
    error: float = 0.0  # sum of what totals miss, over that of the targets

    def rate(self) -> Column:
        return _rate(self.start, self.history)


def largest_budget(members: DataFrame, targets: list[float]) -> float:
    """The share of all tokens up to which no domain would have to give more expected tokens than it has: then the scarcest stays whole and others are thinned."""
    k = len(targets)
    row = members.agg(F.sum("n_tokens"), *[F.sum(F.col("n_tokens") * F.col("p")[i]) for i in range(k)]).first()
    tokens = float(row[0] or 0)
    return min([1.0] + [(row[i + 1] or 0.0) / tokens / (targets[i] / sum(targets)) for i in range(k) if targets[i] > 0]) if tokens else 1.0


def solve(members: DataFrame, targets: list[float], budget: float, iterations: int = 40, tolerance: float = 1e-9) -> Mix:
    """Rates for which domain d gets targets[d] / sum(targets) * budget expected tokens. budget: a share of all tokens.

    members: (n_tokens, p), read once an iteration; store it first. Targets that no rates reach leave an error above
    tolerance: it is in the result, and a warning says so.
    """
    k = len(targets)
    n, p = F.col("n_tokens"), [F.col("p")[i] for i in range(k)]
    tokens = float(members.agg(F.sum(n)).first()[0] or 0)
    t = np.asarray(targets, dtype=np.float64) / sum(targets) * budget * tokens
    if not tokens:
        return Mix(budget, [], np.zeros(k), t)
    history: list[list[float]] = []
    step, last = 1.0, np.inf
    while True:
        sums = [F.sum(n * F.col("r") * p[i]) for i in range(k)]
        curvature = [F.sum(F.when(F.col("r") > 0, n * p[i] * p[j])) for i in range(k) for j in range(i, k)]
        row = members.select("n_tokens", "p", _rate(budget, history).alias("r")).agg(*[c.alias(f"_{i}") for i, c in enumerate(sums + curvature)]).first()
        totals = np.array([x or 0.0 for x in row[:k]])
        error = float(np.abs(totals - t).sum() / t.sum())
        if error < tolerance or len(history) == iterations:
            if error >= tolerance:
                warnings.warn(f"rates miss the targets by {error:.3g} of their tokens after {iterations} iterations", RuntimeWarning, stacklevel=2)
            return Mix(budget, history, totals, t, error)
        step = step / 2 if error > last * 1.2 else min(1.0, step * 1.5)
        last = error
        gram = np.zeros((k, k))
        gram[np.triu_indices(k)] = [x or 0.0 for x in row[k:]]
        gram += np.triu(gram, 1).T
        history.append((step * np.linalg.solve(gram + 1e-10 * max(np.trace(gram), 1e-300) * np.eye(k), totals - t)).tolist())


def mix(df: DataFrame, model: Softmax, targets: list[float], budget: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Mix]:
    """(doc_id, n_tokens, p, rate) of each row, and the solution. budget: a share of all tokens; none: the largest (largest_budget)."""
    members = pin(memberships(df, model, id_col, text_col))
    solution = solve(members, targets, largest_budget(members, targets) if budget is None else budget)
    return members.withColumn("rate", solution.rate()), solution


def realised(members: DataFrame, solution: Mix) -> np.ndarray:
    """Expected tokens by domain of what realise keeps: a rate above 1 counts as 1."""
    rate = F.least(F.lit(1.0), solution.rate())
    row = members.agg(*[F.sum(F.col("n_tokens") * rate * F.col("p")[i]).alias(f"_{i}") for i in range(len(solution.targets))]).first()
    return np.array([x or 0.0 for x in row])


def realise(df: DataFrame, model: Softmax, solution: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, each kept with probability min(1, rate) by the hash of its text: copies fare alike.

    The rate comes from the text and the solution alone, so no join is needed and rows pass through in place.
    """
    names = df.columns
    history = np.asarray(solution.history, dtype=np.float64).reshape(-1, len(model.domains))

    def make():
        def each(batch: pa.RecordBatch):
            texts = ["" if t is None else t for t in batch.column(len(names)).to_pylist()]
            keep = np.zeros(len(texts), dtype=bool)
            chance = (batch.column(len(names) + 1).to_numpy(zero_copy_only=False).astype(np.uint64) >> np.uint64(11)) / float(1 << 53)
            for i in range(0, len(texts), 256):
                p = model.posterior(trigram_features(texts[i : i + 256]))
                rate = np.full(len(p), solution.start)
                for step in history:
                    rate = np.maximum(0.0, rate - p @ step)
                keep[i : i + 256] = chance[i : i + 256] < rate
            yield batch.select(list(range(len(names)))).filter(pa.array(keep))

        return each

    text = F.col(text_col).cast("string")
    return map_arrow(df.select(*[F.col(f"`{c}`") for c in names], text.alias("_cairn_text"), F.xxhash64(F.coalesce(text, F.lit("")), F.lit(11)).alias("_cairn_chance")), make, df.schema)
