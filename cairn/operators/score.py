"""Integer point scores: balanced logistic regression to a card of points, applied and evaluated out of fold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import boost, metrics, sample
from cairn.operators.clean import quoted
from cairn.operators.features import vocabulary


@dataclass(frozen=True)
class Logistic:
    """Coefficients by component, and the intercept."""

    coefficients: dict[str, float]
    intercept: float
    columns: tuple[str, ...]

    def probability(self, frame: DataFrame, keep: Sequence[str]) -> DataFrame:
        """keep and probability of each row: a sum of lookups in a literal map, without a join."""
        return frame.select(*[quoted(c) for c in keep], (1 / (1 + F.exp(-(self.linear() + self.intercept)))).alias("probability"))

    def linear(self) -> Column:
        return _lookup_sum(self.coefficients, self.columns)


def _lookup_sum(weights: dict[str, float], columns: Sequence[str]) -> Column:
    out = F.lit(0.0)
    for c in columns:
        own = {k: v for k, v in weights.items() if k.startswith(f"{c}_")}
        if own:
            table = F.create_map(*[x for k, v in own.items() for x in (F.lit(k), F.lit(float(v)))])
            out = out + F.coalesce(F.try_element_at(table, F.concat(F.lit(f"{c}_"), quoted(c))), F.lit(0.0))
    return out


#: Different combinations of features that a logistic fit sums on the driver: some MB, as a combination has one number a feature.
LOCAL_PATTERNS = 20_000


def _newton_sums(batches, w: np.ndarray, k: int, weight_p: float, weight_n: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature at w of batches of (components of a combination, positives, negatives), a few MB of dense rows at a time."""
    g, h = np.zeros(k), np.zeros((k, k))
    rows = max(1, (1 << 19) // k)
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            piece = batch.slice(start, rows)
            lists, p, n = piece.column(0), *(piece.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
            x = np.zeros((piece.num_rows, k))
            x[np.repeat(np.arange(piece.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)] = 1
            x[:, -1] = 1
            q = 1 / (1 + np.exp(-(x @ w)))
            g += x.T @ (weight_n * n * q - weight_p * p * (1 - q))
            h += x.T @ (x * ((weight_p * p + weight_n * n) * q * (1 - q))[:, None])
    return g, h


def fit_logistic(frame: DataFrame, columns: Sequence[str], outcome: str, c: float = 1.0, iterations: int = 50, drop_binary: bool = True) -> Logistic:
    """L2-penalised logistic regression with classes weighted to equal sums; the intercept is penalised like the rest.

    Rows are counted by their combination of features first, and Newton steps sum over these. Up to LOCAL_PATTERNS of them
    the sums are made on the driver, beyond in a job a step over the partitions; the components are as many as the features
    have values.
    """
    vocab = [r["component"] for r in vocabulary(frame, columns, drop_binary).select("component").orderBy("component").collect()]
    place = {name: i for i, name in enumerate(vocab)}
    k = len(vocab) + 1
    table = F.create_map(*[x for n, i in place.items() for x in (F.lit(n), F.lit(i))]) if place else F.create_map(F.lit(""), F.lit(0))
    each = F.array_compact(F.array(*[F.try_element_at(table, F.concat(F.lit(f"{n}_"), quoted(n))) for n in columns])) if columns else F.array().cast("array<int>")
    rows = frame.select(F.array_sort(each).alias("at"), quoted(outcome).cast("int").alias("y")).groupBy("at").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    patterns = rows.persist()
    totals = patterns.agg(F.sum("p"), F.sum("n")).first()
    pos, neg = float(totals[0] or 0), float(totals[1] or 0)
    if not pos or not neg:
        patterns.unpersist()
        raise ValueError("Both classes are needed to fit a model")
    weight_p, weight_n = (pos + neg) / (2 * pos), (pos + neg) / (2 * neg)
    w = np.zeros(k)

    sums = partial(_newton_sums, k=k, weight_p=weight_p, weight_n=weight_n)
    few = patterns.limit(LOCAL_PATTERNS + 1).toArrow()
    local = few.to_batches() if few.num_rows <= LOCAL_PATTERNS else None

    def step(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature, summed in each partition."""
        if local is not None:
            return sums(local, w)

        def part(batches):
            import pyarrow as pa

            g, h = sums(batches, w)
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary()), pa.array([h.tobytes()], pa.binary())], names=["g", "h"])

        got = patterns.mapInArrow(part, "g binary, h binary").collect()
        return sum(np.frombuffer(r["g"]) for r in got), sum(np.frombuffer(r["h"]).reshape(k, k) for r in got)

    for _ in range(iterations):
        g, h = step(w)
        delta = np.linalg.solve(c * h + np.eye(k), c * g + w)
        w = w - delta
        if np.abs(delta).max() < 1e-8:
            break
    patterns.unpersist()
    return Logistic({n: float(w[i]) for n, i in place.items()}, float(w[-1]), tuple(columns))


def points_card(model: Logistic, frame: DataFrame, top: int = 12, min_prevalence: float = 0.02, negative: bool = False, missing_suffix: str = "_Missing") -> list[dict]:
    """Components with a coefficient of the wanted sign, prevalence and no missing value, strongest first, as points: the coefficient over the least of them, rounded half to even, 1 at least."""
    prevalence = {r["component"]: r["prevalence"] for r in vocabulary(frame, model.columns).collect()}
    rows = [(n, b, prevalence.get(n, 0.0)) for n, b in model.coefficients.items() if not n.endswith(missing_suffix) and prevalence.get(n, 0.0) >= min_prevalence and (b < 0 if negative else b > 0)]
    rows.sort(key=lambda r: (-abs(r[1]), -r[2], r[0]))
    rows = rows[:top]
    if not rows:
        raise ValueError("No component qualifies for the score card")
    least = min(abs(b) for _, b, _ in rows)
    return [{"component": n, "coefficient": b, "odds_ratio": float(np.exp(b)), "prevalence": p, "points": max(1, int(np.rint(abs(b) / least)))} for n, b, p in rows]


def apply_card(frame: DataFrame, columns: Sequence[str], card: dict[str, int], keep: Sequence[str]) -> DataFrame:
    """keep and score: the points of a row's components."""
    return frame.select(*[quoted(c) for c in keep], _lookup_sum({k: float(v) for k, v in card.items()}, columns).cast("int").alias("score"))


def apply_card_long(long: DataFrame, card: DataFrame, by: str) -> DataFrame:
    """(by, score) from (by, component) rows and a (component, points) table: for cards that are data."""
    return long.join(F.broadcast(card), "component", "left").groupBy(by).agg(F.sum(F.coalesce("points", F.lit(0))).alias("score"))


@dataclass
class Strategy:
    """A fitted strategy: its card, threshold, metrics and out-of-fold scores (id, y, score, probability)."""

    name: str
    at_most: bool
    model: Logistic
    card: list[dict]
    scored: DataFrame
    auc: float
    threshold: float
    sensitivity: float
    specificity: float

    @property
    def points(self) -> dict[str, int]:
        return {r["component"]: r["points"] for r in self.card}


def fit_strategy(name: str, frame: DataFrame, columns: Sequence[str], id_column: str, outcome: str, folds: int = 5, top: int = 12, min_sensitivity: float = 0.9, min_prevalence: float = 0.02, negative: bool = False) -> Strategy:
    """Cards fitted on k - 1 folds score the other one; threshold and metrics come from these scores; the card from all rows."""
    k = sample.fold_count(sample.class_counts(frame, outcome), folds)
    split = sample.folds(frame, outcome, k, id_column).persist()
    parts = []
    for i in range(k):
        train, test = split.where(F.col("fold") != i), split.where(F.col("fold") == i)
        model = fit_logistic(train, columns, outcome)
        card = {r["component"]: r["points"] for r in points_card(model, train, top, min_prevalence, negative)}
        scored = apply_card(test, columns, card, [id_column, outcome, *columns])
        parts.append(scored.select(quoted(id_column), quoted(outcome), "score", (1 / (1 + F.exp(-(model.linear() + model.intercept)))).alias("probability")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.persist()
    positive = quoted(outcome) == 1
    at = metrics.threshold_at(metrics.roc_curve(out, "score", positive, negative), min_sensitivity, negative).first()
    area = metrics.auc(out, "score", positive, negative).first()[0]
    model = fit_logistic(split, columns, outcome)
    return Strategy(name, negative, model, points_card(model, split, top, min_prevalence, negative), out, area, at["threshold"], at["sensitivity"], at["specificity"])


def flag(c: Column, threshold: float, at_most: bool) -> Column:
    return (c <= threshold) if at_most else (c >= threshold)


def patient_scores(frame: DataFrame, strategy: Strategy, id_column: str, target: str, positive: str) -> DataFrame:
    """Id, target, points, probability, threshold, flag and label of each row by a fitted strategy."""
    p, label = strategy.name, flag(F.col("score"), strategy.threshold, strategy.at_most)
    scored = apply_card(frame, strategy.model.columns, strategy.points, [id_column, target, *strategy.model.columns])
    return scored.select(
        quoted(id_column), quoted(target), F.col("score").alias(f"{p}_integer_score"), (1 / (1 + F.exp(-(strategy.model.linear() + strategy.model.intercept)))).alias(f"{p}_logistic_probability"),
        F.lit(strategy.threshold).alias(f"{p}_threshold_for_min_sensitivity"), label.alias(f"{p}_predicted_positive_at_rule_out_threshold"),
        F.when(label, positive).otherwise(f"not_{positive}").alias(f"{p}_predicted_label_at_rule_out_threshold"),
    )


def merge_exports(exports: Sequence[DataFrame], id_column: str, target: str) -> DataFrame:
    """Full outer join of exports on id and target; null ids and null targets meet.

    In one shuffle, whatever their number: the exports' rows are put one below the other and gathered by key, and each
    row of an export meets each row of the others with its key. A key is one subject's: it has a few rows.
    """
    keys = [id_column, target]
    tagged = [e.select(*[quoted(c) for c in keys], F.lit(i).alias("_export"), F.struct(*[quoted(c) for c in e.columns if c not in keys], F.lit(i).alias("_")).alias(f"_{i}")) for i, e in enumerate(exports)]
    together = tagged[0]
    for t in tagged[1:]:
        together = together.unionByName(t, allowMissingColumns=True)
    met = together.groupBy(*[quoted(c) for c in keys]).agg(*[F.collect_list(f"_{i}").alias(f"_{i}") for i in range(len(exports))])
    for i in range(len(exports)):
        met = met.withColumn(f"_{i}", F.explode_outer(f"_{i}"))
    return met.select(*[quoted(c) for c in keys], *[F.col(f"_{i}")[c].alias(c) for i, e in enumerate(exports) for c in e.columns if c not in keys])


def boosted_trees(frame: DataFrame, columns: Sequence[str], outcome: str, trees: int = 80, depth: int = 3, rate: float = 0.08, subsample: float = 0.8, seed: int = 42) -> boost.Boosted:
    """Boosted trees over text, one value against the rest, and numbers, whose nulls go to a learnt side; subsample: the share of rows and of features by tree."""
    how = boost.Settings(trees, depth, rate, subsample, subsample, seed=seed)
    return boost.fit(frame, columns, [boost.Model(outcome, settings=how)], frame.columns).models[0]


def boosted_out_of_fold(split: DataFrame, columns: Sequence[str], outcome: str, keep: Sequence[str], k: int, trees: int = 80, depth: int = 3, rate: float = 0.08, subsample: float = 0.8, seed: int = 42) -> tuple[list[boost.Boosted], DataFrame]:
    """A model for each fold that it did not see, all grown in the same passes; and (keep, fold, probability) of each row by its fold's model. split has a column fold from 0 to k - 1."""
    how = boost.Settings(trees, depth, rate, subsample, subsample, seed=seed)
    fitted = boost.fit(split, columns, [boost.Model(outcome, i, how) for i in range(k)], [c for c in split.columns if c != "fold"], "fold", keep)
    return fitted.models, fitted.out_of_fold()


def tree_probability(model: boost.Boosted, frame: DataFrame, keep: Sequence[str]) -> DataFrame:
    return model.probability(frame, keep)
