"""The experiments: each takes a cleaned cohort and options, and returns named tables (and charts); main writes them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from types import SimpleNamespace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn import presets
from cairn.functions.ranks import hash_rank
from cairn.operators import assoc, clean, cluster, explain, features, metrics, patterns, profile, rules, sample, score, screening
from cairn.plans.checkpoint import Store


@dataclass
class Result:
    """Tables by name, charts by name, and one-line notes."""

    tables: dict[str, DataFrame]
    charts: dict[str, Mapping] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)


def with_id(df: DataFrame) -> tuple[DataFrame, str]:
    """df and its identifier; without one, sample_index 0 .. n - 1 by a deterministic order of the rows' hashes."""
    if presets.ID_COLUMN in df.columns:
        return df, presets.ID_COLUMN
    order = F.md5(F.concat_ws("|", *[F.coalesce(clean.quoted(c).cast("string"), F.lit("\0")) for c in df.columns]))
    ranked = hash_rank(df, order, F.lit(0), name="sample_index")
    return ranked.withColumn("sample_index", F.col("sample_index") - 1), "sample_index"


def edas(df: DataFrame, o: SimpleNamespace) -> Result:
    column = clean.resolve_column(df, o.edas_column)
    tables: dict[str, DataFrame] = {}
    charts = {}
    if o.edas_analysis in ("stats", "both"):
        tables["stats"] = profile.five_numbers(df, column)
    if o.edas_analysis in ("histogram", "both"):
        tables["histogram"] = profile.histogram(df, column, o.edas_bins, o.edas_range_min, o.edas_range_max).orderBy("bin")
        tables["range"] = profile.range_counts(df, column, o.edas_range_min, o.edas_range_max)
        bars = tables["histogram"].collect()
        if not bars:
            raise ValueError(f"Column '{column}' has no numbers in the range")
        charts["histogram"] = {"kind": "bars", "x": [f"{r['left']:g} to {r['right']:g}" for r in bars], "y": [r["n"] for r in bars]}
    return Result(tables, charts)


def _sampled(df: DataFrame, id_column: str, target: str | None, labels: list[str], most: int, largest_remainder: bool = False) -> DataFrame:
    out = screening.labelled(df, target, labels) if target else df
    if largest_remainder:
        return sample.largest_remainder_sample(out, target, most, id_column)
    return sample.cap(out, id_column, most)


def _profile(df: DataFrame, columns: list[str]) -> list[tuple[str, int, float]]:
    return [(r["column"], r["cardinality"], r["missing_rate"]) for r in profile.column_profile(df, columns).collect()]


def categorical_association(df: DataFrame, o: SimpleNamespace) -> Result:
    df, id_column = with_id(df)
    target = o.association_target_column
    rows = screening.labelled(df, target, o.association_target_valid_labels)
    text = [c for c in clean.columns_of(rows, "text") if c not in (id_column, target)]
    first = target if o.association_include_target and target in rows.columns else None
    chosen = sample.pick_features(_profile(rows, text), None, o.association_max_columns, first)
    rows = clean.fill_text(_sampled(rows, id_column, None, [], o.association_max_samples).select(*map(clean.quoted, chosen)))
    matrix = assoc.cramers_v_matrix(rows, chosen).persist()
    pairs = assoc.top_pairs(matrix.where("variable_a < variable_b"), o.association_top_k)
    return Result({"matrix": assoc.matrix_wide(matrix, chosen), "top_pairs": pairs}, {"top_pairs": {"kind": "bars", "x": [f"{r[0]} - {r[1]}" for r in pairs.collect()], "y": [r[2] for r in pairs.collect()]}})


def _itemset_stages(df: DataFrame, id_column: str, chosen: list[str], most_samples: DataFrame, support: float, size: int, store: Store) -> tuple[DataFrame, DataFrame]:
    prepared = store.get("01_prepared_sample", lambda: most_samples.select(*[clean.quoted(c) for c in dict.fromkeys([id_column, *chosen])]))
    encoded = store.get("02_encoded_transactions", lambda: patterns.items(prepared, chosen).select(id_column, "items"))
    frequent = store.get("03_frequent_itemsets", lambda: patterns.frequent_itemsets(encoded, support, size))
    return encoded, frequent


def association_explorer(df: DataFrame, o: SimpleNamespace) -> Result:
    df, id_column = with_id(df)
    target = o.association_rules_target_column
    rows = _sampled(df, id_column, target, o.association_rules_target_valid_labels, o.association_rules_max_samples)
    text = [c for c in clean.columns_of(rows, "text") if c != id_column]
    first = o.association_rules_filter_column
    if first and first not in rows.columns:
        raise ValueError(f"Filter column '{first}' not found")
    chosen = sample.pick_features(_profile(rows, text), o.association_rules_max_feature_cardinality, o.association_rules_max_features, first)
    if not chosen:
        raise ValueError("No categorical feature qualifies")
    store = Store(df.sparkSession, o.checkpoint_dir, "association", "explorer", {k: v for k, v in vars(o).items() if k.startswith("association_rules")} | {"data": o.data, "columns": chosen}, o.resume)
    _, frequent = _itemset_stages(df, id_column, chosen, rows, o.association_rules_min_support, o.association_rules_max_rule_size, store)
    found = store.get("04_rules", lambda: patterns.association_rules(frequent, o.association_rules_min_confidence))
    kept = patterns.filter_rules(found, o.association_rules_min_lift, o.association_rules_max_rule_size, first, o.association_rules_filter_side)
    return Result({"rules": patterns.rules_as_text(patterns.top_rules(kept, o.association_rules_sort_metric, o.association_rules_top_k))})


def contrast(df: DataFrame, o: SimpleNamespace) -> Result:
    df, id_column = with_id(df)
    target = o.contrast_target_column
    rows = clean.fill_text(_sampled(df, id_column, target, o.contrast_target_valid_labels, o.contrast_max_samples, True))
    features_ = [c for c in rows.columns if c not in (id_column, target)]
    chosen = sample.pick_features(_profile(rows, features_), o.contrast_max_feature_cardinality, o.contrast_max_features)
    if not chosen:
        raise ValueError("No feature qualifies for contrast mining")
    store = Store(df.sparkSession, o.checkpoint_dir, "contrast", "mining", {k: v for k, v in vars(o).items() if k.startswith("contrast") and k != "contrast_workers"} | {"data": o.data}, o.resume)
    _, frequent = _itemset_stages(df, id_column, [target, *chosen], rows, o.contrast_min_support, o.contrast_max_rule_size, store)
    found = store.get("04_target_rules", lambda: patterns.target_rules(frequent, target, o.contrast_min_confidence, o.contrast_top_k_per_outcome))
    return Result({"rules": patterns.rules_as_text(found).orderBy(F.desc("lift"), F.desc("confidence"), F.desc("support"), "antecedent")})


def bayesian(df: DataFrame, o: SimpleNamespace) -> Result:
    rows = screening.labelled(df, o.bayesian_target_column, o.bayesian_target_valid_labels)
    back = {new: old for old, new in presets.SEX_RECODE.items()}
    return Result({"conditional_probability": assoc.conditional_table(rows, o.bayesian_group_column, o.bayesian_target_column, undo=back).orderBy("grp", "target")})


def clustering(df: DataFrame, o: SimpleNamespace) -> Result:
    df, id_column = with_id(df)
    rows = sample.cap(df, id_column, o.clustering_max_samples).persist()
    numbers = [c for c in clean.columns_of(rows, "numeric") if c != id_column]
    numbers = [c for c in clean.drop_all_null(rows.select(*map(clean.quoted, numbers))).columns]
    if not numbers:
        raise ValueError("No numeric column to cluster by")
    filled = features.impute_median(rows.select(id_column, *map(clean.quoted, numbers)), numbers).persist()
    scaled = features.standardize(filled, numbers).persist()
    own = cluster.agglomerative(scaled, id_column, numbers, o.clustering_n_clusters, o.clustering_metric).persist()
    placed = rows.join(own, id_column).join(cluster.layout(scaled, id_column, numbers, o.clustering_n_neighbors, o.clustering_min_dist, o.clustering_metric), id_column)
    label = rules.label_rules(_rules_of(o.clustering_color_rules_json), placed.columns) if o.clustering_color_rules_json else F.col("cluster").cast("string")
    points = placed.withColumn("color_group", label).select(id_column, "umap_dimension_1", "umap_dimension_2", "cluster", "color_group", *[clean.quoted(c) for c in rows.columns if c != id_column])
    means = cluster.profile(filled.join(own, id_column), "cluster", numbers).orderBy("cluster")
    drawn = points.select("umap_dimension_1", "umap_dimension_2", "color_group").collect()
    return Result({"coordinates": points, "profile": means}, {"projection": {"kind": "points", "x": [r[0] for r in drawn], "y": [r[1] for r in drawn], "color": [r[2] for r in drawn]}})


def _rules_of(path: str) -> Mapping:
    from cairn.sources.readers import load_rules

    return load_rules(path)


_NOT_FEATURES = ("sexo", "edad", "edadC", "sex")


def permutation(df: DataFrame, o: SimpleNamespace) -> Result:
    df, id_column = with_id(df)
    rows = screening.binary(df, o.permutation_target_column, o.permutation_positive_label, o.permutation_negative_label)
    rows = sample.stratified_cap(rows, o.permutation_target_column, o.permutation_max_samples, id_column)
    frame, columns = features.mixed_frame(rows, [id_column, o.permutation_target_column, "y", *_NOT_FEATURES], [id_column, "y"])
    return Result({"importance": explain.permutation_importance(frame, columns, "y", id_column, o.permutation_max_splits, o.permutation_repeats, o.permutation_estimators)})


def _strategies(df: DataFrame, id_column: str, o: SimpleNamespace) -> tuple[DataFrame, dict[str, tuple[features.Frame, score.Strategy, DataFrame]]]:
    """Labelled rows, and for each wanted strategy how its frame is made, what was fitted, and the frame."""
    target = o.score_target_column
    rows = screening.binary(df, target, o.score_positive_label, o.score_negative_label)
    rows = sample.stratified_cap(rows, target, o.score_max_samples, id_column).persist()
    out = {}
    wanted = ("automatic", "association") if o.score_feature_strategy == "compare" else (o.score_feature_strategy,)
    for name in wanted:
        frame, made = _frame(rows, name, id_column, target, o)
        fitted = score.fit_strategy("automatic_score" if name == "automatic" else "association_score", frame, made.columns, id_column, "y", o.score_cv_splits, o.score_top_features, o.score_min_sensitivity, o.score_min_feature_prevalence, negative=name == "association")
        out[name] = (made, fitted, frame)
    return rows, out


def _guided(df: DataFrame) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in rules.guided_rules(df).items()])


def _frame(rows: DataFrame, name: str, id_column: str, target: str, o: SimpleNamespace) -> tuple[DataFrame, features.Frame]:
    if name == "association":
        made = features.Frame({}, list(rules.guided_rules(rows)))
        return made.apply(_guided(rows), [id_column, target, "y"]), made
    made = features.learn_frame(rows, [id_column, target, "y"], o.score_max_feature_cardinality, o.score_numeric_bins)
    return made.apply(rows, [id_column, target, "y"]), made


def _card_table(spark, fitted: score.Strategy) -> DataFrame:
    return spark.createDataFrame([{"strategy": fitted.name, **r} for r in fitted.card], "strategy string, component string, coefficient double, odds_ratio double, prevalence double, points int")


def _benchmarks(frame: DataFrame, made: features.Frame, id_column: str, o: SimpleNamespace) -> dict[str, DataFrame]:
    """Out-of-fold probabilities of the benchmark models by name."""
    k = sample.fold_count(sample.class_counts(frame, "y"), o.score_cv_splits)
    split = sample.folds(frame, "y", k, id_column).persist()
    out: dict[str, DataFrame] = {}
    for name in ("logistic", "xgboost") if o.score_benchmark_model == "both" else (o.score_benchmark_model,):
        if name == "xgboost":
            _, scored = score.boosted_out_of_fold(split, made.columns, "y", [id_column, "y"], k, o.score_xgboost_estimators)
            out[name] = scored.drop("fold")
            continue
        for i in range(k):
            train, test = split.where(F.col("fold") != i), split.where(F.col("fold") == i)
            part = score.fit_logistic(train, made.columns, "y").probability(test, [id_column, "y"])
            out[name] = part if name not in out else out[name].unionByName(part)
        out[name] = out[name].persist()
    return out


def risk_score(df: DataFrame, o: SimpleNamespace) -> Result:
    df, id_column = with_id(df)
    target, spark = o.score_target_column, df.sparkSession
    _, fitted = _strategies(df, id_column, o)
    positive = F.col("y") == 1
    rows, tables, charts, exports = [], {}, {}, []
    cards = profiles = summaries = None
    for made, s, frame in fitted.values():
        rows.append((s.name, s.auc, "integer score", s.threshold, "<=" if s.at_most else ">=", s.sensitivity, s.specificity))
        exports.append(score.patient_scores(frame, s, id_column, target, o.score_positive_label))
        named = metrics.confusion_profile(s.scored, "score", positive, s.at_most).withColumn("strategy", F.lit(s.name)).withColumn("selected", F.abs(F.col("threshold") - s.threshold) < 1e-9)
        profiles = named if profiles is None else profiles.unionByName(named)
        card = _card_table(spark, s)
        cards = card if cards is None else cards.unionByName(card)
        summary = metrics.score_summary(s.scored.withColumn("label", F.when(positive, o.score_positive_label).otherwise(o.score_negative_label)), "score", "label").withColumn("strategy", F.lit(s.name))
        summaries = summary if summaries is None else summaries.unionByName(summary)
        curve = metrics.roc_curve(s.scored, "score", positive, s.at_most).orderBy("fpr", "tpr").collect()
        charts[f"roc_{s.name}"] = {"kind": "points", "x": [r["fpr"] for r in curve], "y": [r["tpr"] for r in curve]}
    made, _, frame = fitted.get("automatic") or next(iter(fitted.values()))
    for name, scored in _benchmarks(frame, made, id_column, o).items():
        at = metrics.threshold_at(metrics.roc_curve(scored, "probability", positive), o.score_min_sensitivity).first()
        rows.append((name, metrics.auc(scored, "probability", positive).first()[0], "probability", at["threshold"], ">=", at["sensitivity"], at["specificity"]))
    tables["metrics"] = spark.createDataFrame(rows, "model string, auc double, method string, threshold double, rule string, sensitivity double, specificity double")
    tables |= {"points": cards, "summary": summaries, "patient_scores": score.merge_exports(exports, id_column, target), "threshold_performance": profiles.orderBy("strategy", "threshold")}
    return Result(tables, charts)


def score_screening(df: DataFrame, o: SimpleNamespace) -> Result:
    df, id_column = with_id(df)
    target, positive = o.score_target_column, F.col("y") == 1
    waiting = screening.to_screen(df, target, o.screening_labels)
    if waiting.isEmpty():
        raise ValueError(f"No rows with target labels {o.screening_labels}")
    _, fitted = _strategies(df, id_column, o)
    exports, flags = [], {}
    for name, (made, s, _) in fitted.items():
        # New rows are binned with the training edges; values outside count to the outer bins.
        frame = made.apply(_guided(waiting) if name == "association" else waiting, [id_column, target], clamp=True)
        exports.append(score.patient_scores(frame, s, id_column, target, o.score_positive_label))
        flags[f"{s.name}_candidates"] = F.col(f"{s.name}_predicted_positive_at_rule_out_threshold")
    made, _, frame = fitted.get("automatic") or next(iter(fitted.values()))
    ready = made.apply(_guided(waiting) if "automatic" not in fitted else waiting, [id_column, target], clamp=True)
    for name, scored in _benchmarks(frame, made, id_column, o).items():
        at = metrics.threshold_at(metrics.roc_curve(scored, "probability", positive), o.score_min_sensitivity).first()["threshold"]
        if name == "logistic":
            p = score.fit_logistic(frame, made.columns, "y").probability(ready, [id_column, target])
        else:
            p = score.tree_probability(score.boosted_trees(frame, made.columns, "y", o.score_xgboost_estimators), ready, [id_column, target])
        exports.append(screening.by_probability(p.withColumnRenamed("probability", f"{name}_probability"), f"{name}_probability", at, name, o.score_positive_label))
        flags[f"{name}_candidates"] = F.col(f"{name}_predicted_positive")
    merged = score.merge_exports(exports, id_column, target).persist()
    return Result({"screening_scores": merged, "summary": screening.summary(merged, target, flags, o.screening_labels)})


EXPERIMENTS: dict[str, Callable[[DataFrame, Any], Result]] = {
    "permutation": permutation,
    "contrast": contrast,
    "clustering": clustering,
    "categorical_association": categorical_association,
    "association_explorer": association_explorer,
    "bayesian": bayesian,
    "score": risk_score,
    "score_screening": score_screening,
    "edas": edas,
}
