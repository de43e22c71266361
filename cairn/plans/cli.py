"""Command lines: experiments, curation, and relabelling of exported coordinates."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from cairn import presets
from cairn.functions.stored import stored
from cairn.operators import clean, curate, rules
from cairn.plans.experiments import EXPERIMENTS
from cairn.plans.jobs import run_jobs
from cairn.sources import readers, sinks

_LIST: list[str] = []
# Options of the experiments with their defaults and choices.
OPTIONS: tuple[tuple, ...] = (
    ("permutation-max-samples", 2000), ("permutation-max-splits", 2), ("permutation-repeats", 1), ("permutation-estimators", 10),
    ("permutation-target-column", presets.TARGET), ("permutation-positive-label", presets.NEGATIVE), ("permutation-negative-label", presets.POSITIVE),
    ("contrast-max-samples", 300), ("contrast-target-column", presets.TARGET), ("contrast-target-valid-labels", _LIST), ("contrast-min-support", 0.05),
    ("contrast-min-confidence", 0.4), ("contrast-max-feature-cardinality", 12), ("contrast-max-features", 48), ("contrast-max-rule-size", 3),
    ("contrast-top-k-per-outcome", 5), ("contrast-workers", 2),
    ("clustering-max-samples", 1000), ("clustering-metric", "manhattan", ("euclidean", "manhattan", "cosine", "chebyshev")), ("clustering-n-clusters", 3),
    ("clustering-n-neighbors", 15), ("clustering-min-dist", 0.1), ("clustering-color-rules-json", None),
    ("association-max-samples", 5000), ("association-max-columns", 20), ("association-top-k", 20), ("association-include-target", True),
    ("association-target-column", presets.TARGET), ("association-target-valid-labels", _LIST),
    ("association-rules-max-samples", 5000), ("association-rules-min-support", 0.01), ("association-rules-min-confidence", 0.4), ("association-rules-min-lift", 1.0),
    ("association-rules-max-feature-cardinality", 12), ("association-rules-max-features", 24), ("association-rules-max-rule-size", 3), ("association-rules-top-k", 30),
    ("association-rules-sort-metric", "leverage", ("leverage", "lift", "confidence", "support")), ("association-rules-filter-column", None),
    ("association-rules-filter-side", "either", ("either", "antecedent", "consequent")), ("association-rules-target-column", None), ("association-rules-target-valid-labels", _LIST),
    ("bayesian-target-column", presets.TARGET), ("bayesian-group-column", "sexo"), ("bayesian-target-valid-labels", _LIST),
    ("score-target-column", presets.TARGET), ("score-positive-label", presets.POSITIVE), ("score-negative-label", presets.NEGATIVE), ("score-max-samples", 4000),
    ("score-max-feature-cardinality", 12), ("score-feature-strategy", "automatic", ("automatic", "association", "compare")), ("score-cv-splits", 5),
    ("score-benchmark-model", "both", ("logistic", "xgboost", "both")), ("score-top-features", 12), ("score-numeric-bins", 4), ("score-min-sensitivity", 0.9),
    ("score-min-feature-prevalence", 0.02), ("score-xgboost-estimators", 80), ("screening-labels", [presets.MISSING, presets.NOT_STUDIED]),
    ("edas-column", "DimeroD"), ("edas-analysis", "both", ("histogram", "stats", "both")), ("edas-bins", 10),
    ("output-dir", "."), ("checkpoint-dir", "out/checkpoints"),
)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairn", description="Mine a cohort table")
    p.add_argument("--data", required=True)
    p.add_argument("--experiment", required=True, choices=[*EXPERIMENTS, "all"])
    for name, default, *choices in OPTIONS:
        if isinstance(default, bool):
            p.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=default)
        elif isinstance(default, list):
            p.add_argument(f"--{name}", nargs="*", default=default)
        else:
            p.add_argument(f"--{name}", default=default, type=type(default) if default is not None else str, choices=choices[0] if choices else None)
    p.add_argument("--edas-range-min", type=float)
    p.add_argument("--edas-range-max", type=float)
    p.add_argument("--resume", action="store_true")
    return p


def session() -> SparkSession:
    return SparkSession.builder.appName("cairn").config("spark.scheduler.mode", "FAIR").getOrCreate()


def run_experiment(name: str, df: DataFrame, o: argparse.Namespace) -> str:
    """Run an experiment and write its tables, page and parameters. Returns the tables as LaTeX."""
    result = EXPERIMENTS[name](df, o)
    shown = []
    for table, frame in result.tables.items():
        sinks.write_csv(frame, f"{o.output_dir}/{name}_{table}")
        shown.append(sinks.latex(frame, f"{name}: {table}", f"tab:{name}_{table}", most=30))
    sinks.save_page(sinks.html_page(name, result.tables, result.charts), o.output_dir, name)
    sinks.write_json({k: v for k, v in vars(o).items() if k.startswith(name.split("_")[0]) or k in ("data", "experiment")}, f"{o.output_dir}/{name}_run.json", sort_keys=True)
    return "\n".join(shown)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one experiment, or all, contrast-workers of them at a time on one stored cohort; one that fails doesn't stop the others. Returns the number of failures."""
    o = parser().parse_args(argv)
    spark = spark or session()
    df = clean.clean_cohort(readers.load(spark, o.data))
    if o.experiment != "all":
        df = df.persist()
        print(run_experiment(o.experiment, df, o))
        df.unpersist()
        return 0
    cohort = stored(df, "cohort")
    outcomes = run_jobs(spark, {n: partial(run_experiment, n, cohort, o) for n in EXPERIMENTS if n != "edas"}, o.contrast_workers)
    for name, outcome in outcomes.items():
        print(outcome.value if outcome.error is None else f"{name} failed: {outcome.error}", file=sys.stderr if outcome.error else sys.stdout)
    return sum(outcome.error is not None for outcome in outcomes.values())


def curate_main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Curate a table by a specification; writes table and report, then fails on hard failures unless these are allowed."""
    p = argparse.ArgumentParser(prog="cairn-curate")
    for name in ("input-parquet", "spec-xlsx", "output-parquet", "report-json"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--id-column", default=presets.ID_COLUMN)
    p.add_argument("--target-columns", nargs="*", default=[presets.TARGET])
    p.add_argument("--filter-column")
    p.add_argument("--filter-allowed-values", nargs="*", default=[])
    p.add_argument("--allow-validation-issues", action="store_true")
    o = p.parse_args(argv)
    spark = spark or session()
    out, report = curate.curate(spark.read.parquet(o.input_parquet), readers.load_spec(spark, o.spec_xlsx), o.id_column, o.target_columns, o.filter_column, o.filter_allowed_values)
    sinks.write_parquet(out, o.output_parquet)
    report |= {"source_path": o.input_parquet, "output_path": o.output_parquet}
    sinks.write_json(report, o.report_json)
    if report["hard_failures"] and not o.allow_validation_issues:
        raise curate.ValidationError("; ".join(report["hard_failures"]))
    return report


def recolor_main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> Path:
    """Relabel exported coordinates by a rules file: a CSV and a page beside it."""
    p = argparse.ArgumentParser(prog="cairn-recolor")
    for name in ("umap-csv", "color-rules-json", "output-html"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--title", default="Projection")
    o = p.parse_args(argv)
    spark = spark or session()
    df = readers.load_coordinates(spark, o.umap_csv)
    out = df.withColumn("color_group", rules.label_rules(readers.load_rules(o.color_rules_json), df.columns))
    rows = out.collect()
    target = Path(o.output_html)
    target.parent.mkdir(parents=True, exist_ok=True)
    chart = {"kind": "points", "x": [r["umap_dimension_1"] for r in rows], "y": [r["umap_dimension_2"] for r in rows], "color": [r["color_group"] for r in rows]}
    target.write_text(sinks.html_page(o.title, {"groups": out.groupBy("color_group").count()}, {o.title: chart}), encoding="utf-8")
    sinks.write_csv(out, str(target.with_suffix("")) + "_recolored")
    return target


if __name__ == "__main__":
    sys.exit(main())
