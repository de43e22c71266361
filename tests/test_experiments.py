"""The experiments end to end on small cohorts."""

import json

import pytest

from cairn.plans import cli


def run(spark, tmp_path, df, name, *options):
    path = str(tmp_path / "cohort.parquet")
    df.write.mode("overwrite").parquet(path)
    out = str(tmp_path / "out")
    assert cli.main(["--data", path, "--experiment", name, "--output-dir", out, "--checkpoint-dir", str(tmp_path / "stages"), *options], spark) == 0
    return lambda t: spark.read.csv(f"{out}/{name}_{t}", header=True, inferSchema=True)


def test_heatmap(spark, tmp_path):
    df = spark.createDataFrame([(i, "Buscada positivo" if i < 6 else "Buscada negativo", "Sí" if i < 6 else "No" if i < 10 else "Missing", "Mujer" if i < 6 else "Hombre", "Sí" if i < 6 else "No", "TVP" if i % 2 else "EP", "Caucásica" if i % 3 else "Asiática", 40 + i) for i in range(12)], "id_pacie long, ana_dura string, alt_target string, sexo string, fr_cance string, sin_tvp_ string, raza string, edad long")
    table = run(spark, tmp_path, df, "categorical_association", "--association-max-columns", "5", "--association-top-k", "4", "--association-target-column", "alt_target", "--association-target-valid-labels", "Sí", "No")
    assert table("top_pairs").count() == 4 and "alt_target" in table("matrix").columns


@pytest.fixture(scope="module")
def contrast_cohort(spark):
    return spark.createDataFrame([(i, "Buscada positivo" if i < 6 else "Buscada negativo", "Homocigoto" if i < 6 else "Heterocigoto" if i < 10 else "Missing", "Mujer" if i % 2 == 0 else "Hombre", "Yes" if i % 3 else "No", "High" if i < 7 else "Low", f"2020-01-{i + 1:02d}") for i in range(12)], "id_pacie long, ana_dura string, alt_target string, sexo string, fr_history string, lab_band string, event_date string")


def test_contrast_and_resume(spark, tmp_path, contrast_cohort):
    options = ["--contrast-target-column", "alt_target", "--contrast-target-valid-labels", "Homocigoto", "Heterocigoto", "--contrast-max-feature-cardinality", "3", "--contrast-min-support", "0.2"]
    first = run(spark, tmp_path, contrast_cohort, "contrast", *options)("rules").count()
    assert first > 0
    assert len(list(next((tmp_path / "stages").iterdir()).glob("0*.parquet"))) == 4
    assert run(spark, tmp_path, contrast_cohort, "contrast", *options, "--resume")("rules").count() == first


def test_explorer(spark, tmp_path, contrast_cohort):
    rules = run(spark, tmp_path, contrast_cohort, "association_explorer", "--association-rules-min-support", "0.2", "--association-rules-max-feature-cardinality", "4", "--association-rules-max-features", "6", "--association-rules-top-k", "5", "--association-rules-filter-column", "alt_target", "--association-rules-target-column", "alt_target", "--association-rules-target-valid-labels", "Homocigoto", "Heterocigoto")("rules").collect()
    assert 0 < len(rules) <= 5
    assert all("alt_target:" in r["antecedent"] + r["consequent"] and "event_date" not in r["antecedent"] + r["consequent"] for r in rules)


def test_bayesian_and_edas(spark, tmp_path, contrast_cohort):
    table = run(spark, tmp_path, contrast_cohort, "bayesian", "--bayesian-target-column", "alt_target", "--bayesian-target-valid-labels", "Homocigoto", "Heterocigoto")
    assert {r["grp"] for r in table("conditional_probability").collect()} == {"Mujer", "Hombre"}
    assert run(spark, tmp_path, contrast_cohort, "edas", "--edas-column", "ID_PACIE", "--edas-bins", "3")("histogram").count() == 3


def test_clustering_with_rules(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), float(i % 3), float(i // 3 % 4), "Sí" if i % 2 == 0 else "No", "Buscada positivo" if i % 5 == 0 else "No buscada", None) for i in range(24)], "id_pacie long, feature_a double, feature_b double, feature_c double, fr_cance string, ana_dura string, all_missing double")
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"default": "other", "rules": [{"color": "cancer", "var": "fr_cance", "eq": "Sí"}, {"color": "positive_study", "all": [{"var": "ana_dura", "eq": "Buscada positivo"}]}]}))
    out = run(spark, tmp_path, df, "clustering", "--clustering-max-samples", "20", "--clustering-color-rules-json", str(path))("coordinates")
    assert {"umap_dimension_1", "umap_dimension_2", "cluster"} <= set(out.columns)
    assert out.count() == 20 and {r["color_group"] for r in out.collect()} <= {"cancer", "positive_study", "other"}
    csv = tmp_path / "points.csv"
    csv.write_text("id_pacie,umap_dimension_1,umap_dimension_2,cluster,fr_cance\n1,0.5,1.5,0,Sí\n2,0.1,0.2,1,No\n")
    page = cli.recolor_main(["--umap-csv", str(csv), "--color-rules-json", str(path), "--output-html", str(tmp_path / "r.html")], spark)
    assert "cancer" in page.read_text()


def score_cohort(spark, unlabelled):
    rows = []
    for i in range(60 if unlabelled else 40):
        target = "Buscada positivo" if i < 20 else "Buscada negativo" if i < 40 else None if i < 50 else "No buscada"
        good = i % 40 < 20
        rows.append((i, target, 72 + i if good else 38 + i, 10.8 if good else 13.4, 1.4 if good else 0.3, "Hombre" if good else "Mujer", "Sí" if good else "No", "Sí" if good else "No", 2.0 if good else 0.0, f"2020-01-{i % 28 + 1:02d}"))
    return spark.createDataFrame(rows, "id_pacie long, ana_dura string, edad long, ana_hemo double, ddvalmcg double, sexo string, fr_cance string, fr_inmov string, fr_tvp_p double, event_date string")


OPTIONS = ["--score-cv-splits", "3", "--score-max-feature-cardinality", "4", "--score-top-features", "5", "--score-feature-strategy", "compare", "--score-xgboost-estimators", "3"]


def test_score(spark, tmp_path):
    table = run(spark, tmp_path, score_cohort(spark, False), "score", *OPTIONS)
    patients = table("patient_scores")
    assert patients.count() == 40 and {"automatic_score_integer_score", "association_score_integer_score"} <= set(patients.columns)
    metrics = {r["model"]: r for r in table("metrics").collect()}
    assert metrics["automatic_score"]["auc"] == 1.0 and metrics["association_score"]["rule"] == "<=" and {"logistic", "xgboost"} <= set(metrics)


def test_screening(spark, tmp_path):
    table = run(spark, tmp_path, score_cohort(spark, True), "score_screening", *OPTIONS)
    scored = table("screening_scores")
    assert scored.count() == 20 and {r["ana_dura"] for r in scored.collect()} == {"Missing", "No buscada"}


def test_permutation(spark, tmp_path):
    df = score_cohort(spark, False)
    out = run(spark, tmp_path, df, "permutation", "--permutation-estimators", "3")("importance")
    assert not {"sexo", "edad", "id_pacie"} & {r["feature"] for r in out.collect()}


def test_options_match_the_interface():
    flags = [a for a in cli.parser()._actions if a.dest != "help"]
    assert len(flags) == 69 - 1 + (1 if any(a.dest == "resume" for a in flags) else 0)


def test_curate_command(spark, tmp_path):
    from tests.test_operators import workbook

    spark.createDataFrame([(1, "Otro", "x")], "id_pacie long, sexo string, ana_dura string").write.parquet(str(tmp_path / "i.parquet"))
    (tmp_path / "s.xlsx").write_bytes(workbook([["sexo", "Sex", "", ""]]))
    args = ["--input-parquet", str(tmp_path / "i.parquet"), "--spec-xlsx", str(tmp_path / "s.xlsx"), "--output-parquet", str(tmp_path / "o.parquet"), "--report-json", str(tmp_path / "r.json")]
    with pytest.raises(ValueError, match="invalid categorical values"):
        cli.curate_main(args, spark)
    assert spark.read.parquet(str(tmp_path / "o.parquet")).count() == 1
    assert cli.curate_main([*args, "--allow-validation-issues"], spark)["hard_failures"]
