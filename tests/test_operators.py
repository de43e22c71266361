"""Value-level tests of the operators on small tables."""

import io
import itertools
import json
import zipfile
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import quantiles, ranks
from cairn.operators import assoc, clean, cluster, curate, features, metrics, patterns, profile, rules, sample, score, screening
from cairn.operators.curate import SpecRow
from cairn.plans.checkpoint import Store, fingerprint
from cairn.sources import readers, sinks


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_cleaning(spark):
    df = spark.createDataFrame(
        [(1, 12.0, 0.0, "Mujer", None, 2.0, None), (2, None, 140.0, None, "Sí", None, "x"), (3, 11.9, 1001.0, "Otro", "No", float("nan"), "y"), (-(1 << 63), 13.0, 400.0, "Hombre", "Sí", 1.0, "z")],
        "n long, hemoglobina double, plaquetas double, sexo string, fr_a string, fr_b double, text string",
    )
    out = clean.clean_cohort(df).orderBy("text").collect()
    by = {r["text"]: r for r in out}
    assert by["z"]["n"] is None and by["Missing"]["hemoglobina_cat"] == "NormalHemo" and by["x"]["hemoglobina_cat"] == "LowHemo"
    assert [by[k]["plaquetas_cat"] for k in ("Missing", "x", "y", "z")] == ["Missing", "LowPlat", "Missing", "NormalPlat"]
    assert [by[k]["sexo"] for k in ("Missing", "x", "y", "z")] == ["Female", "Missing", "Otro", "Male"]
    assert [by[k]["fr_b"] for k in ("Missing", "x", "y", "z")] == ["2.0", "No", "No", "1.0"]


def test_case_presets_parse(spark):
    from cairn import presets

    df = spark.createDataFrame([(44, "Mujer", 101.0, 90.0, "Sí", None, None, 500.0, 13.0, 3.0, None, "Elevada")], "edad int, sexo string, peso double, tension_ double, fr_cance string, fr_can_e string, ana_hemo double, ana_plaq double, ana_neu double, ana_leuc double, ana_dime string, ana_crea string")
    r = df.select(*[clean.cases(*p).alias(n) for n, p in presets.CASE_RECODES.items()]).first().asDict()
    assert r == {"edadC": "Joven", "pesoC": "Alto", "tensionC": "Baja", "fr_can_eC": "No definido", "ana_hemoC": "Normal", "ana_plaqC": "Alto", "ana_neuC": "Alto", "ana_leucC": "Bajo", "ana_dimeC": "No practicado", "ana_creaC": "Elevada"}


def test_columns(spark):
    df = spark.createDataFrame([(1, "a", None)], "id long, Name string, empty double")
    assert clean.resolve_column(df, "name") == "Name"
    with pytest.raises(ValueError, match="Available columns: id, Name, empty"):
        clean.resolve_column(df, "other")
    assert clean.drop_all_null(df).columns == ["id", "Name"]
    with pytest.raises(ValueError, match="x, y"):
        clean.select_required(df, ["id", "x", "y"])


def spec(*rows_):
    return [SpecRow(*r) for r in rows_]


def test_curator_select(spark):
    df = spark.createDataFrame([(1, "Hombre", 40, "Caucásica", 170, "Positivo", "Buscada positivo", 9), (2, "Mujer", 50, "Negra", -(1 << 63), None, "Buscada negativo", 9)], "id_pacie long, sexo string, edad long, raza string, talla long, ana_dime string, ana_dura string, extra_column int")
    out, report = curate.curate(df, spec(*[(c, "", "", "missing") for c in ("sexo", "edad", "raza", "talla", "ana_dime")]))
    assert out.columns == ["id_pacie", "ana_dura", "sexo", "edad", "raza", "talla", "ana_dime"]
    last = out.where("id_pacie = 2").first()
    assert last["talla"] is None and last["ana_dime"] == "Missing"
    assert report["hard_failures"] == [] and report["feature_columns"] == ["sexo", "edad", "raza", "talla", "ana_dime"]


def test_curator_rejects_unknown_values(spark):
    df = spark.createDataFrame([(1, "Otro", "x")], "id_pacie long, sexo string, ana_dura string")
    _, report = curate.curate(df, spec(("sexo", "", "", "")))
    assert report["hard_failures"] == ["sexo: invalid categorical values ['Otro']"]


def test_curator_filters(spark):
    df = spark.createDataFrame([(1, 70.0, 120, None), (2, 20.0, 1, None), (3, None, None, "Sí"), (4, 85.0, 34, None)], "id_pacie long, peso double, tension_ long, ant_inf string").withColumn("ana_dura", F.lit("x"))
    out, report = curate.curate(df, spec(("peso", "", "entre 29 y 300", ""), ("tension_", "", "Si el valor es 1, poner 0; solo por encima de 35", ""), ("ant_inf", "", "", "no")))
    assert [r[0] for r in out.orderBy("id_pacie").select("id_pacie").collect()] == [1, 3]
    audit = report["criteria_audit"]
    assert audit["peso"]["dropped_row_count"] == 1 and audit["tension_"]["replacements_applied"] == 1
    assert audit["__overall__"] == {"input_row_count": 4, "output_row_count": 2, "discarded_row_count": 2}
    assert report["missing_audit"]["ant_inf"] == {"strategy": "no", "remapped_count": 0, "filled_count": 1, "remaining_null_count": 0, "applied_fill_value": "No"}


def test_curator_remap(spark):
    df = spark.createDataFrame([(1, "No practicado"), (2, "Positivo"), (3, None)], "id_pacie long, ana_dime string").withColumn("ana_dura", F.lit("x"))
    out, report = curate.curate(df, spec(("ana_dime", "", "No practicado => missing", "missing")))
    assert [r["ana_dime"] for r in out.orderBy("id_pacie").collect()] == ["Missing", "Positivo", "Missing"]
    assert report["criteria_audit"]["ana_dime"] == {
        "criteria": "No practicado => missing", "replacements_applied": 0, "value_remapped_count": 1, "dropped_row_count": 0, "allowed_min": None, "allowed_max": None,
        "min_inclusive": True, "max_inclusive": True, "remap_source": "No practicado", "remap_target": "missing",
    }
    assert report["missing_audit"]["ana_dime"]["filled_count"] == 1 and report["hard_failures"] == []
    # In column D a remap leaves nulls alone.
    out, report = curate.curate(df, spec(("ana_dime", "", "", "No practicado => missing")))
    assert [r["ana_dime"] for r in out.orderBy("id_pacie").collect()] == ["Missing", "Positivo", None]
    assert report["missing_audit"]["ana_dime"] == {"strategy": "No practicado => missing", "remapped_count": 1, "filled_count": 0, "remaining_null_count": 1, "remap_source": "No practicado", "remap_target": "missing"}


@pytest.mark.parametrize("where", ["criteria", "strategy"])
def test_remap_targets(spark, where):
    df = spark.createDataFrame([(1, 7, " a ", 1.5), (2, 8, "b", 2.0), (3, None, None, None)], "id long, n long, t string, x double")
    texts = [("n", "7 => MISSING"), ("t", "a=>no"), ("x", "2.0 => 3")]
    rows_ = [SpecRow(v, criteria=t) if where == "criteria" else SpecRow(v, missing_strategy=t) for v, t in texts]
    out, audit = (curate.apply_criteria if where == "criteria" else curate.apply_strategies)(df, rows_)
    assert dict(out.dtypes) == dict(df.dtypes)
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, None, "No", 1.5), (2, 8, "b", 3.0), (3, None, None, None)]
    assert [audit[v]["value_remapped_count" if where == "criteria" else "remapped_count"] for v, _ in texts] == [1, 1, 1]
    words, _ = curate.apply_strategies(df, [SpecRow("n", missing_strategy="7 => no"), SpecRow("x", missing_strategy="missing => 1"), SpecRow("t", missing_strategy="missing => z")])
    assert [(r["n"], r["t"], r["x"]) for r in words.orderBy("id").collect()] == [("No", " a ", 1.5), ("8", "b", 2.0), (None, None, None)]
    assert curate.apply_strategies(df, [SpecRow("t", missing_strategy="?")])[1] == {"t": {"strategy": "?", "filled_count": 0, "warning": "unhandled_strategy"}}


def test_domains_are_listed_up_to_a_bound(spark):
    df = spark.range(500).select(F.concat(F.lit("v"), F.format_string("%03d", "id")).alias("free"), F.lit("Yes").alias("closed"), F.lit(None).cast("string").alias("empty"))
    found = {r["variable"]: r for r in curate.domain_table(df, {"free": ["v001", "v002"], "closed": ["Yes", "No"], "empty": ["x"]}, shown=3).collect()}
    assert (found["free"]["observed"], found["free"]["invalid"]) == (["v000", "v001", "v002", "v003", "v004"], ["v000", "v003", "v004"])
    assert (found["free"]["n_observed"], found["free"]["n_invalid"], found["closed"]["n_invalid"], found["empty"]["observed"]) == (500, 498, 0, [])


def test_criteria_language():
    assert rules.parse_criteria("") is None and rules.parse_criteria("Todo OK, entre 1 y 2") is None
    assert rules.parse_criteria("A => B").remap == ("A", "B")
    assert rules.parse_criteria("Valores entre 1,5 y 3").low == 1.5
    assert rules.parse_criteria("hasta 7").high == 7 and not rules.parse_criteria("por encima de 7").low_included
    assert rules.parse_bounds("por debajo de 4").kind == "lt" and rules.parse_bounds("Normal > 4").kind == "gt" and rules.parse_bounds("nada") is None
    assert [rules.parse_strategy(t).kind for t in ("", "No", "n/a", "a => b", "?")] == ["none", "fill", "missing", "remap", "unknown"]


def test_label_rules(spark):
    df = spark.createDataFrame([(0, "Sí", "Buscada positivo"), (1, "No", "No buscada"), (2, None, "Buscada positivo"), (3, "Sí", "No buscada")], "id int, fr_cance string, ana_dura string")
    text = json.dumps({"default": "other", "rules": [{"color": "cancer", "var": "fr_cance", "eq": "Sí"}, {"color": "positive_study", "all": [{"var": "ana_dura", "eq": "Buscada positivo"}]}]})
    assert [r[0] for r in df.orderBy("id").select(rules.label_rules(text, df.columns)).collect()] == ["positive_study", "other", "positive_study", "cancer"]
    assert df.where("id = 2").select(rules.label_rule({"var": "fr_cance", "ne": "Sí"}, df.columns, nulls_match=True)).first()[0]
    assert not df.where("id = 2").select(rules.label_rule({"var": "none", "eq": "Sí"}, df.columns)).first()[0]


def test_conditional_table(spark):
    df = spark.createDataFrame([("A", "Homocigoto"), ("A", "Heterocigoto"), ("B", "Missing"), ("B", "Heterocigoto")], "hospital string, alt_target string")
    out = {(r["grp"], r["target"]): r["p"] for r in assoc.conditional_table(df, "hospital", "alt_target", ["Homocigoto", "Heterocigoto"]).collect()}
    assert out == {("A", "Homocigoto"): 0.5, ("A", "Heterocigoto"): 0.5, ("B", "Homocigoto"): 0.0, ("B", "Heterocigoto"): 1.0}
    assert {r["grp"] for r in assoc.conditional_table(df, "none", "alt_target").collect()} == {"Missing"}


def test_cramers_v_properties(spark):
    df = spark.createDataFrame([(i % 2, (i // 2) % 2, i % 2, 1) for i in range(40)], "a int, b int, c int, one int")
    v = {(r[0], r[1]): r[2] for r in assoc.cramers_v_matrix(df, ["a", "b", "c", "one"]).collect()}
    assert v["a", "c"] == pytest.approx(1, abs=0.05) and v["a", "b"] == 0 and v["a", "one"] == 0 and v["b", "b"] == 1
    assert all(v[x, y] == v[y, x] and 0 <= v[x, y] <= 1 for x, y in v)


def test_histogram_of_a_constant_and_of_nothing(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "v double")
    out = rows(profile.histogram(df, "v", 2), "bin")
    assert [(r[1], r[2], r[3]) for r in out] == [(2.5, 3.0, 0), (3.0, 3.5, 4)]
    assert profile.histogram(df.limit(0), "v", 2).count() == 0
    with pytest.raises(ValueError):
        profile.histogram(df, "v", 2, 5, 5)


def test_quotas():
    assert sample.largest_remainder({"a": 90, "b": 9, None: 1}, 10) == {"a": 8, "b": 1, None: 1}
    assert sum(sample.largest_remainder({"a": 50, "b": 30, "c": 20}, 7).values()) == 7
    assert sample.proportional_quotas({"a": 95, "b": 5}, 10) == {"a": 10, "b": 1}
    with pytest.raises(ValueError):
        sample.fold_count({"a": 1, "b": 9}, 5)


def test_feature_selection():
    profile_ = [("event_date", 12, 0.0), ("ana_dura", 2, 0.0), ("sexo", 2, 0.0), ("fr_history", 2, 0.0), ("lab_band", 2, 0.0), ("flat", 1, 0.0)]
    assert sample.pick_features(profile_, 3, 48) == ["ana_dura", "fr_history", "lab_band", "sexo"]
    assert sample.pick_features(profile_, 3, 2, first="event_date") == ["event_date", "ana_dura"]


def test_itemsets_agree_and_rules_hold(spark):
    data = [(i, "a" if i % 2 else "b", "x" if i % 3 else "y", None if i % 5 == 0 else "k") for i in range(60)]
    df = patterns.items(spark.createDataFrame(data, "id int, p string, q string, r string"), ["p", "q", "r"])
    bounded = {tuple(r["itemset"]): r["n"] for r in patterns.frequent_itemsets(df, 0.1, 3).collect()}
    baskets = [tuple(r["items"]) for r in df.collect()]
    counts = Counter(s for b in baskets for k in (1, 2, 3) for s in itertools.combinations(b, k))
    assert bounded == {s: n for s, n in counts.items() if n >= 6}
    assert patterns.frequent_itemsets(df.limit(0), 0.1, 3).count() == 0
    assert bounded == {tuple(r["itemset"]): r["n"] for r in patterns.unbounded_itemsets(df, 0.1).collect()}
    assert all(bounded[s] <= bounded[s[:-1]] for s in bounded if len(s) > 1)
    found = patterns.association_rules(patterns.frequent_itemsets(df, 0.1, 3), 0.2)
    for r in found.collect():
        assert r["lift"] * r["consequent_support"] == pytest.approx(r["confidence"])
    assert found.where(F.size("consequent") == 2).count() > 0
    with pytest.raises(ValueError):
        patterns.top_rules(found, "zhang", 3)


def test_bin_labels_are_those_of_sql():
    """Quantiles between cents end in 25 or 75: their third digit is a tie, which SQL rounds up."""
    con = duckdb.connect()
    r = np.random.default_rng(4)
    for n in [6, 7, 8, 50] * 40:
        v = sorted(set(np.round(r.uniform(-1, 1, n) * r.choice([1, 100, 9999, 300_000]), 2).tolist()))
        p, wanted = con.execute("""WITH e AS (SELECT quantile_cont(x, [0, 0.25, 0.5, 0.75, 1]) AS p FROM (SELECT unnest(?::DOUBLE[]) AS x)), s AS (SELECT p, list_transform(p, lambda x: round(x, 3)) AS s FROM e)
            SELECT p, ['(' || round(s[1] - 0.001, 3) || ', ' || s[2] || ']', '(' || s[2] || ', ' || s[3] || ']', '(' || s[3] || ', ' || s[4] || ']', '(' || s[4] || ', ' || s[5] || ']'] FROM s""", [v]).fetchone()
        edges = [quantiles._between(dict(enumerate(v)), q * (len(v) - 1)) for q in (0, 0.25, 0.5, 0.75, 1)]
        assert edges == p and features.bin_labels(edges) == wanted


def test_quantile_bins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(None,)], "v double")
    edges = features.quantile_edges(df, "v", 4).first()[0]
    assert edges == [1.0, 3.25, 5.5, 7.75, 10.0]
    assert features.bin_labels(edges)[0] == "(0.999, 3.25]"
    counts = {r[0]: r[1] for r in df.groupBy(features.binned(F.col("v"), edges).alias("b")).count().collect()}
    assert counts["(0.999, 3.25]"] == 3 and counts["Missing"] == 1 and sum(counts.values()) == 11
    assert features.quantile_edges(df.where("v = 1"), "v", 4).first()[0] is None
    assert df.select(features.binned(F.lit(99.0), edges, clamp=True)).first()[0] == "(7.75, 10.0]"


def test_one_hot_drops_the_first_of_two(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z")], "p string, q string")
    assert {r["component"] for r in features.vocabulary(df, ["p", "q"]).collect()} == {"p_b", "q_x", "q_y", "q_z"}


def test_roc_is_symmetric_and_confusion_adds_up(spark):
    df = spark.createDataFrame([(float((i * 7) % 13), int(i % 3 == 0)) for i in range(50)], "s double, y int")
    up, down = metrics.auc(df, "s", F.col("y") == 1).first()[0], metrics.auc(df, "s", F.col("y") == 1, at_most=True).first()[0]
    assert up + down == pytest.approx(1)
    assert len({r["tp"] + r["fn"] for r in metrics.confusion_profile(df, "s", F.col("y") == 1).collect()}) == 1
    at = metrics.threshold_at(metrics.roc_curve(df, "s", F.col("y") == 1), 0.9).first()
    assert at["sensitivity"] >= 0.9


def test_published_operating_point(spark):
    tp, fp, tn, fn = 321, 23520, 6842, 17
    df = spark.createDataFrame([(1.0, 1, tp), (1.0, 0, fp), (0.0, 0, tn), (0.0, 1, fn)], "s double, y int, n int").select("s", "y", F.explode(F.sequence(F.lit(1), "n")))
    r = metrics.confusion_profile(df, "s", F.col("y") == 1).where("threshold = 1").first()
    assert [round(r[c], 5) for c in ("sensitivity", "specificity", "ppv", "npv")] == [0.94970, 0.22535, 0.01346, 0.99752]


def test_logistic_matches_newton(spark):
    import numpy as np

    data = [(i, "a" if i % 2 else "b", "xyz"[i % 3], int((i % 2) + (i % 3 == 0) + (i % 7 == 0) > 1)) for i in range(90)]
    df = spark.createDataFrame(data, "id int, p string, q string, y int")
    model = score.fit_logistic(df, ["p", "q"], "y")
    names = sorted(model.coefficients)
    x = np.array([[*[float(f"p_{r[1]}" == n or f"q_{r[2]}" == n) for n in names], 1.0] for r in data])
    y = np.array([r[3] for r in data])
    weight = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    w = np.array([*[model.coefficients[n] for n in names], model.intercept])
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (weight * (p - y)) + w).max() < 1e-5
    card = score.points_card(model, df, min_prevalence=0.0)
    assert min(r["points"] for r in card) == 1 and all(r["coefficient"] > 0 for r in card)


def test_merge_keeps_null_targets_together(spark):
    a = spark.createDataFrame([(1, None, 5)], "id int, t string, x int")
    b = spark.createDataFrame([(1, None, 7), (2, "q", 8)], "id int, t string, z int")
    assert rows(score.merge_exports([a, b], "id", "t"), "id") == [(1, None, 5, 7), (2, "q", None, 8)]


def test_screening_rows_and_summary(spark):
    df = spark.createDataFrame([(1, None), (2, "No buscada"), (3, "x")], "id int, t string")
    out = screening.to_screen(df, "t")
    assert rows(out, "id") == [(1, "Missing"), (2, "No buscada")]
    s = {r["label"]: r for r in screening.summary(out, "t", {"f": F.col("id") > 1}, ["Missing", "No buscada", "Other"]).collect()}
    assert (s["Other"]["n"], s["No buscada"]["f"]) == (0, 1)
    with pytest.raises(ValueError):
        screening.labelled(df, "t", ["nothing"])


def test_clusters(spark):
    df = spark.createDataFrame([(i, float(10 * (i % 3)), float(i % 3)) for i in range(24)], "id int, a double, b double")
    for metric in cluster.METRICS[:2]:
        own = cluster.agglomerative(df, "id", ["a", "b"], 3, metric).join(df, "id")
        assert own.select("cluster", "a").distinct().count() == 3
    with pytest.raises(ValueError, match="at most 5"):
        cluster.agglomerative(df, "id", ["a"], metric="manhattan", most=5)


def test_agglomeration_labels_every_row(spark, tmp_path):
    from cairn import queries

    # Three far groups of 400 rows in 8 dimensions; the query takes them all.
    spark.createDataFrame([(i, 0, [9.0 * (i % 3) + (i + j) % 7 / 10 for j in range(8)]) for i in range(1200)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.QUERIES["agglomerative_clusters"](spark, str(tmp_path)).groupBy((F.col("vec_id") % 3).alias("g"), "cluster").count().collect()
    assert len(found) == 3 and all(r["count"] == 400 for r in found) and len({r["cluster"] for r in found}) == 3


def test_clusters_use_the_whole_embedding(spark, tmp_path):
    from cairn import queries

    # Three groups that only the numbers behind the eighth tell apart.
    spark.createDataFrame([(i, 0, [0.01 * ((i * (j + 3)) % 11) + (20.0 * (i % 3) if j >= 8 else 0.0) for j in range(12)]) for i in range(90)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    own = queries.QUERIES["kmeans_clusters"](spark, str(tmp_path))
    assert own.select((own["vec_id"] % 3).alias("g"), "cluster").distinct().count() == 3
    plane = queries.QUERIES["pca_projection"](spark, str(tmp_path)).toPandas()
    assert plane["dimension_1"].max() - plane["dimension_1"].min() > 60


def test_checkpoint_store(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3).toDF("x")

    parameters = {"a": 1, "top_k": 5}
    assert Store(spark, str(tmp_path), "contrast", "t", parameters, resume=True).get("01", make).count() == 3
    assert Store(spark, str(tmp_path), "contrast", "t", parameters, resume=True).get("01", make).count() == 3
    assert len(made) == 1
    assert fingerprint(parameters) != fingerprint(parameters | {"top_k": 6})


def workbook(cells):
    body = "".join("<row>" + "".join(f'<c r="{chr(65 + j)}{i + 1}"' + (f"><v>{v}</v></c>" if isinstance(v, (int, float)) else f' t="inlineStr"><is><t>{v}</t></is></c>') for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(cells))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_readers(spark, tmp_path):
    (tmp_path / "t.xlsx").write_bytes(workbook([["id", "name", "x"], [1, "a", 1.5], [2, None, 2]]))
    df = readers.load(spark, str(tmp_path / "t.xlsx"))
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("x", "double")]
    assert rows(df, "id") == [(1, "a", 1.5), (2, None, 2.0)]
    (tmp_path / "s.xlsx").write_bytes(workbook([["Nombre variable", "b"], [" sexo ", "Sex", "todo ok", "missing"], [None, "x"]]))
    assert readers.load_spec(spark, str(tmp_path / "s.xlsx")) == [SpecRow("sexo", "Sex", "todo ok", "missing")]
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="cluster.*umap_dimension_1"):
        readers.load_coordinates(spark, str(tmp_path / "c.csv"))
    for name in ("x.CSV", "x.xls", "x.sav"):
        with pytest.raises(ValueError, match="Unsupported"):
            readers.load(spark, name)


def test_report_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 1.5), (None, None)], "name string, v double")
    text = sinks.latex(df, "T", "tab:t")
    assert r"a\_b & 1.500000 \\" in text and r"\label{tab:t}" in text
    page = sinks.html_page("<t>", {"x": df}, {"c": {"kind": "bars", "x": ["a"], "y": [2]}})
    assert "&lt;t&gt;" in page and "<rect" in page
    sinks.write_json({"b": 1, "a": 2}, str(tmp_path / "r.json"), sort_keys=True)
    assert list(json.loads((tmp_path / "r.json").read_text())) == ["a", "b"]


def test_ranks_over_pieces(spark):
    df = spark.range(700).select("id", (F.col("id") % 3).alias("c"), F.md5(F.col("id").cast("string")).alias("h"))
    got = ranks.hash_rank(df, F.col("h"), F.col("id"), F.col("c")).collect()
    for c in range(3):
        order = sorted((r["h"], r["id"]) for r in got if r["c"] == c)
        assert {r["id"]: r["rank"] for r in got if r["c"] == c} == {i: n + 1 for n, (_, i) in enumerate(order)}
    assert sorted(r["rank"] for r in ranks.hash_rank(df, F.col("h"), F.col("id")).collect()) == list(range(1, 701))
    for n in (0, 1, 2, 500):
        sums = ranks.running_sums(spark.range(n).select((F.col("id") * 1.5).alias("s"), (F.col("id") % 7).alias("p")), "s", ["p"], pieces=9).orderBy(F.desc("s")).collect()
        total, values = 0, [(n - 1 - i) % 7 for i in range(n)]
        for i, r in enumerate(sums):
            assert r["p_last"] == (total if i else None)
            total += values[i]
            assert r["p_sum"] == total and r["p_next"] == (total + values[i + 1] if i + 1 < n else None)
        assert len(sums) == n


def test_linkage_equals_nearest_pairs():
    import numpy as np

    def plain(x, k, metric, weights):
        """Nearest pairs by definition, from the rows of the clusters."""
        groups = [[i] for i in range(len(x))]
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        one = {"manhattan": lambda a, b: np.abs(x[a] - x[b]).sum(), "chebyshev": lambda a, b: np.abs(x[a] - x[b]).max(), "cosine": lambda a, b: 1 - unit[a] @ unit[b]}

        def gap(a, b):
            if metric == "euclidean":
                centre = [np.average(x[g], axis=0, weights=weights[g]) for g in (a, b)]
                n, m = weights[a].sum(), weights[b].sum()
                return 2 * n * m / (n + m) * ((centre[0] - centre[1]) ** 2).sum()
            return sum(weights[i] * weights[j] * one[metric](i, j) for i in a for j in b) / (weights[a].sum() * weights[b].sum())

        while len(groups) > k:
            i, j = min(itertools.combinations(range(len(groups)), 2), key=lambda p: gap(groups[p[0]], groups[p[1]]))
            groups[i] += groups.pop(j)
        label = {i: min(g) for g in groups for i in g}
        numbers = {}
        return [numbers.setdefault(label[i], len(numbers)) for i in range(len(x))]

    r = np.random.default_rng(4)
    for metric in cluster.METRICS:
        for weights in (np.ones(14), r.integers(1, 5, 14).astype(float)):
            x = r.normal(size=(14, 3))
            assert cluster.linkage_labels(x, 4, metric, weights).tolist() == plain(x, 4, metric, weights)
    assert cluster.linkage_labels(np.zeros((0, 2)), 3, "euclidean").tolist() == [] and cluster.linkage_labels(np.zeros((1, 2)), 3, "cosine").tolist() == [0]


def test_numbers_stay_numbers_for_importance(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else None, float(i) if i % 5 else None, None) for i in range(20)], "id long, c string, x double, none double")
    frame, columns = features.mixed_frame(df, ["id"], ["id"])
    assert columns == ["x", "c"] and dict(frame.dtypes)["x"] == "double" and frame.where("x is null or c is null").count() == 0


def test_reports_say_what_they_leave_out(spark):
    df = spark.range(5).toDF("x")
    assert "first 3 rows" in sinks.latex(df, most=3) and "first 3 rows" in sinks.html_page("t", {"a": df}, most=3)
    assert "first" not in sinks.latex(df, most=5)
