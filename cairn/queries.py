"""Queries over the driver's tables, one or more for each operator, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.arrays import all_distances
from cairn.functions.stored import stored
from cairn.operators import assoc, boost, clean, cluster, curate, explain, features, layout, metrics, patterns, profile, rules, sample, score, screening, validate
from cairn.operators.curate import SpecRow

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Cohorts: what the queries run on, as SQL (for the oracles) and as DataFrames.
DOCS = """docs AS (SELECT d.doc_id, d.lang, d.source, d.n_chars,
  CASE WHEN l.quality = 1 THEN 'positive' WHEN l.quality = 0 THEN 'negative' END AS target, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
ORD = """ord AS (SELECT o.o_orderkey AS id, o.o_orderstatus AS status, o.o_orderpriority AS priority, o.o_totalprice AS price,
  c.c_mktsegment AS segment, c.c_acctbal AS balance, c.c_nationkey AS nation FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""
LINES = """lines AS (SELECT l.l_orderkey, l.l_linenumber, l.l_returnflag AS flag, l.l_linestatus AS line, o.o_orderstatus AS status, o.o_orderpriority AS priority
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""
TURNS = "turns AS (SELECT role, CAST(least(turn, 5) AS VARCHAR) AS turn, CAST(length(text) // 200 AS VARCHAR) AS size FROM conversations)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").withColumnRenamed("doc_id", "_id")
    both = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(labels, F.col("doc_id") == F.col("_id"), "left")
    return both.select("doc_id", "lang", "source", "n_chars", F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative").alias("target"), "toxic")


def orders(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation")
    )


def lines(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("role", F.least("turn", F.lit(5)).cast("string").alias("turn"), F.floor(F.length("text") / 200).cast("string").alias("size"))


# --- descriptive statistics -------------------------------------------------------------------------------------------


@query("""SELECT count(l_extendedprice) AS n, min(l_extendedprice) AS minimum, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
quantile_cont(l_extendedprice, 0.75) AS q3, max(l_extendedprice) AS maximum FROM lineitem""")
def eda_five_number(spark, d):
    return profile.five_numbers(table(spark, d, "lineitem"), "l_extendedprice")


_HISTOGRAM = """WITH v AS (SELECT value AS v FROM events WHERE value IS NOT NULL {where}), e AS (SELECT min(v) AS a, max(v) AS b FROM v),
p AS (SELECT least(floor((v - a) / ((b - a) / 10)), 9)::INT AS bin FROM v, e), c AS (SELECT bin, count(*) AS n FROM p GROUP BY bin)
SELECT s.bin::INT AS bin, a + s.bin * ((b - a) / 10) AS "left", a + (s.bin + 1) * ((b - a) / 10) AS "right", coalesce(n, 0)::BIGINT AS n FROM range(10) s(bin) CROSS JOIN e LEFT JOIN c ON c.bin = s.bin"""


@query(_HISTOGRAM.format(where=""))
def eda_histogram(spark, d):
    return profile.histogram(table(spark, d, "events"), "value", 10)


@query(_HISTOGRAM.format(where="AND value BETWEEN 5 AND 200"))
def eda_histogram_range(spark, d):
    return profile.histogram(table(spark, d, "events"), "value", 10, 5, 200)


@query("""SELECT count(value) AS n_total, count(*) FILTER (value BETWEEN 5 AND 200) AS n_in_range, count(*) FILTER (value < 5) AS n_below, count(*) FILTER (value > 200) AS n_above FROM events""")
def eda_range_counts(spark, d):
    return profile.range_counts(table(spark, d, "events"), "value", 5, 200)


@query(f"""WITH {DOCS}, n AS (SELECT count(*) AS n FROM docs) SELECT 'lang' AS "column", count(DISTINCT lang) + (count(lang) < count(*))::INT AS cardinality, 1 - count(lang) / count(*) AS missing_rate FROM docs
UNION ALL SELECT 'source', count(DISTINCT source) + (count(source) < count(*))::INT, 1 - count(source) / count(*) FROM docs
UNION ALL SELECT 'target', count(DISTINCT target) + (count(target) < count(*))::INT, (count(*) - count(target)) / count(*) FROM docs""")
def column_profile(spark, d):
    return profile.column_profile(docs(spark, d), ["lang", "source", "target"])


@query(f"WITH {DOCS} SELECT target AS value, count(*) AS n FROM docs GROUP BY target")
def value_counts(spark, d):
    return profile.value_counts(docs(spark, d), "target")


@query(f"""WITH {DOCS} SELECT 'doc_id' AS "column", count(doc_id) AS non_null, count(*) - count(doc_id) AS nulls FROM docs UNION ALL SELECT 'target', count(target), count(*) - count(target) FROM docs
UNION ALL SELECT 'toxic', count(toxic), count(*) - count(toxic) FROM docs""")
def null_counts(spark, d):
    return curate.null_counts(docs(spark, d).select("doc_id", "target", "toxic"))


# --- cleaning ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {DOCS} SELECT CASE WHEN doc_id % 10 = 3 THEN NULL ELSE n_chars END AS n_chars, coalesce(target, 'Missing') AS target, coalesce(CAST(toxic AS VARCHAR), 'No') AS fr_toxic, doc_id FROM docs""")
def clean_sentinel_and_fill(spark, d):
    df = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 10 == 3, F.lit(clean.SENTINEL)).otherwise(F.col("n_chars")).alias("n_chars"), "target", F.col("toxic").alias("fr_toxic"))
    return clean.clean_cohort(df)


@query(f"""WITH {ORD} SELECT id, CASE WHEN balance >= 0 THEN 'credit' ELSE 'debt' END AS two,
CASE WHEN price > 0 AND price <= 50000 THEN 'low' WHEN price > 50000 AND price <= 150000 THEN 'mid' WHEN price > 150000 AND price <= 300000 THEN 'high' END AS three FROM ord""")
def threshold_bins(spark, d):
    return orders(spark, d).select("id", clean.threshold_bin(F.col("balance"), 0, "credit", "debt").alias("two"), clean.edge_bins(F.col("price"), (0, 50000, 150000, 300000), ("low", "mid", "high")).alias("three"))


@query(f"""WITH {ORD} SELECT id, CASE status WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE status END AS status,
CASE WHEN price < 20000 THEN 'small' WHEN price >= 20000 AND price < 200000 THEN 'medium' WHEN price >= 200000 THEN 'large' ELSE 'none' END AS band,
CASE WHEN status = 'F' AND balance < 0 THEN 'late debt' WHEN status = 'F' THEN 'done' ELSE '0' END AS kind FROM ord""")
def recode_select(spark, d):
    return orders(spark, d).select(
        "id", clean.recode(F.col("status"), {"F": "Finished", "O": "Open"}).alias("status"),
        clean.cases([("price < 20000", "small"), ("price >= 20000 AND price < 200000", "medium"), ("price >= 200000", "large")], "none").alias("band"),
        clean.cases([("status = 'F' AND balance < 0", "late debt"), ("status = 'F'", "done")], "0").alias("kind"),
    )


@query(f"WITH {ORD} SELECT id, status, try_cast(priority AS DOUBLE) AS rank, try_cast(substr(priority, 1, 1) AS DOUBLE) AS digit FROM ord")
def select_and_coerce(spark, d):
    df = clean.drop_all_null(clean.drop_columns(orders(spark, d).withColumn("empty", F.lit(None).cast("string")), ["nation", "unknown"]))
    out = clean.select_required(df, ["id", "status", "id", "priority"])
    return out.select("id", clean.quoted(clean.resolve_column(out, "STATUS")), clean.number(F.col("priority")).alias("rank"), clean.number(F.substring("priority", 1, 1)).alias("digit"))


# --- filters and rule languages ---------------------------------------------------------------------------------------


@query(f"WITH {DOCS} SELECT doc_id, target FROM docs WHERE target IN ('positive', 'negative')")
def valid_label_filter(spark, d):
    return screening.labelled(docs(spark, d), "target", ["positive", "negative"]).select("doc_id", "target")


@query(f"WITH {DOCS} SELECT doc_id, CASE target WHEN 'positive' THEN 1 ELSE 0 END AS y FROM docs WHERE target IN ('positive', 'negative')")
def binary_target(spark, d):
    return screening.binary(docs(spark, d), "target", "positive", "negative").select("doc_id", "y")


@query(f"WITH {DOCS} SELECT doc_id, 'Missing' AS target FROM docs WHERE target IS NULL")
def screening_rows(spark, d):
    return screening.to_screen(docs(spark, d), "target").select("doc_id", "target")


_LABELS = {"default": "other", "rules": [{"color": "english", "var": "lang", "eq": "en"}, {"color": "long", "var": "n_chars", "gte": 3000, "lt": 20000}, {"label": "known", "all": [{"var": "target", "ne": "negative"}, {"var": "lang", "in": ["de", "fr"]}]}, {"color": "any", "any": [{"var": "toxic", "eq": 1}, {"var": "nothing", "eq": "x"}]}, {"color": "none", "all": []}]}


@query(f"""WITH {DOCS} SELECT doc_id, CASE WHEN toxic = 1 THEN 'any' WHEN target <> 'negative' AND lang IN ('de', 'fr') THEN 'known' WHEN n_chars >= 3000 AND n_chars < 20000 THEN 'long' WHEN lang = 'en' THEN 'english' ELSE 'other' END AS color FROM docs""")
def color_rules(spark, d):
    df = docs(spark, d)
    return df.select("doc_id", rules.label_rules(_LABELS, df.columns).alias("color"))


@query(f"""WITH {ORD} SELECT id, CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN 'Yes' ELSE 'No' END AS build, CASE WHEN price BETWEEN 50000 AND 69999 THEN 'Yes' ELSE 'No' END AS band, CASE WHEN status = 'P' THEN 'Yes' ELSE 'No' END AS pending FROM ord""")
def guided_rules(spark, d):
    df = orders(spark, d)
    preset = {"build": (("segment", "segment IN ('BUILDING', 'MACHINERY')"),), "band": (("price", "try_cast(price AS double) BETWEEN 50000 AND 69999"),), "pending": (("missing_column", "false"), ("status", "status = 'P'")), "never": (("missing_column", "true"),)}
    return df.select("id", *[c.alias(n) for n, c in rules.guided_rules(df, preset).items()])


_SPEC = [
    SpecRow("p_size", "size", "entre 5 y 40", "missing"),
    SpecRow("p_retailprice", "price", "por encima de 905,5", "missing"),
    SpecRow("weight", "weight", "si el valor es 1, 0; por encima de 35", "missing"),
    SpecRow("p_brand", "brand", "Brand#1 => Brand#A", "no"),
]
_SPEC_BASE = """b AS (SELECT p_partkey, p_size, p_retailprice, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 5 = 0 THEN 1 ELSE p_size + 20 END AS weight,
CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_brand END AS p_brand FROM part),
k AS (SELECT *, coalesce(p_size BETWEEN 5 AND 40, true) AS k1, coalesce(p_retailprice > 905.5, true) AS k2, coalesce(CASE WHEN weight = 1 THEN 0 ELSE weight END >= 35, true) AS k3 FROM b)"""


def _parts(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size")
    return p.select("p_partkey", "p_size", "p_retailprice", F.when(size % 7 == 0, None).when(size % 5 == 0, 1).otherwise(size + 20).alias("weight"), F.when(size % 11 != 0, F.col("p_brand")).alias("p_brand"))


@query(f"WITH {_SPEC_BASE} SELECT 'p_size' AS variable, count(*) FILTER (NOT k1) AS newly_dropped, count(*) FILTER (NOT k1) AS failing FROM k UNION ALL SELECT 'p_retailprice', count(*) FILTER (k1 AND NOT k2), count(*) FILTER (NOT k2) FROM k UNION ALL SELECT 'weight', count(*) FILTER (k1 AND k2 AND NOT k3), count(*) FILTER (NOT k3) FROM k")
def criteria_filter_audit(spark, d):
    return curate.criteria_audit_frame(_parts(spark, d), _SPEC)


@query(f"WITH {_SPEC_BASE} SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, CAST(CASE WHEN weight = 1 THEN 0 ELSE weight END AS DOUBLE) AS weight, coalesce(CASE WHEN p_brand = 'Brand#1' THEN 'Brand#A' ELSE p_brand END, 'No') AS p_brand FROM k WHERE k1 AND k2 AND k3")
def curated_rows(spark, d):
    return curate.apply_strategies(curate.apply_criteria(_parts(spark, d), _SPEC)[0], _SPEC)[0]


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_brand END, 'Missing') AS a, CASE WHEN p_brand = 'Brand#2' OR p_size % 11 = 0 THEN 'Missing' ELSE p_brand END AS b, CASE WHEN p_size % 7 = 0 THEN 'absent' ELSE p_type END AS c FROM part")
def missing_strategy(spark, d):
    size = F.col("p_size")
    df = table(spark, d, "part").select("p_partkey", F.when(size % 11 != 0, F.col("p_brand")).alias("a"), F.when(size % 11 != 0, F.col("p_brand")).alias("b"), F.when(size % 7 != 0, F.col("p_type")).alias("c"))
    out = curate.apply_strategies(df, [SpecRow("a", missing_strategy="miss"), SpecRow("b", missing_strategy="Brand#2 => missing"), SpecRow("c", missing_strategy="missing => absent"), SpecRow("p_partkey", missing_strategy="?")])[0]
    # Remaps leave nulls as they are; the fills are steps of their own.
    return out.withColumns({"b": F.coalesce("b", F.lit("Missing")), "c": F.coalesce("c", F.lit("absent"))})


@query("SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_brand = 'Brand#2' THEN 'Missing' ELSE p_brand END AS a, CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_brand = 'Brand#3' THEN 'No' ELSE p_brand END AS b, CASE WHEN p_size = 9 THEN NULL ELSE p_size END AS c, p_type AS d FROM part")
def missing_strategy_remap(spark, d):
    """Column D: a remap touches the cells that it names and no null."""
    part, brand = table(spark, d, "part"), F.when(F.col("p_size") % 11 != 0, F.col("p_brand"))
    df = part.select("p_partkey", brand.alias("a"), brand.alias("b"), F.col("p_size").alias("c"), F.col("p_type").alias("d"))
    return curate.apply_strategies(df, [SpecRow("a", missing_strategy="Brand#2 => MISS"), SpecRow("b", missing_strategy="Brand#3=>no"), SpecRow("c", missing_strategy="9 => n/a"), SpecRow("d", missing_strategy="missing => absent")])[0]


@query("""WITH b AS (SELECT p_partkey, p_size % 11 = 0 AS gap, p_brand, p_size FROM part)
SELECT p_partkey, CASE WHEN gap OR p_brand = 'Brand#2' THEN 'Missing' ELSE p_brand END AS a, CASE WHEN gap THEN NULL WHEN p_brand = 'Brand#3' THEN 'No' ELSE p_brand END AS b,
CAST(CASE WHEN p_size = 9 THEN NULL ELSE p_size END AS DOUBLE) AS c, CASE WHEN gap THEN NULL WHEN p_size = 12 THEN 'No' ELSE CAST(p_size AS VARCHAR) END AS d, CASE WHEN p_size = 14 THEN 15 ELSE p_size END AS e FROM b""")
def criteria_remap(spark, d):
    """Column C: a remap to missing and to no, of texts and of numbers, with column D after it."""
    part, gap = table(spark, d, "part"), F.col("p_size") % 11 != 0
    df = part.select("p_partkey", F.when(gap, F.col("p_brand")).alias("a"), F.when(gap, F.col("p_brand")).alias("b"), F.col("p_size").alias("c"), F.when(gap, F.col("p_size")).alias("d"), F.col("p_size").alias("e"))
    spec = [SpecRow("a", "", "Brand#2 => missing", "missing"), SpecRow("b", "", "Brand#3 => NO"), SpecRow("c", "", "9 => missing", "missing"), SpecRow("d", "", "12 => no"), SpecRow("e", "", "14 => 15")]
    return curate.apply_strategies(curate.apply_criteria(df, spec)[0], spec)[0]


def _audit_rows(spark, audit, schema):
    return spark.createDataFrame([(k, *[v.get(c) for c in schema]) for k, v in audit.items() if k != "__overall__"], "variable string, " + ", ".join(f"{c} {t}" for c, t in schema.items()))


@query(f"""WITH {_SPEC_BASE} SELECT 'p_size' AS variable, 0 AS replacements_applied, 0 AS value_remapped_count, count(*) FILTER (NOT k1) AS dropped_row_count, 5.0::DOUBLE AS allowed_min, 40.0::DOUBLE AS allowed_max, true AS min_inclusive FROM k
UNION ALL SELECT 'p_retailprice', 0, 0, count(*) FILTER (k1 AND NOT k2), 905.5, NULL, false FROM k
UNION ALL SELECT 'weight', count(*) FILTER (weight = 1), 0, count(*) FILTER (k1 AND k2 AND NOT k3), 35.0, NULL, true FROM k
UNION ALL SELECT 'p_brand', 0, count(*) FILTER (p_brand = 'Brand#1'), 0, NULL, NULL, true FROM k""")
def criteria_audit(spark, d):
    audit = curate.apply_criteria(_parts(spark, d), _SPEC)[1]
    return _audit_rows(spark, audit, {"replacements_applied": "long", "value_remapped_count": "long", "dropped_row_count": "long", "allowed_min": "double", "allowed_max": "double", "min_inclusive": "boolean"})


@query("""SELECT 'a' AS variable, 0 AS remapped_count, count(*) FILTER (p_size % 11 = 0) AS filled_count, 0 AS remaining_null_count, 'Missing' AS applied_fill_value FROM part
UNION ALL SELECT 'b', count(*) FILTER (p_size % 11 <> 0 AND p_brand = 'Brand#2'), 0, count(*) FILTER (p_size % 11 = 0), NULL FROM part
UNION ALL SELECT 'c', 0, 0, count(*) FILTER (p_size % 7 = 0), 'NA' FROM part UNION ALL SELECT 'd', 0, count(*) FILTER (p_size % 7 = 0), 0, 'No' FROM part""")
def missing_audit(spark, d):
    size = F.col("p_size")
    df = table(spark, d, "part").select(F.when(size % 11 != 0, F.col("p_brand")).alias("a"), F.when(size % 11 != 0, F.col("p_brand")).alias("b"), F.when(size % 7 != 0, size).alias("c"), F.when(size % 7 != 0, F.col("p_type")).alias("d"))
    audit = curate.apply_strategies(df, [SpecRow("a", missing_strategy="miss"), SpecRow("b", missing_strategy="Brand#2 => missing"), SpecRow("c", missing_strategy="na"), SpecRow("d", missing_strategy="No")])[1]
    return _audit_rows(spark, audit, {"remapped_count": "long", "filled_count": "long", "remaining_null_count": "long", "applied_fill_value": "string"})


@query(f"WITH {ORD} SELECT id, status FROM ord WHERE trim(status) IN ('F', 'O')")
def value_filter(spark, d):
    return curate.filter_values(orders(spark, d), "status", [" F", "O ", ""])[0].select("id", "status")


@query(f"""WITH {ORD} SELECT 'status' AS variable, array_to_string(list_sort(list(DISTINCT status)), ', ') AS observed, array_to_string(list_sort(list(DISTINCT status) FILTER (status NOT IN ('F', 'O'))), ', ') AS invalid FROM ord
UNION ALL SELECT 'segment', array_to_string(list_sort(list(DISTINCT segment)), ', '), coalesce(array_to_string(list_sort(list(DISTINCT segment) FILTER (segment NOT IN ('BUILDING', 'MACHINERY'))), ', '), '') FROM ord""")
def domain_validation(spark, d):
    found = curate.validate_domains(orders(spark, d), {"status": ["F", "O"], "segment": ["BUILDING", "MACHINERY"]})
    return found.select("variable", F.array_join("observed", ", ").alias("observed"), F.array_join(F.array_sort("invalid"), ", ").alias("invalid"))


@query("""SELECT 'p_size' AS variable, 'between' AS kind, count(p_size) AS n, count(*) FILTER (p_size < 5) AS below, count(*) FILTER (p_size BETWEEN 5 AND 40) AS within, count(*) FILTER (p_size > 40) AS above, min(p_size)::DOUBLE AS least, max(p_size)::DOUBLE AS most FROM part
UNION ALL SELECT 'p_retailprice', 'gt', count(p_retailprice), count(*) FILTER (p_retailprice <= 950), count(*) FILTER (p_retailprice > 950), 0, min(p_retailprice), max(p_retailprice) FROM part
UNION ALL SELECT 'p_partkey', 'lt', count(p_partkey), 0, count(*) FILTER (p_partkey < 1000), count(*) FILTER (p_partkey >= 1000), min(p_partkey), max(p_partkey) FROM part""")
def threshold_validation(spark, d):
    return curate.validate_bounds(table(spark, d, "part"), {"p_size": "entre 5 y 40", "p_retailprice": "Normal > 950", "p_partkey": "valores < 1000", "p_name": "todo ok"})


# --- association ------------------------------------------------------------------------------------------------------


@query(f"WITH {DOCS}, r AS (SELECT lang AS grp, coalesce(target, 'Missing') AS target FROM docs), c AS (SELECT grp, target, count(*) AS n FROM r GROUP BY ALL), e AS (SELECT g.grp, t.target, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT grp FROM c) g CROSS JOIN (SELECT DISTINCT target FROM c) t LEFT JOIN c ON c.grp = g.grp AND c.target = t.target) SELECT grp, target, n::BIGINT AS n, n / sum(n) OVER (PARTITION BY grp) AS p FROM e")
def cpt(spark, d):
    return assoc.conditional_table(docs(spark, d), "lang", "target")


@query("SELECT role AS \"left\", CAST(least(turn, 5) AS VARCHAR) AS \"right\", count(*) AS n FROM conversations GROUP BY ALL")
def crosstab(spark, d):
    return assoc.crosstab(turns(spark, d), "role", "turn")


_PAIRS = [("role", "turn"), ("role", "size"), ("turn", "size")]
_V = """cells AS ({cells}), m AS (SELECT a, b, l, r, n, sum(n) OVER (PARTITION BY a, b, l) AS rt, sum(n) OVER (PARTITION BY a, b, r) AS ct FROM cells),
t AS (SELECT a, b, sum(n)::BIGINT AS n, count(DISTINCT l) AS r, count(DISTINCT r) AS c, sum(n * n / (rt * ct)) AS s FROM m GROUP BY a, b),
x AS (SELECT *, greatest(n * (s - 1), 0) AS chi2, greatest(n - 1, 1) AS q FROM t),
y AS (SELECT *, greatest(0, chi2 / n - (c - 1) * (r - 1) / q) AS phi2, least(r - (r - 1) * (r - 1) / q - 1, c - (c - 1) * (c - 1) / q - 1) AS least_ FROM x),
v AS (SELECT a AS variable_a, b AS variable_b, n, chi2, CASE WHEN least_ > 0 THEN sqrt(phi2 / least_) ELSE 0 END AS cramers_v,
  CASE WHEN least(r, c) > 1 THEN sqrt(chi2 / n / (least(r, c) - 1)) ELSE 0 END AS plain FROM y)"""
_TURN_CELLS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS l, {b} AS r, count(*) AS n FROM turns GROUP BY {a}, {b}" for a, b in _PAIRS)
_TURN_V = f"WITH {TURNS}, " + _V.format(cells=_TURN_CELLS)
_COLUMNS = ["role", "turn", "size"]


@query(_TURN_V + " SELECT n, round(chi2, 8) AS chi2, round(cramers_v, 8) AS cramers_v FROM v WHERE variable_a = 'role' AND variable_b = 'turn'")
def cramers_v_pair(spark, d):
    return assoc.cramers_v(turns(spark, d), "role", "turn").select("n", F.round("chi2", 8).alias("chi2"), F.round("cramers_v", 8).alias("cramers_v"))


@query(_TURN_V + " SELECT n, round(chi2, 8) AS chi2, round(plain, 8) AS cramers_v FROM v WHERE variable_a = 'role' AND variable_b = 'turn'")
def cramers_v_uncorrected(spark, d):
    return assoc.cramers_v(turns(spark, d), "role", "turn", corrected=False).select("n", F.round("chi2", 8).alias("chi2"), F.round("cramers_v", 8).alias("cramers_v"))


@query(f"""WITH {ORD}, t AS (SELECT count(*) FILTER (a AND b) AS p, count(*) FILTER (a AND NOT b) AS q, count(*) FILTER (NOT a AND b) AS r, count(*) FILTER (NOT a AND NOT b) AS s, count(*) AS n FROM (SELECT status = 'F' AS a, segment = 'BUILDING' AS b FROM ord)),
x AS (SELECT n, power(greatest(abs(p * s - q * r) / n - 0.5, 0), 2) * n * n * n / ((p + q)::DOUBLE * (r + s) * (p + r) * (q + s)) AS chi2 FROM t) SELECT n, round(chi2, 8) AS chi2, round(sqrt(chi2 / n), 8) AS cramers_v FROM x""")
def cramers_v_continuity(spark, d):
    """The plain coefficient of a 2 x 2 table, with Yates' correction."""
    df = orders(spark, d).select((F.col("status") == "F").alias("a"), (F.col("segment") == "BUILDING").alias("b"))
    return assoc.cramers_v(df, "a", "b", corrected=False, continuity=True).select("n", F.round("chi2", 8).alias("chi2"), F.round("cramers_v", 8).alias("cramers_v"))


@query(_TURN_V + ", h AS (SELECT variable_a, variable_b, cramers_v FROM v) SELECT variable_a, variable_b, round(cramers_v, 8) AS cramers_v FROM h UNION ALL SELECT variable_b, variable_a, round(cramers_v, 8) FROM h UNION ALL VALUES ('role', 'role', 1.0), ('turn', 'turn', 1.0), ('size', 'size', 1.0)")
def cramers_v_matrix(spark, d):
    return assoc.cramers_v_matrix(turns(spark, d), _COLUMNS).select("variable_a", "variable_b", F.round("cramers_v", 8).alias("cramers_v"))


@query(_TURN_V + " SELECT variable_a, variable_b, n, round(chi2, 8) AS chi2, round(cramers_v, 8) AS cramers_v FROM v ORDER BY cramers_v DESC, variable_a, variable_b LIMIT 2")
def cramers_v_top_pairs(spark, d):
    return assoc.top_pairs(assoc.cramers_v_pairs(turns(spark, d), _COLUMNS), 2).select("variable_a", "variable_b", "n", F.round("chi2", 8).alias("chi2"), F.round("cramers_v", 8).alias("cramers_v"))


@query(f"WITH {TURNS}, cells AS ({_TURN_CELLS}), m AS (SELECT *, sum(n) OVER (PARTITION BY a, b) AS t, sum(n) OVER (PARTITION BY a, b, l) AS rt, sum(n) OVER (PARTITION BY a, b, r) AS ct FROM cells), h AS (SELECT a, b, round(sum(n / t * ln(n * t / (rt * ct))), 8) AS mi FROM m GROUP BY a, b) SELECT a AS variable_a, b AS variable_b, mi AS mutual_information FROM h UNION ALL SELECT b, a, mi FROM h UNION ALL VALUES ('role', 'role', 1.0), ('turn', 'turn', 1.0), ('size', 'size', 1.0)")
def mutual_information(spark, d):
    return assoc.mutual_information(turns(spark, d), _COLUMNS).select("variable_a", "variable_b", F.round("mutual_information", 8).alias("mutual_information"))


# --- sampling ---------------------------------------------------------------------------------------------------------


@query(f"WITH {ORD} SELECT id, status FROM ord ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id LIMIT 500")
def md5_sample(spark, d):
    return sample.cap(orders(spark, d), "id", 500).select("id", "status")


_RANKED = "SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5(CAST({id} AS VARCHAR) || '|42'), {id}) AS rank FROM {of}"


@query(f"WITH {DOCS}, r AS ({_RANKED.format(by='target', id='doc_id', of='docs')}), c AS (SELECT target, count(*) AS n, sum(count(*)) OVER () AS total FROM docs GROUP BY target), q AS (SELECT target, least(n, greatest(1, round_even(200 * n / total, 0)))::BIGINT AS quota FROM c), s AS (SELECT r.doc_id, r.target, sum(q.quota) FILTER (true) OVER () AS x FROM r JOIN q ON r.target IS NOT DISTINCT FROM q.target WHERE r.rank <= q.quota) SELECT doc_id, target FROM s ORDER BY md5(CAST(doc_id AS VARCHAR) || '|43'), doc_id LIMIT 200")
def stratified_quota(spark, d):
    return sample.stratified_cap(docs(spark, d), "target", 200, "doc_id").select("doc_id", "target")


@query(f"""WITH {DOCS}, r AS ({_RANKED.format(by='target', id='doc_id', of='docs')}), c AS (SELECT target, count(*) AS n, sum(count(*)) OVER () AS total FROM docs GROUP BY target),
f AS (SELECT target, n, 100 * n / total AS exact, greatest(1, floor(100 * n / total))::BIGINT AS base FROM c), g AS (SELECT *, 100 - sum(base) OVER () AS short, row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, target IS NULL, target) AS place FROM f)
SELECT r.doc_id, r.target FROM r JOIN g ON r.target IS NOT DISTINCT FROM g.target WHERE r.rank <= g.base + (g.place <= g.short)::INT""")
def largest_remainder_sample(spark, d):
    return sample.largest_remainder_sample(docs(spark, d), "target", 100, "doc_id").select("doc_id", "target")


@query(f"WITH {ORD}, r AS ({_RANKED.format(by='status', id='id', of='ord')}) SELECT id, status, ((rank - 1) % 5)::INT AS fold FROM r")
def kfold_assign(spark, d):
    return sample.folds(orders(spark, d), "status", 5, "id").select("id", "status", "fold")


@query(f"WITH {ORD} SELECT id, CAST('0x' || substr(md5(CAST(id AS VARCHAR) || '|42'), 1, 8) AS BIGINT) < 3435973836 AS in_train FROM ord")
def train_test_split(spark, d):
    return sample.split(orders(spark, d), "id").select("id", "in_train")


@query(f"""WITH {ORD}, p AS (SELECT 'status' AS name, count(DISTINCT status) AS c FROM ord UNION ALL SELECT 'priority', count(DISTINCT priority) FROM ord UNION ALL SELECT 'segment', count(DISTINCT segment) FROM ord UNION ALL SELECT 'nation', count(DISTINCT nation) FROM ord)
SELECT name, row_number() OVER (ORDER BY name <> 'nation', c, name)::INT AS place FROM p WHERE name = 'nation' OR c BETWEEN 2 AND 12 ORDER BY name <> 'nation', c, name LIMIT 3""")
def feature_selection(spark, d):
    found = [(r[0], r[1], r[2]) for r in profile.column_profile(orders(spark, d), ["status", "priority", "segment", "nation"]).collect()]
    chosen = sample.pick_features(found, 12, 3, first="nation")
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(chosen)], "name string, place int")


# --- itemsets and rules -----------------------------------------------------------------------------------------------

_FOUR = ["flag", "line", "priority", "status"]


@query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, 'flag:' || flag || ', line:' || line || ', priority:' || priority || ', status:' || status AS items FROM lines")
def item_encoding(spark, d):
    return patterns.items(lines(spark, d), _FOUR).select("l_orderkey", "l_linenumber", F.array_join("items", ", ").alias("items"))


@query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN flag <> 'N' THEN 'flag:' || flag END, 'line:' || line, 'status:' || status], lambda x: x IS NOT NULL), ', ') AS items FROM lines")
def basket_without_no(spark, d):
    return patterns.sparse_items(lines(spark, d), ["flag", "line", "status"], absent="N").select("l_orderkey", "l_linenumber", F.array_join("items", ", ").alias("items"))


def _set_sql(names: tuple[str, ...]) -> str:
    text = " || ', ' || ".join(f"'{n}:' || {n}" for n in names)
    return f"SELECT {text} AS itemset, {len(names)} AS size, count(*) AS n FROM lines GROUP BY {', '.join(names)}"


def _subsets(names: list[str], most: int) -> list[tuple[str, ...]]:
    from itertools import combinations

    return [c for k in range(1, most + 1) for c in combinations(names, k)]


_SETS = f"sets AS (SELECT itemset, size, n, n / (SELECT count(*) FROM lines) AS support FROM ({' UNION ALL '.join(_set_sql(c) for c in _subsets(_FOUR, 3))}) WHERE n >= 0.05 * (SELECT count(*) FROM lines))"
_SETS_SQL = f"WITH {LINES}, {_SETS} SELECT itemset, size::INT AS size, n, support FROM sets"


def _frequent(spark, d, most=3):
    return patterns.frequent_itemsets(patterns.items(lines(spark, d), _FOUR), 0.05, most)


@query(_SETS_SQL)
def frequent_itemsets(spark, d):
    return _frequent(spark, d).withColumn("itemset", patterns.joined(F.col("itemset")))


@query(f"WITH {LINES}, {_SETS} SELECT itemset, n FROM sets")
def fp_growth(spark, d):
    found = patterns.unbounded_itemsets(patterns.items(lines(spark, d), _FOUR), 0.05).where(F.size("itemset") <= 3)
    return found.select(patterns.joined(F.col("itemset")).alias("itemset"), "n")


def _rule_sql() -> str:
    """Every split of every set of columns, as SQL over the sets."""
    parts = []
    for names in _subsets(_FOUR, 3):
        k = len(names)
        for mask in range(1, (1 << k) - 1):
            a = [n for i, n in enumerate(names) if mask >> i & 1]
            c = [n for i, n in enumerate(names) if not mask >> i & 1]
            text = lambda side: " || ', ' || ".join(f"'{n}:' || {n}" for n in side)
            parts.append(f"SELECT {text(a)} AS antecedent, {text(c)} AS consequent, {len(names)} AS size, count(*) AS n FROM lines GROUP BY {', '.join(names)}")
    return f"""{_SETS}, splits AS ({' UNION ALL '.join(parts)}), rules AS (SELECT s.antecedent, s.consequent, a.support AS antecedent_support, c.support AS consequent_support, s.n / (SELECT count(*) FROM lines) AS support,
    s.n / a.n AS confidence, s.n / a.n / c.support AS lift, s.n / (SELECT count(*) FROM lines) - a.support * c.support AS leverage, CASE WHEN s.n < a.n THEN (1 - c.support) / (1 - s.n / a.n) END AS conviction, s.size
    FROM splits s JOIN sets a ON a.itemset = s.antecedent JOIN sets c ON c.itemset = s.consequent WHERE s.n >= 0.05 * (SELECT count(*) FROM lines))"""


_RULES = f"WITH {LINES}, {_rule_sql()}"
_RULE_COLUMNS = "antecedent, consequent, round(antecedent_support, 9) AS antecedent_support, round(consequent_support, 9) AS consequent_support, round(support, 9) AS support, round(confidence, 9) AS confidence, round(lift, 9) AS lift, round(leverage, 9) AS leverage, round(conviction, 7) AS conviction"


def _shown(rules_: DataFrame) -> DataFrame:
    text = patterns.rules_as_text(rules_)
    return text.select("antecedent", "consequent", *[F.round(c, 9).alias(c) for c in ("antecedent_support", "consequent_support", "support", "confidence", "lift", "leverage")], F.round("conviction", 7).alias("conviction"))


def _rules(spark, d):
    return patterns.association_rules(_frequent(spark, d), 0.3)


@query(f"{_RULES} SELECT {_RULE_COLUMNS} FROM rules WHERE confidence >= 0.3")
def association_rules(spark, d):
    return _shown(_rules(spark, d))


@query(f"{_RULES} SELECT {_RULE_COLUMNS} FROM rules WHERE confidence >= 0.3 AND lift >= 0.99 AND size <= 3 AND (consequent LIKE 'status:%' OR consequent LIKE '%, status:%')")
def rules_filtered_by_column(spark, d):
    return _shown(patterns.filter_rules(_rules(spark, d), 0.99, 3, "status", "consequent"))


@query(f"{_RULES}, top AS (SELECT * FROM rules WHERE confidence >= 0.3 ORDER BY round(leverage, 9) DESC, round(confidence, 9) DESC, round(support, 9) DESC, antecedent, consequent LIMIT 10) SELECT {_RULE_COLUMNS} FROM top")
def rules_topk(spark, d):
    return _shown(patterns.top_rules(_rules(spark, d), "leverage", 10))


@query(f"{_RULES}, t AS (SELECT *, row_number() OVER (PARTITION BY consequent ORDER BY round(lift, 9) DESC, round(confidence, 9) DESC, round(support, 9) DESC, antecedent) AS rank FROM rules WHERE confidence >= 0.3 AND consequent IN ('status:F', 'status:O', 'status:P')) SELECT {_RULE_COLUMNS} FROM t WHERE rank <= 5")
def target_rules(spark, d):
    return _shown(patterns.target_rules(_frequent(spark, d), "status", 0.3, 5))


@query(f"{_RULES} SELECT 'any' AS kind, {_RULE_COLUMNS} FROM rules WHERE confidence >= 0.3 AND (antecedent LIKE '%flag:R%' OR antecedent LIKE '%line:O%') UNION ALL SELECT 'all', {_RULE_COLUMNS} FROM rules WHERE confidence >= 0.3 AND antecedent LIKE '%flag:R%' AND antecedent LIKE '%line:O%'")
def rule_set_search(spark, d):
    found = _rules(spark, d)
    either = _shown(patterns.search_rules(found, ["flag:R", "line:O"])).withColumn("kind", F.lit("any"))
    return either.unionByName(_shown(patterns.search_rules(found, ["flag:R", "line:O"], every=True)).withColumn("kind", F.lit("all")))


@query(f"{_RULES} SELECT {_RULE_COLUMNS}, (consequent LIKE '%status:F%')::INT AS outcome FROM rules WHERE confidence >= 0.3 AND lift > 0.99 AND consequent LIKE '%status:%'")
def labelled_rules(spark, d):
    found = patterns.labelled_rules(_rules(spark, d), "status", "F", 0.99)
    return _shown(found).join(patterns.rules_as_text(found).select("antecedent", "consequent", "outcome"), ["antecedent", "consequent"])


@query(f"{_RULES} SELECT DISTINCT antecedent AS itemset FROM rules WHERE confidence >= 0.3")
def parse_itemset_text(spark, d):
    text = _rules(spark, d).select(F.concat(F.lit("frozenset({'"), F.array_join("antecedent", "', '"), F.lit("'})")).alias("t")).distinct()
    return text.select(patterns.joined(patterns.parse_itemset(F.col("t"))).alias("itemset"))


# --- features ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {ORD}, e AS (SELECT [quantile_cont(price, 0), quantile_cont(price, 0.25), quantile_cont(price, 0.5), quantile_cont(price, 0.75), quantile_cont(price, 1)] AS e FROM ord),
b AS (SELECT CASE WHEN price <= e[2] THEN 0 WHEN price <= e[3] THEN 1 WHEN price <= e[4] THEN 2 ELSE 3 END AS bin, e FROM ord, e) SELECT bin::INT AS bin, any_value(e[bin + 1]) AS low, any_value(e[bin + 2]) AS high, count(*) AS n FROM b GROUP BY bin""")
def quantile_bins(spark, d):
    df = orders(spark, d)
    edges = features.quantile_edges(df, "price", 4).first()[0]
    number = features.bin_number(F.col("price"), edges)
    counted = df.select(number.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    e = F.array(*[F.lit(float(x)) for x in edges])
    return counted.select("bin", F.element_at(e, F.col("bin") + 1).alias("low"), F.element_at(e, F.col("bin") + 2).alias("high"), "n")


def _frame(spark, d):
    df = orders(spark, d)
    found = features.learn_frame(df, ["id", "status", "nation"], 12, 4)
    return found, found.apply(df, ["id", "status"])


@query(f"""WITH {ORD}, e AS (SELECT quantile_cont(price, [0, 0.25, 0.5, 0.75, 1]) AS p, quantile_cont(balance, [0, 0.25, 0.5, 0.75, 1]) AS b FROM ord),
s AS (SELECT p, b, list_transform(p, lambda x: round(x, 3)) AS ps, list_transform(b, lambda x: round(x, 3)) AS bs FROM e)
SELECT id, status, CASE WHEN price IS NULL THEN 'Missing' WHEN price <= p[2] THEN '(' || round(ps[1] - 0.001, 3) || ', ' || ps[2] || ']' WHEN price <= p[3] THEN '(' || ps[2] || ', ' || ps[3] || ']' WHEN price <= p[4] THEN '(' || ps[3] || ', ' || ps[4] || ']' ELSE '(' || ps[4] || ', ' || ps[5] || ']' END AS price,
CASE WHEN balance IS NULL THEN 'Missing' WHEN balance <= b[2] THEN '(' || round(bs[1] - 0.001, 3) || ', ' || bs[2] || ']' WHEN balance <= b[3] THEN '(' || bs[2] || ', ' || bs[3] || ']' WHEN balance <= b[4] THEN '(' || bs[3] || ', ' || bs[4] || ']' ELSE '(' || bs[4] || ', ' || bs[5] || ']' END AS balance,
coalesce(priority, 'Missing') AS priority, coalesce(segment, 'Missing') AS segment FROM ord, s""")
def modelling_frame(spark, d):
    return _frame(spark, d)[1]


@query(f"""WITH {ORD}, p AS (SELECT 'segment' AS feature, segment AS value FROM ord UNION ALL SELECT 'priority', priority FROM ord UNION ALL SELECT 'rich', CASE WHEN balance >= 0 THEN 'Yes' ELSE 'No' END FROM ord), c AS (SELECT feature, value, count(*) AS n FROM p GROUP BY ALL),
k AS (SELECT *, count(*) OVER (PARTITION BY feature) AS v, min(value) OVER (PARTITION BY feature) AS least FROM c) SELECT feature || '_' || value AS component, feature, value, n, n / (SELECT count(*) FROM ord) AS prevalence FROM k WHERE v <> 2 OR value <> least""")
def one_hot_prevalence(spark, d):
    df = orders(spark, d).withColumn("rich", clean.threshold_bin(F.col("balance"), 0, "Yes", "No"))
    return features.vocabulary(df, ["segment", "priority", "rich"])


@query("SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 8) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 8) AS p_retailprice, 0.0 AS one FROM part")
def standardize(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(1.0).alias("one"))
    return features.standardize(df, ["p_size", "p_retailprice", "one"]).select("p_partkey", F.round("p_size", 8).alias("p_size"), F.round("p_retailprice", 8).alias("p_retailprice"), "one")


@query("WITH b AS (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_size END AS p_size FROM part) SELECT p_partkey, coalesce(p_size, (SELECT median(p_size) FROM b))::DOUBLE AS p_size FROM b")
def impute_median(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("p_size"))
    return features.impute_median(df, ["p_size"])


@query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, (flag = 'R')::INT AS \"flag:R\", (status = 'F')::INT AS \"status:F\" FROM lines")
def multi_hot(spark, d):
    df = patterns.items(lines(spark, d), _FOUR).select("l_orderkey", "l_linenumber", "items")
    return features.multi_hot(df, "items", ["flag:R", "status:F"]).drop("items")


# --- scores and metrics -----------------------------------------------------------------------------------------------

_CARD = {"segment_BUILDING": 3, "priority_1-URGENT": 2, "segment_MACHINERY": 1, "priority_5-LOW": 4}
_CARD_SQL = "(CASE segment WHEN 'BUILDING' THEN 3 WHEN 'MACHINERY' THEN 1 ELSE 0 END + CASE priority WHEN '1-URGENT' THEN 2 WHEN '5-LOW' THEN 4 ELSE 0 END)"
SCORED = f"{ORD}, scored AS (SELECT id, status, (status = 'F')::INT AS y, {_CARD_SQL} + floor(price / 60000) AS s FROM ord WHERE status IN ('F', 'O'))"


def scored(spark, d):
    df = screening.binary(orders(spark, d), "status", "F", "O")
    points = score.apply_card(df, ["segment", "priority"], _CARD, ["id", "status", "y", "price"])
    return points.select("id", "status", "y", (F.col("score") + F.floor(F.col("price") / 60000)).cast("double").alias("s"))


@query(f"WITH {ORD} SELECT id, {_CARD_SQL}::INT AS score FROM ord")
def points_apply(spark, d):
    return score.apply_card(orders(spark, d), ["segment", "priority"], _CARD, ["id"])


@query(f"WITH {ORD} SELECT id, {_CARD_SQL}::BIGINT AS score FROM ord")
def points_apply_long(spark, d):
    long = features.components(orders(spark, d), ["segment", "priority"], ["id"])
    return score.apply_card_long(long, spark.createDataFrame(list(_CARD.items()), "component string, points long"), "id")


_CURVE = """, g AS (SELECT {sign}s AS s, sum(y) AS p, sum(1 - y) AS n FROM scored GROUP BY s), r AS (SELECT s, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM g WINDOW w AS (ORDER BY s DESC)),
k AS (SELECT *, lag(tp) OVER w - 2 * tp + lead(tp) OVER w AS b, lag(fp) OVER w - 2 * fp + lead(fp) OVER w AS c FROM r WINDOW w AS (ORDER BY s DESC)),
roc AS (SELECT {sign}s AS threshold, fp / neg AS fpr, tp / pos AS tpr FROM k WHERE b IS NULL OR b <> 0 OR c <> 0 UNION ALL SELECT {sign}'Infinity'::DOUBLE, 0, 0)"""


@query(f"WITH {SCORED}{_CURVE.format(sign='')} SELECT CASE WHEN isinf(threshold) THEN 1e9 ELSE threshold END AS threshold, fpr, tpr FROM roc")
def roc_curve(spark, d):
    return metrics.roc_curve(scored(spark, d), "s", F.col("y") == 1).select(F.when(F.col("threshold") > 1e300, 1e9).otherwise(F.col("threshold")).alias("threshold"), "fpr", "tpr")


@query(f"WITH {SCORED}{_CURVE.format(sign='')}, a AS (SELECT (fp - coalesce(lag(fp) OVER w, 0)) * (tp + coalesce(lag(tp) OVER w, 0)) / 2 AS a, pos, neg FROM r WINDOW w AS (ORDER BY s DESC)) SELECT round(sum(a) / max(pos * neg), 10) AS auc FROM a")
def auc(spark, d):
    return metrics.auc(scored(spark, d), "s", F.col("y") == 1).select(F.round("auc", 10).alias("auc"))


_AT = "SELECT threshold, tpr AS sensitivity, 1 - fpr AS specificity FROM roc ORDER BY (tpr >= 0.9) DESC, CASE WHEN tpr >= 0.9 THEN round(1 - fpr, 12) ELSE tpr END DESC, {order} LIMIT 1"


@query(f"WITH {SCORED}{_CURVE.format(sign='')} {_AT.format(order='-threshold')}")
def threshold_at_sensitivity(spark, d):
    return metrics.threshold_at(metrics.roc_curve(scored(spark, d), "s", F.col("y") == 1))


@query(f"WITH {SCORED}{_CURVE.format(sign='-')} {_AT.format(order='threshold')}")
def threshold_at_most(spark, d):
    return metrics.threshold_at(metrics.roc_curve(scored(spark, d), "s", F.col("y") == 1, at_most=True), at_most=True)


@query(f"WITH {SCORED}{_CURVE.format(sign='')} SELECT s AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, (neg - fp)::BIGINT AS tn, (pos - tp)::BIGINT AS fn, tp / pos AS sensitivity, (neg - fp) / neg AS specificity, tp / (tp + fp) AS ppv, CASE WHEN neg - fp + pos - tp > 0 THEN (neg - fp) / (neg - fp + pos - tp) END AS npv, (tp + fp)::BIGINT AS predicted_positive, (neg - fp + pos - tp)::BIGINT AS predicted_negative FROM r")
def confusion_profile(spark, d):
    return metrics.confusion_profile(scored(spark, d), "s", F.col("y") == 1)


@query(f"WITH {SCORED} SELECT status AS label, count(*) AS n, avg(s) AS mean, median(s) AS median, stddev_pop(s) AS deviation, quantile_cont(s, 0.25) AS p25, quantile_cont(s, 0.75) AS p75 FROM scored GROUP BY status")
def score_summary(spark, d):
    return metrics.score_summary(scored(spark, d), "s", "status")


@query(f"WITH {DOCS} SELECT a.doc_id, a.target, a.n_chars, b.source FROM (SELECT * FROM docs WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT * FROM docs WHERE doc_id % 3 <> 0) b ON a.doc_id = b.doc_id AND a.target IS NOT DISTINCT FROM b.target UNION ALL SELECT doc_id, target, n_chars, NULL FROM docs WHERE doc_id % 6 = 0 UNION ALL SELECT doc_id, target, NULL, source FROM docs WHERE doc_id % 6 = 3")
def strategy_outer_merge(spark, d):
    df = docs(spark, d)
    return score.merge_exports([df.where("doc_id % 6 <> 3").select("doc_id", "target", "n_chars"), df.where("doc_id % 6 <> 0").select("doc_id", "target", "source")], "doc_id", "target")


@query(f"WITH {DOCS}, s AS (SELECT coalesce(target, 'Missing') AS target, n_chars FROM docs), l AS (SELECT unnest(['Missing', 'No buscada']) AS label), c AS (SELECT target AS label, count(*) AS n, count(*) FILTER (n_chars >= 2000) AS long, count(*) FILTER (n_chars < 500) AS short FROM s WHERE target IN ('Missing', 'No buscada') GROUP BY target) SELECT l.label, coalesce(n, 0) AS n, coalesce(long, 0) AS long, coalesce(short, 0) AS short FROM l LEFT JOIN c ON l.label = c.label")
def screening_summary(spark, d):
    df = screening.to_screen(docs(spark, d), "target")
    return screening.summary(df, "target", {"long": F.col("n_chars") >= 2000, "short": F.col("n_chars") < 500}, ["Missing", "No buscada"])


@query(f"WITH {DOCS} SELECT doc_id, n_chars / 10000 AS p, 0.25 AS x_threshold_for_min_sensitivity, n_chars / 10000 >= 0.25 AS x_predicted_positive, CASE WHEN n_chars / 10000 >= 0.25 THEN 'positive' ELSE 'not_positive' END AS x_predicted_label FROM docs")
def screening_by_probability(spark, d):
    return screening.by_probability(docs(spark, d).select("doc_id", (F.col("n_chars") / 10000).alias("p")), "p", 0.25, "x", "positive")


# --- models (no SQL) --------------------------------------------------------------------------------------------------


def _labelled_frame(spark, d):
    """Labelled documents as a modelling frame with y, and how it was made."""
    df = docs(spark, d).withColumn("first", F.pmod("doc_id", F.lit(7)).cast("string"))
    train = screening.binary(df, "target", "positive", "negative")
    made = features.learn_frame(train.select("doc_id", "lang", "n_chars", "first"), ["doc_id"], 12, 4)
    return df, made, made.apply(train, ["doc_id", "target", "y"])


@query()
def logistic_points_card(spark, d):
    _, made, frame = _labelled_frame(spark, d)
    return spark.createDataFrame(score.points_card(score.fit_logistic(frame, made.columns, "y"), frame), "component string, coefficient double, odds_ratio double, prevalence double, points int")


@query()
def score_oof(spark, d):
    _, made, frame = _labelled_frame(spark, d)
    return score.fit_strategy("automatic", frame, made.columns, "doc_id", "y", folds=3).scored


@query()
def score_patients(spark, d):
    _, made, frame = _labelled_frame(spark, d)
    return score.patient_scores(frame, score.fit_strategy("automatic", frame, made.columns, "doc_id", "y", folds=3), "doc_id", "target", "positive")


@query()
def screening_candidates(spark, d):
    df, made, frame = _labelled_frame(spark, d)
    fitted = score.fit_strategy("automatic", frame, made.columns, "doc_id", "y", folds=3)
    return score.patient_scores(made.apply(screening.to_screen(df, "target"), ["doc_id", "target"], clamp=True), fitted, "doc_id", "target", "positive")


@query()
def gbt_benchmark(spark, d):
    _, made, frame = _labelled_frame(spark, d)
    return score.tree_probability(score.boosted_trees(frame, made.columns, "y", trees=10), frame, ["doc_id", "y"])


@query()
def permutation_importance(spark, d):
    _, made, frame = _labelled_frame(spark, d)
    return explain.permutation_importance(frame, made.columns, "y", "doc_id", trees=5)


@query()
def rule_folds(spark, d):
    """AUC by fold of trees on the sets of other columns' values, as text and back."""
    _, made, frame = _labelled_frame(spark, d)
    text = F.concat(F.lit("frozenset({"), F.concat_ws(", ", *[F.concat(F.lit(f"'{c}="), c, F.lit("'")) for c in ("lang", "first")]), F.lit("})"))
    sets = frame.select("doc_id", "y", patterns.parse_itemset(text).alias("items"))
    # Values of two columns, each of at most twelve.
    found = sorted(r[0] for r in sets.select(F.explode("items")).distinct().collect())
    return validate.fold_auc(features.multi_hot(sets, "items", found), found, "y", "doc_id", trees=10)


def _two_labels(spark, d):
    df, _, frame = _labelled_frame(spark, d)
    toxic = df.where("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    return frame.withColumnRenamed("y", "good").join(toxic, "doc_id")


@query()
def label_grid(spark, d):
    return validate.grid_search(_two_labels(spark, d), ["lang", "n_chars", "first"], ["good", "toxic"], "doc_id", trees=(5,), depths=(2, 3), rates=(0.1,), folds=2)


def _label_scores(spark, d):
    """Probabilities of two labels, read off text by hand: what the reports need of a model."""
    rows = _two_labels(spark, d)
    sums = [rows.select(F.lit(c).alias("label"), F.col(c).alias("y"), (F.pmod(F.col("doc_id") * k, F.lit(101)) / 101).alias("probability")) for c, k in (("good", 7), ("toxic", 13))]
    return sums[0].unionByName(sums[1])


_LONG = f"""{DOCS}, long AS (SELECT 'good' AS label, CASE target WHEN 'positive' THEN 1 ELSE 0 END AS y, (doc_id * 7 % 101) / 101 AS probability FROM docs WHERE target IS NOT NULL AND toxic IS NOT NULL
UNION ALL SELECT 'toxic', toxic::INT, (doc_id * 13 % 101) / 101 FROM docs WHERE target IS NOT NULL AND toxic IS NOT NULL)"""


@query(f"""WITH {_LONG}, c AS (SELECT coalesce(label, 'micro') AS label, count(*) FILTER (y = 1 AND probability >= 0.5) AS tp, count(*) FILTER (y = 0 AND probability >= 0.5) AS fp, count(*) FILTER (y = 1 AND probability < 0.5) AS fn FROM long GROUP BY GROUPING SETS ((label), ()))
SELECT label, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, tp + fn AS support FROM c""")
def label_report(spark, d):
    return validate.label_report(_label_scores(spark, d))


@query(f"""WITH {_LONG}, s AS (SELECT label, probability, y FROM long UNION ALL SELECT 'micro', probability, y FROM long), g AS (SELECT label, probability, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY ALL),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY label ORDER BY probability ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
a AS (SELECT label, sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS auc FROM r GROUP BY label)
SELECT label, round(auc, 9) AS auc FROM a UNION ALL SELECT 'macro', round(avg(auc), 9) FROM a WHERE label <> 'micro'""")
def label_auc(spark, d):
    return validate.label_auc(_label_scores(spark, d), ["good", "toxic"]).select("label", F.round("auc", 9).alias("auc"))


_STUMP_ROWS = f"""{DOCS}, rows AS (SELECT label, y, lang, source, size FROM (SELECT lang, source, CASE WHEN n_chars >= 300 THEN least(n_chars // 300, 40) END AS size,
  CASE target WHEN 'positive' THEN 1 WHEN 'negative' THEN 0 END AS good, toxic::INT AS toxic FROM docs) UNPIVOT (y FOR label IN (good, toxic)))"""
#: The best first split of each label by gain over all values and cuts (null on either side), and the probability that its leaf gives each row.
_STUMP = f"""{_STUMP_ROWS}, t AS (SELECT label, count(*) AS n, sum(y) AS pos, avg(y) AS p FROM rows GROUP BY label),
v AS (SELECT label, 0 AS col, lang AS v, NULL AS cut, false AS side, count(*) AS nl, sum(y) AS pl FROM rows GROUP BY ALL UNION ALL SELECT label, 1, source, NULL, false, count(*), sum(y) FROM rows GROUP BY ALL),
cuts AS (SELECT DISTINCT size AS cut FROM rows WHERE size IS NOT NULL),
m AS (SELECT label, 2 AS col, NULL AS v, cut, side, count(*) AS nl, sum(y) AS pl FROM rows, cuts, (SELECT unnest([false, true]) AS side) WHERE size <= cut OR side AND size IS NULL GROUP BY ALL),
g AS (SELECT x.*, n, pos, p, ln(p / (1 - p)) AS start, p * (1 - p) AS w, nl * p - pl AS gl, (n - nl) * p - (pos - pl) AS gr FROM (SELECT * FROM v UNION ALL SELECT * FROM m) x JOIN t USING (label)),
b AS (SELECT *, (gl * gl / (nl * w + 1) + gr * gr / ((n - nl) * w + 1)) / 2 AS gain FROM g WHERE nl < n AND nl * w >= 1 AND (n - nl) * w >= 1),
best AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(gain, 7) DESC, col, cut, v NULLS LAST, side) = 1),
stump AS (SELECT r.label, r.y, 1 / (1 + exp(gl / (nl * w + 1) - start)) AS yes, 1 / (1 + exp(gr / ((n - nl) * w + 1) - start)) AS no,
  CASE col WHEN 0 THEN r.lang IS NOT DISTINCT FROM v WHEN 1 THEN r.source IS NOT DISTINCT FROM v ELSE coalesce(size <= cut, side) END AS l FROM rows r JOIN best USING (label))"""


def _stumps(spark, d):
    """(label, y, probability) of trees of one split for two labels, one fit for both, on texts and on a number with nulls."""
    rows = docs(spark, d).select("doc_id", "lang", "source", F.when(F.col("n_chars") >= 300, F.least(F.floor(F.col("n_chars") / 300), F.lit(40))).alias("size"), F.when(F.col("target").isNotNull(), (F.col("target") == "positive").cast("int")).alias("good"), F.col("toxic").cast("int").alias("toxic"))
    how = boost.Settings(trees=1, depth=1, rate=1.0, subsample=1.0, columns=1.0)
    labels = ["good", "toxic"]
    found = boost.fit(rows, ["lang", "source", "size"], [boost.Model(c, settings=how) for c in labels], ["doc_id"]).probabilities()
    return found.where("y is not null").select(F.get(F.array(*map(F.lit, labels)), F.col("model")).alias("label"), "y", "probability")


@query(f"WITH {_STUMP} SELECT label, round(CASE WHEN l THEN yes ELSE no END, 5) AS probability, count(*) AS n, sum(y)::BIGINT AS positives FROM stump GROUP BY ALL")
def boosted_split(spark, d):
    """What the best first split makes of all rows: its leaves, their probabilities and rows."""
    return _stumps(spark, d).groupBy("label", F.round("probability", 5).alias("probability")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("positives"))


@query(f"""WITH {_STUMP}, c AS (SELECT coalesce(label, 'micro') AS label, count(*) FILTER (y = 1 AND hit) AS tp, count(*) FILTER (y = 0 AND hit) AS fp, count(*) FILTER (y = 1 AND NOT hit) AS fn FROM (SELECT *, CASE WHEN l THEN yes ELSE no END >= 0.5 AS hit FROM stump) GROUP BY GROUPING SETS ((label), ()))
SELECT label, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, (tp + fn)::BIGINT AS support FROM c""")
def boosted_label_report(spark, d):
    """The report of fitted trees: precision and recall by label, and of all labels together."""
    return validate.label_report(_stumps(spark, d))


@query()
def boosted_out_of_fold(spark, d):
    """Probabilities of trees for documents of the folds that they did not see, all folds grown in the same passes."""
    train = screening.binary(docs(spark, d), "target", "positive", "negative")
    k = sample.fold_count(sample.class_counts(train, "y"), 3)
    return score.boosted_out_of_fold(sample.folds(train, "y", k, "doc_id").select("doc_id", "lang", "source", "n_chars", "y", "fold"), ["lang", "source", "n_chars"], "y", ["doc_id", "y"], k, trees=10)[1]


# --- clustering -------------------------------------------------------------------------------------------------------


@query("SELECT label AS cluster, count(*) AS n, avg(embedding[1]::DOUBLE) AS x, avg(embedding[2]::DOUBLE) AS y FROM embeddings GROUP BY label")
def cluster_profile(spark, d):
    df = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return cluster.profile(df, "label", ["x", "y"])


@query("""WITH q AS (SELECT vec_id AS a, embedding::DOUBLE[] AS u FROM embeddings WHERE vec_id % 100 = 0) SELECT a, vec_id AS b, round(list_distance(u, embedding::DOUBLE[]), 6) AS euclidean, round(1 - list_cosine_similarity(u, embedding::DOUBLE[]), 6) AS cosine,
round(list_sum(list_transform(list_zip(u, embedding::DOUBLE[]), lambda x: abs(x[1] - x[2]))), 6) AS manhattan, round(list_max(list_transform(list_zip(u, embedding::DOUBLE[]), lambda x: abs(x[1] - x[2]))), 6) AS chebyshev FROM q, embeddings""")
def pairwise_distance(spark, d):
    e = table(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("x"))
    # A stated set of queries against all rows.
    return all_distances(rows.where("id % 100 = 0"), rows, 6)


def _points(spark, d):
    """One column for each of an embedding's numbers, as many as the longest has."""
    e = table(spark, d, "embeddings")
    n = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    return e.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(n)])


def _dimensions(points):
    return points.columns[2:]


@query()
def agglomerative_clusters(spark, d):
    df = _points(spark, d)
    return cluster.agglomerative(features.standardize(df, _dimensions(df)), "vec_id", _dimensions(df), 3, "euclidean")


@query()
def kmeans_clusters(spark, d):
    df = _points(spark, d)
    return cluster.kmeans(df, "vec_id", _dimensions(df), 3)


@query()
def pca_projection(spark, d):
    df = _points(spark, d)
    return cluster.project(df, "vec_id", _dimensions(df))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings), d AS (SELECT a.vec_id, list_distance(a.x, b.x) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS place FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT vec_id, CAST(place AS INTEGER) AS place, round(distance, 6) AS distance FROM d WHERE place <= 5""")
def neighbour_graph(spark, d):
    """Distances of the five nearest of each vector."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    points = stored(e.withColumn("c", F.monotonically_increasing_id()), "points")
    near = layout.neighbours(points.select("c", "x"), 5, "euclidean", points.count())
    each = near.join(points.select("c", "vec_id"), "c").select("vec_id", F.posexplode(F.array_sort("far")).alias("place", "distance"))
    return each.select("vec_id", (F.col("place") + 1).alias("place"), F.round("distance", 6).alias("distance"))


@query()
def embedding_layout(spark, d):
    df = _points(spark, d)
    return cluster.layout(df, "vec_id", _dimensions(df), 10)
