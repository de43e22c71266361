"""Spec-driven curation: criteria filters, missing strategies, value filters, domains and bounds, each with its audit.

A spec is a list of SpecRow. Each step is one projection (and one filter), and its audit one aggregation over the input.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn import presets
from cairn.operators.clean import missing_to_null, number, quoted, recode, select_required
from cairn.operators.rules import is_value, parse_bounds, parse_criteria, parse_strategy, remapped


@dataclass(frozen=True)
class SpecRow:
    variable: str
    label: str = ""
    criteria: str = ""
    missing_strategy: str = ""


def spec_rows(cells: Iterable[Sequence]) -> list[SpecRow]:
    """Rows of a headerless sheet with four columns; blank variables and the header row are left out."""
    out = []
    for row in cells:
        values = ["" if v is None else str(v).strip() for v in [*row, "", "", "", ""][:4]]
        if values[0] and values[0] != presets.SPEC_HEADER:
            out.append(SpecRow(*values))
    return out


def prune(df: DataFrame, spec: Sequence[SpecRow], id_column: str, targets: Sequence[str], recodes=presets.SELECTION_RECODES) -> DataFrame:
    """Identifier, targets and the spec's variables in order, with missing numbers as null and the selection's recodes."""
    out = missing_to_null(select_required(df, [id_column, *targets, *[s.variable for s in spec]]))
    for column, old, new in recodes:
        if column in out.columns:
            out = out.withColumn(column, recode(quoted(column), {old: new}))
    return out


def _one(df: DataFrame, sums: Mapping[str, Column]) -> dict[str, int]:
    """One row of counts by name."""
    if not sums:
        return {}
    keys = list(sums)
    row = df.agg(*[sums[k].alias(f"_{i}") for i, k in enumerate(keys)]).first()
    return {k: row[i] for i, k in enumerate(keys)}


def criteria_plan(df: DataFrame, spec: Sequence[SpecRow]) -> tuple[DataFrame, list[tuple[SpecRow, str]]]:
    """df with remapped values and a boolean _keep_<i> for each filtering variable."""
    kept: list[tuple[SpecRow, str]] = []
    for i, row in enumerate(spec):
        if (rule := parse_criteria(row.criteria)) and row.variable in df.columns:
            df = df.withColumn(row.variable, rule.value(quoted(row.variable), df.schema[row.variable].dataType))
            if rule.filters:
                df = df.withColumn(f"_keep_{i}", rule.keeps(quoted(row.variable)))
                kept.append((row, f"_keep_{i}"))
    return df, kept


def criteria_audit_frame(df: DataFrame, spec: Sequence[SpecRow]) -> DataFrame:
    """(variable, newly_dropped, failing): rows that each filter drops after those before it, and rows that fail it. One pass."""
    plan, kept = criteria_plan(df, spec)
    passed, sums = F.lit(True), []
    for i, (_, name) in enumerate(kept):
        sums += [F.count_if(passed & ~F.col(name)).alias(f"new_{i}"), F.count_if(~F.col(name)).alias(f"fail_{i}")]
        passed = passed & F.col(name)
    if not kept:
        return df.sparkSession.createDataFrame([], "variable string, newly_dropped long, failing long")
    pairs = [F.struct(F.lit(row.variable).alias("variable"), F.col(f"new_{i}").alias("newly_dropped"), F.col(f"fail_{i}").alias("failing")) for i, (row, _) in enumerate(kept)]
    return plan.agg(*sums).select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def apply_criteria(df: DataFrame, spec: Sequence[SpecRow]) -> tuple[DataFrame, dict]:
    """Remapped and filtered rows, and the audit by variable (two aggregations), with the totals as __overall__."""
    parsed = [(row, rule) for row in spec if (rule := parse_criteria(row.criteria)) and row.variable in df.columns]
    sums: dict[str, Column] = {"rows": F.count(F.lit(1))}
    for row, rule in parsed:
        c = quoted(row.variable)
        if rule.remap:
            sums[f"remapped:{row.variable}"] = F.count_if(is_value(c, rule.remap[0]))
        if rule.replace:
            sums[f"replaced:{row.variable}"] = F.count_if(number(c).isin(*[float(v) for v in rule.replace]))
    before = _one(df, sums)
    plan, kept = criteria_plan(df, spec)
    passed, drops = F.lit(True), {}
    for row, name in kept:
        drops[row.variable] = F.count_if(passed & ~F.col(name))
        passed = passed & F.col(name)
    dropped = _one(plan, drops)
    audit: dict = {}
    for row, rule in parsed:
        audit[row.variable] = {
            "criteria": row.criteria, "replacements_applied": before.get(f"replaced:{row.variable}", 0), "value_remapped_count": before.get(f"remapped:{row.variable}", 0),
            "dropped_row_count": dropped.get(row.variable, 0), "allowed_min": rule.low, "allowed_max": rule.high, "min_inclusive": rule.low_included, "max_inclusive": True,
        } | (dict(zip(("remap_source", "remap_target"), rule.remap)) if rule.remap else {})
    gone = sum(dropped.values())
    audit["__overall__"] = {"input_row_count": before["rows"], "output_row_count": before["rows"] - gone, "discarded_row_count": gone}
    return plan.where(passed).drop(*[name for _, name in kept]), audit


def strategy_value(c: Column, kind: T.DataType, text: str) -> Column:
    """A column after its missing strategy. Fills touch nulls alone, remaps only cells equal to their left side."""
    s, numeric = parse_strategy(text), isinstance(kind, T.NumericType)
    if s.kind == "fill":
        return F.coalesce(c.cast("string"), F.lit(s.new))
    if s.kind == "missing":
        return c.cast("double") if numeric else F.coalesce(c, F.lit(presets.MISSING))
    return remapped(c, kind, s.old, s.new) if s.kind == "remap" else c


def apply_strategies(df: DataFrame, spec: Sequence[SpecRow]) -> tuple[DataFrame, dict]:
    """Columns after their missing strategies, and the audit by variable that has one (one aggregation)."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    found = [(row, parse_strategy(row.missing_strategy)) for row in spec if row.missing_strategy.strip() and row.variable in kinds]
    sums: dict[str, Column] = {}
    for row, s in found:
        c = quoted(row.variable)
        sums[f"before:{row.variable}"] = F.count_if(c.isNull())
        sums[f"after:{row.variable}"] = F.count_if(strategy_value(c, kinds[row.variable], row.missing_strategy).isNull())
        if s.kind == "remap":
            sums[f"remap:{row.variable}"] = F.count_if(is_value(c, s.old))
    counts = _one(df, sums)
    audit: dict = {}
    for row, s in found:
        if s.kind == "unknown":
            audit[row.variable] = {"strategy": row.missing_strategy, "filled_count": 0, "warning": "unhandled_strategy"}
            continue
        before, after = counts[f"before:{row.variable}"], counts[f"after:{row.variable}"]
        info = {"strategy": row.missing_strategy, "remapped_count": counts.get(f"remap:{row.variable}", 0), "filled_count": 0 if s.kind == "remap" else before - after, "remaining_null_count": after}
        if s.kind == "remap":
            info |= {"remap_source": s.old, "remap_target": s.new}
        else:
            info["applied_fill_value"] = s.new if s.kind == "fill" else "NA" if isinstance(kinds[row.variable], T.NumericType) else presets.MISSING
        audit[row.variable] = info
    values = {row.variable: strategy_value(quoted(row.variable), kinds[row.variable], row.missing_strategy) for row, _ in found}
    return df.select(*[values[c].alias(c) if c in values else quoted(c) for c in df.columns]), audit


def filter_values(df: DataFrame, column: str, values: Sequence[str]) -> tuple[DataFrame, dict]:
    """Rows whose trimmed value is allowed, and the counts."""
    allowed = [v.strip() for v in values if v.strip()]
    if column not in df.columns:
        raise ValueError(f"Filter column '{column}' not found")
    if not allowed:
        raise ValueError("No allowed values for the row filter")
    ok = F.coalesce(F.trim(quoted(column).cast("string")).isin(allowed), F.lit(False))
    counts = _one(df, {"input_row_count": F.count(F.lit(1)), "output_row_count": F.count_if(ok)})
    return df.where(ok), {"filter_column": column, "allowed_values": allowed, **counts, "discarded_row_count": counts["input_row_count"] - counts["output_row_count"]}


def domain_of(row: SpecRow, domains: Mapping[str, Sequence[str]] = presets.ENUM_DOMAINS) -> list[str] | None:
    """Allowed values of a variable, with what its strategy fills in."""
    if row.variable not in domains:
        return None
    s = parse_strategy(row.missing_strategy)
    return sorted({*domains[row.variable], *(["No"] if s.kind == "fill" else []), *([presets.MISSING] if s.kind == "missing" else [])})


@dataclass(frozen=True)
class Report:
    """Rows that sums over a table give: reports are read together with others in one pass (reports) or alone (table)."""

    schema: str
    sums: Sequence[Column]
    rows: Sequence[Column]

    def table(self, df: DataFrame) -> DataFrame:
        if not self.rows:
            return df.sparkSession.createDataFrame([], self.schema)
        return df.agg(*self.sums).select(F.explode(F.array(*self.rows)).alias("x")).select("x.*")


def reports(df: DataFrame, *wanted: Report) -> list[list[Row]]:
    """Rows of each report, all of one aggregation over df."""
    sums = [s for r in wanted for s in r.sums]
    arrays = [(F.array(*r.rows) if r.rows else F.lit(None)).alias(f"r{i}") for i, r in enumerate(wanted)]
    # One row for a column of the table in each report.
    found = df.agg(*sums).select(*arrays).first() if sums else [None] * len(wanted)
    return [list(rows or []) for rows in found]


#: Values of a closed variable that a report shows at most.
SHOWN = 200


def domain_table(df: DataFrame, allowed: Mapping[str, Sequence[str]], shown: int = SHOWN) -> DataFrame:
    """(variable, observed, invalid, n_observed, n_invalid) of each variable: its different values and those not allowed, sorted.

    At most shown of the allowed and of the other values are listed, the counts cover all. Different values are found by a
    shuffle on variable and value, and each task passes on at most shown of a variable: free text by mistake fills no row.
    """
    schema = "variable string, observed array<string>, invalid array<string>, n_observed long, n_invalid long"
    if not allowed:
        return df.sparkSession.createDataFrame([], schema)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), quoted(c).cast("string").alias("value"), F.lit(c).alias("variable"), quoted(c).cast("string").isin(*values).alias("ok")) for i, (c, values) in enumerate(allowed.items())])
    different = df.select(F.explode(cells).alias("x")).select("x.*").where("value is not null").distinct()
    counts = different.groupBy("i").agg(F.count(F.lit(1)).alias("n_observed"), F.count_if(~F.col("ok")).alias("n_invalid"))
    first = Window.partitionBy("i", "ok").orderBy("value")
    listed = different.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= shown)
    lists = listed.groupBy("i").agg(F.array_sort(F.collect_list("value")).alias("observed"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("value")))).alias("invalid"))
    every = df.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("variable")) for i, c in enumerate(allowed)])).alias("x")).select("x.*")
    none = F.array().cast("array<string>")
    return every.join(counts, "i", "left").join(lists, "i", "left").select("variable", F.coalesce("observed", none).alias("observed"), F.coalesce("invalid", none).alias("invalid"), F.coalesce("n_observed", F.lit(0)).alias("n_observed"), F.coalesce("n_invalid", F.lit(0)).alias("n_invalid"))


def bounds_report(bounds: Mapping[str, str]) -> Report:
    sums, rows = [], []
    for i, (name, b) in enumerate((c, b) for c, t in bounds.items() if (b := parse_bounds(t))):
        v = number(quoted(name))
        below = {"between": v < b.low, "gt": v <= b.low}.get(b.kind) if b.low is not None else None
        above = {"between": v > b.high, "le": v > b.high, "lt": v >= b.high}.get(b.kind) if b.high is not None else None
        low = F.count_if(below) if below is not None else F.lit(0).cast("long")
        high = F.count_if(above) if above is not None else F.lit(0).cast("long")
        sums += [F.count(v).alias(f"n{i}"), low.alias(f"b{i}"), high.alias(f"a{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        rows.append(F.struct(F.lit(name).alias("variable"), F.lit(b.kind).alias("kind"), F.col(f"n{i}").alias("n"), F.col(f"b{i}").alias("below"), (F.col(f"n{i}") - F.col(f"b{i}") - F.col(f"a{i}")).alias("within"), F.col(f"a{i}").alias("above"), F.col(f"lo{i}").alias("least"), F.col(f"hi{i}").alias("most")))
    return Report("variable string, kind string, n long, below long, within long, above long, least double, most double", sums, rows)


def null_report(columns: Sequence[str]) -> Report:
    sums = [F.count(F.lit(1)).alias("_n"), *[F.count(quoted(c)).alias(f"_c{i}") for i, c in enumerate(columns)]]
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("non_null"), (F.col("_n") - F.col(f"_c{i}")).alias("nulls")) for i, c in enumerate(columns)]
    return Report("column string, non_null long, nulls long", sums, rows)


def validate_domains(df: DataFrame, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """(variable, observed, invalid): different values by variable, and those not allowed; the first SHOWN of each."""
    return domain_table(df, allowed).select("variable", "observed", "invalid")


def validate_bounds(df: DataFrame, bounds: Mapping[str, str]) -> DataFrame:
    """(variable, kind, n, below, within, above, least, most) of numeric variables by criteria text. One pass."""
    return bounds_report(bounds).table(df)


def null_counts(df: DataFrame) -> DataFrame:
    """(column, non_null, nulls) of every column. One pass."""
    return null_report(df.columns).table(df)


class ValidationError(ValueError):
    """A curated table that breaks its spec."""


def curate(df: DataFrame, spec: Sequence[SpecRow], id_column: str = presets.ID_COLUMN, targets: Sequence[str] = (presets.TARGET,), filter_column: str | None = None, allowed: Sequence[str] = (), domains: Mapping[str, Sequence[str]] = presets.ENUM_DOMAINS) -> tuple[DataFrame, dict]:
    """The curated table and its report; hard_failures in the report break the spec."""
    source_rows = df.count()
    out, criteria = apply_criteria(prune(df, spec, id_column, targets), spec)
    out, missing = apply_strategies(out, spec)
    row_filter = {}
    if filter_column:
        out, row_filter = filter_values(out, filter_column, allowed)
    kinds = {f.name: f.dataType for f in out.schema.fields}
    closed = {s.variable: d for s in spec if (d := domain_of(s, domains))}
    ranged = {s.variable: s.criteria for s in spec if isinstance(kinds[s.variable], T.NumericType)}
    nulls, ranges = ({r[0]: r for r in rows} for rows in reports(out, null_report(out.columns), bounds_report(ranged)))
    checked = {r["variable"]: r for r in domain_table(out, closed).collect()}
    columns, failures = {}, []
    for s in spec:
        info = {"dtype": kinds[s.variable].simpleString(), "non_null_count": nulls[s.variable]["non_null"], "null_count": nulls[s.variable]["nulls"], "criteria": s.criteria, "missing_strategy": s.missing_strategy}
        if s.variable in checked:
            r = checked[s.variable]
            info |= {"allowed_values": domain_of(s, domains), "observed_values": r["observed"], "invalid_values": r["invalid"], "observed_value_count": r["n_observed"], "invalid_value_count": r["n_invalid"]}
            if r["invalid"]:
                more = f" and {r['n_invalid'] - len(r['invalid'])} more" if r["n_invalid"] > len(r["invalid"]) else ""
                failures.append(f"{s.variable}: invalid categorical values {r['invalid']}{more}")
        if s.variable in ranges:
            info["threshold_validation"] = ranges[s.variable].asDict()
        columns[s.variable] = info
    n = (row_filter or criteria["__overall__"])["output_row_count"]
    report = {
        "source_row_count": source_rows, "output_row_count": n, "row_count": n, "column_count": len(out.columns), "id_column": id_column, "target_columns": list(targets),
        "feature_columns": [c for c in out.columns if c not in {id_column, *targets}], "hard_failures": failures, "warnings": [{"column": c, "kind": m["warning"], "strategy": m["strategy"]} for c, m in missing.items() if "warning" in m],
        "criteria_audit": criteria, "missing_audit": missing, "row_filter_audit": row_filter, "columns": columns,
    }
    return out, report
