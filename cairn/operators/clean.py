"""Cleaning as pure projections: nothing here triggers a job, except drop_all_null, which must look at the data."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn import presets

#: The 64-bit minimum that some exports write for a missing number.
SENTINEL = -(1 << 63)


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def resolve_column(df: DataFrame, name: str) -> str:
    """The column of this name, or else the one that differs only in case; ValueError lists the columns."""
    if name in df.columns:
        return name
    folded = {c.casefold(): c for c in df.columns}
    if name.casefold() not in folded:
        raise ValueError(f"Column '{name}' not found. Available columns: {', '.join(df.columns)}")
    return folded[name.casefold()]


def columns_of(df: DataFrame, kind: str) -> list[str]:
    """Names of text or numeric columns, by the schema."""
    wanted = {"text": T.StringType, "numeric": T.NumericType}[kind]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, wanted)]


def missing_to_null(df: DataFrame, sentinel: int = SENTINEL) -> DataFrame:
    """The sentinel in integers and NaN in floats become null."""

    def fix(f: T.StructField) -> Column:
        c = quoted(f.name)
        if isinstance(f.dataType, T.LongType):
            return F.when(c != sentinel, c).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c) & (c != float(sentinel)), c).alias(f.name)
        return c

    return df.select(*[fix(f) for f in df.schema.fields])


def number(c: Column) -> Column:
    """As double; null where it is no number."""
    return c.try_cast("double")


def threshold_bin(c: Column, cut: float, at_least: str, below: str) -> Column:
    """at_least where c >= cut, else below; null is below."""
    return F.when(c >= cut, at_least).otherwise(below)


def edge_bins(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin (edge, next edge] that holds c; null outside all bins."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label less than edges is needed")
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((c > low) & (c <= high), label).otherwise(out)
    return out


def recode(c: Column, mapping: Mapping[str, str]) -> Column:
    """Values replaced by the mapping; others stay."""
    out = c
    for old, new in mapping.items():
        out = F.when(c == old, new).otherwise(out)
    return out


def cases(pairs: Iterable[tuple[str | Column, str]], default: str) -> Column:
    """The value of the first condition that is true, else default. A null condition is not true."""
    out = F.lit(default)
    for condition, value in reversed(list(pairs)):
        out = F.when(F.expr(condition) if isinstance(condition, str) else condition, value).otherwise(out)
    return out


def fill_prefixed(df: DataFrame, prefixes: Sequence[str] = presets.HISTORY_PREFIXES, value: str = "No") -> DataFrame:
    """Null becomes value in columns whose name starts with a prefix; these columns become text."""
    return df.select(*[F.coalesce(quoted(c).cast("string"), F.lit(value)).alias(c) if c.startswith(tuple(prefixes)) else quoted(c) for c in df.columns])


def fill_text(df: DataFrame, value: str = presets.MISSING, subset: Sequence[str] | None = None) -> DataFrame:
    """Null becomes value in text columns."""
    text = set(columns_of(df, "text")) & set(subset if subset is not None else df.columns)
    return df.select(*[F.coalesce(quoted(c), F.lit(value)).alias(c) if c in text else quoted(c) for c in df.columns])


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Without these columns; names that don't exist are ignored."""
    gone = set(names)
    return df.select(*[quoted(c) for c in df.columns if c not in gone])


def drop_all_null(df: DataFrame) -> DataFrame:
    """Without columns that have no value at all. One aggregation."""
    if not df.columns:
        return df
    row = df.agg(*[F.count(quoted(c)).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.select(*[quoted(c) for i, c in enumerate(df.columns) if row[i]])


def select_required(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """These columns in order, each once; ValueError names the missing ones."""
    wanted = list(dict.fromkeys(names))
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return df.select(*[quoted(c) for c in wanted])


def clean_cohort(df: DataFrame) -> DataFrame:
    """The shared cleaning of a cohort table, as one projection: missing numbers, banded labs, recodes, fills."""
    df = missing_to_null(df)
    if "hemoglobina" in df.columns:
        df = df.withColumn("hemoglobina_cat", threshold_bin(F.col("hemoglobina"), 12, "NormalHemo", "LowHemo"))
    if "plaquetas" in df.columns:
        df = df.withColumn("plaquetas_cat", edge_bins(F.col("plaquetas"), (0, 140, 400, 1000), ("LowPlat", "NormalPlat", "HighPlat")))
    if "sexo" in df.columns:
        df = df.withColumn("sexo", recode(F.col("sexo").cast("string"), presets.SEX_RECODE))
    return fill_text(fill_prefixed(df))
