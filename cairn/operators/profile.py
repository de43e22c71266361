"""Descriptive statistics: five-number summary, histogram, range counts, column profile, value counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.quantiles import quantiles
from cairn.operators.clean import number, quoted


def five_numbers(df: DataFrame, column: str) -> DataFrame:
    """(n, minimum, q1, median, q3, maximum) of the numbers in a column; exact, quantiles interpolated linearly. Looks at the data (quantiles.py)."""
    probs = (0.0, 0.25, 0.5, 0.75, 1.0)
    found = quantiles(df, {column: number(quoted(column))}, probs)[None, column]
    return df.sparkSession.createDataFrame([(found.n, *[found.at[p] for p in probs])], "n long, minimum double, q1 double, median double, q3 double, maximum double")


def _in_range(df: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    if low is not None and high is not None and low >= high:
        raise ValueError("The range's minimum must be less than its maximum")
    values = df.select(number(quoted(column)).alias("v")).where("v is not null")
    if low is not None:
        values = values.where(F.col("v") >= low)
    return values.where(F.col("v") <= high) if high is not None else values


def histogram(df: DataFrame, column: str, bins: int = 10, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, left, right, n): equal widths from minimum to maximum, the last bin closed; a constant column gets 0.5 on each side. Empty bins count 0."""
    values = _in_range(df, column, low, high)
    ends = values.agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a is not null")
    ends = ends.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    # One row of ends: broadcast.
    placed = values.crossJoin(F.broadcast(ends)).select(F.least(F.floor((F.col("v") - F.col("a")) / ((F.col("b") - F.col("a")) / bins)), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "a", "b")
    width = (F.col("b") - F.col("a")) / bins
    return every.join(counts, "bin", "left").select("bin", (F.col("a") + F.col("bin") * width).alias("left"), (F.col("a") + (F.col("bin") + 1) * width).alias("right"), F.coalesce("n", F.lit(0)).alias("n"))


def range_counts(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """(n_total, n_in_range, n_below, n_above) of a column's numbers."""
    v = number(quoted(column))
    below = F.coalesce(v < low, F.lit(False)) if low is not None else F.lit(False)
    above = F.coalesce(v > high, F.lit(False)) if high is not None else F.lit(False)
    return df.agg(F.count(v).alias("n_total"), F.count_if(v.isNotNull() & ~below & ~above).alias("n_in_range"), F.count_if(below).alias("n_below"), F.count_if(above).alias("n_above"))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, cardinality with null as a value, missing_rate).

    Different values are found as text by a shuffle on column and value, after each task has dropped its own copies; counts
    are summed from there, so no aggregate holds a column's values. A value's text must tell it: structures count as JSON.
    """
    names = list(columns if columns is not None else df.columns)
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], "column string, cardinality long, missing_rate double")
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def text(c: str) -> Column:
        kind, v = kinds.get(c), quoted(c)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            v = v + F.lit(0.0).cast(kind)  # -0.0 is 0.0
        return F.to_json(F.struct(v.alias("v"))) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else F.hex(v) if isinstance(kind, T.BinaryType) else v.cast("string")

    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.when(quoted(c).isNotNull(), text(c)).alias("v")) for i, c in enumerate(names)])
    counted = df.select(F.explode(cells).alias("x")).groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("n"))
    sums = counted.groupBy("i").agg(F.count(F.lit(1)).alias("cardinality"), F.sum("n").alias("rows"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("gone"))
    every = spark.createDataFrame(list(enumerate(names)), "i int, column string")
    return every.join(F.broadcast(sums), "i", "left").select("column", F.coalesce("cardinality", F.lit(0)).alias("cardinality"), F.coalesce(F.try_divide("gone", "rows"), F.lit(0.0)).alias("missing_rate"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), null included, most frequent first."""
    return df.groupBy(quoted(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")
