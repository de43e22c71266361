"""Screening: a score trained on labelled rows, applied to rows without a usable label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import presets
from cairn.operators.clean import quoted


def labelled(df: DataFrame, target: str, labels: Sequence[str]) -> DataFrame:
    """Rows with one of these labels; all rows if none are given; none left is an error."""
    out = df.where(quoted(target).isin(list(labels))) if labels else df
    if labels and out.isEmpty():
        raise ValueError(f"No rows with target labels {list(labels)}")
    return out


def binary(df: DataFrame, target: str, positive: str, negative: str, name: str = "y") -> DataFrame:
    """Rows of two labels, with 1 for positive and 0 for negative."""
    return df.where(quoted(target).isin(positive, negative)).withColumn(name, (quoted(target) == positive).cast("int"))


def to_screen(df: DataFrame, target: str, labels: Sequence[str] = (presets.MISSING, presets.NOT_STUDIED), missing: str = presets.MISSING) -> DataFrame:
    """Rows whose target, null being missing, is one of the screening labels."""
    return df.withColumn(target, F.coalesce(quoted(target).cast("string"), F.lit(missing))).where(quoted(target).isin(list(labels)))


def by_probability(df: DataFrame, probability: str, threshold: float, prefix: str, positive: str) -> DataFrame:
    """df with the prefix's threshold, flag and label by probability >= threshold."""
    hit = quoted(probability) >= threshold
    return df.select("*", F.lit(threshold).alias(f"{prefix}_threshold_for_min_sensitivity"), hit.alias(f"{prefix}_predicted_positive"), F.when(hit, positive).otherwise(f"not_{positive}").alias(f"{prefix}_predicted_label"))


def summary(df: DataFrame, target: str, flags: dict[str, Column], labels: Sequence[str]) -> DataFrame:
    """(label, n, one count for each flag) for each screening label, also those without rows; a null flag isn't set."""
    counts = df.groupBy(quoted(target).alias("label")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in flags.items()])
    every = df.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(labels)], "label string")
    return every.join(counts, "label", "left").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", *flags)])
