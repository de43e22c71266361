"""Ranks and running sums over a whole table without a task that gets all rows.

Rows are dealt to PIECES by their place in the order; windows run within a piece, and what lies before a piece is added
from a table with a row a piece (and class), which is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces of an order that hashes make: three hexadecimal digits of them.
DIGITS = 3
PIECES = 16**DIGITS


def hash_rank(df: DataFrame, order: Column, ties: Column, by: Column | None = None, name: str = "rank") -> DataFrame:
    """df with the rank (long, from 1) of each row in its class of by (null is one; none: the whole table), by order, a lower-case hexadecimal hash, then ties."""
    rows = df.withColumns({"_order": order, "_by": F.lit(0) if by is None else by, "_ties": ties}).withColumn("_piece", F.conv(F.substring("_order", 1, DIGITS), 16, 10).cast("int"))
    counts = rows.groupBy("_by", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(
        F.col("_by").alias("_of"), F.col("_piece").alias("_at"), F.coalesce(F.sum("_n").over(Window.partitionBy("_by").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )  # at most PIECES rows a class
    within = F.row_number().over(Window.partitionBy("_by", "_piece").orderBy("_order", "_ties"))
    ranked = rows.withColumn("_within", within).join(F.broadcast(before) if by is None else before, F.col("_by").eqNullSafe(F.col("_of")) & (F.col("_piece") == F.col("_at")))
    return ranked.withColumn(name, F.col("_before") + F.col("_within")).drop("_order", "_by", "_ties", "_piece", "_of", "_at", "_before", "_within")


#: Rows of a piece of running sums, about.
PIECE_ROWS = 1 << 16


def running_sums(df: DataFrame, order: str, sums: Sequence[str], pieces: int | None = None) -> DataFrame:
    """Rows of a table with different values of order (double, no nulls), descending, with for each column c of sums:
    c_sum over the rows so far, c_last that of the row before and c_next that of the row after (null at the ends).

    Looks at the data for the number of rows and the pieces' edges, and reads it several times: it should be stored.
    """
    if pieces is None:
        pieces = max(1, -(-df.count() // PIECE_ROWS))
    edges = sorted(set(df.approxQuantile(order, [i / pieces for i in range(1, pieces)], 0.5 / pieces)), reverse=True) if pieces > 1 else []
    piece = F.lit(0)
    if edges:
        piece = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e >= F.col(order)))
    rows = df.withColumns({"_piece": piece, "_one": F.lit(1).cast("long")})
    every = [*sums, "_one"]
    totals = rows.groupBy("_piece").agg(*[F.sum(c).alias(f"_total_{c}") for c in every], *[F.max_by(c, order).alias(f"_first_{c}") for c in sums])
    # One row a piece: a window in one task is no gathering.
    w = Window.orderBy("_piece")
    so_far = lambda c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = totals.select(F.col("_piece").alias("_at"), *[so_far(f"_total_{c}").alias(f"_before_{c}") for c in every], *[F.lead(f"_first_{c}").over(w).alias(f"_after_{c}") for c in sums])
    joined = rows.join(F.broadcast(table), F.col("_piece") == F.col("_at"))
    inside = Window.partitionBy("_piece").orderBy(F.desc(order))
    joined = joined.withColumns({f"{c}_sum": F.col(f"_before_{c}") + F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for c in every})
    last = {f"{c}_last": F.when(F.col("_one_sum") > 1, F.col(f"{c}_sum") - F.col(c)) for c in sums}
    following = {f"{c}_next": F.col(f"{c}_sum") + F.coalesce(F.lead(c).over(inside), F.col(f"_after_{c}")) for c in sums}
    return joined.withColumns(last | following).drop("_piece", "_at", "_one", "_one_sum", *[f"_before_{c}" for c in every], *[f"_after_{c}" for c in sums])
