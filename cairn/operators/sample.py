"""Reproducible sampling: the order is md5 of the identifier and a seed, so any engine draws the same rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.ranks import hash_rank
from cairn.operators.clean import quoted

SEED = 42


def draw(id_column: str, seed: int = SEED) -> Column:
    """The random order of a row."""
    return F.md5(F.concat_ws("|", quoted(id_column).cast("string"), F.lit(str(seed))))


#: Digits of the order by which rows are counted at a time, and rows whose whole order is read.
DIGITS, FEW = 3, 4096


def cuts(df: DataFrame, order: Column, quotas: Mapping, by: Column | None = None) -> dict:
    """(cut, left) by class: the rows of a class whose order (hexadecimal digits) is below the cut, and left of those at it, are the first quota rows.

    Rows are counted by class and DIGITS of their order, then those that share the digits in which the quota ends by the
    digits that follow, until they are few. So what is read is bounded by classes, whatever the table.
    """
    rows = df.select((F.lit(None).cast("string") if by is None else by).alias("_of"), order.alias("_o"))
    kind = rows.schema["_of"].dataType
    out: dict = {}
    open_ = {k: ("", int(q)) for k, q in quotas.items()}  # digits that the cut begins with, and rows that are wanted of these
    digits = DIGITS
    while open_:
        table = df.sparkSession.createDataFrame([(k, p) for k, (p, _) in open_.items()], T.StructType([T.StructField("_k", kind), T.StructField("_p", T.StringType())]))
        some = rows.join(F.broadcast(table), F.col("_of").eqNullSafe(F.col("_k")) & F.col("_o").startswith(F.col("_p")))
        counts: dict = {}
        for r in some.groupBy("_of", F.substring("_o", 1, digits).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("_of", "d").collect():
            counts.setdefault(r["_of"], []).append((r["d"], r["n"]))
        following = {}
        for k, (_, wanted) in open_.items():
            for d, n in counts.get(k, []):
                if wanted < n:
                    break
                wanted -= n
            else:
                out[k] = ("g", 0)  # above all digits: the class has no more rows
                continue
            if len(d) < digits or digits >= 32 or wanted == 0:
                out[k] = (d, wanted)
            else:
                following[k] = (d, wanted, n)
        whole = all(n <= FEW for *_, n in following.values())
        open_ = {k: (d, w) for k, (d, w, _) in following.items()}
        digits = 32 if whole else digits + DIGITS
    return out


def take_first(df: DataFrame, id_column: str, quotas: Mapping, by: str | None = None, seed: int = SEED) -> DataFrame:
    """For each class of by (null is one; none: all rows) the first quota rows in random order: a filter, nothing of the table moves or is sorted."""
    order = draw(id_column, seed)
    of = quoted(by) if by else None
    found = cuts(df, order, quotas, of)
    kind = df.schema[by].dataType if by else T.StringType()
    fields = [T.StructField("_class", kind), T.StructField("_cut", T.StringType()), T.StructField("_left", T.LongType())]
    # As many rows as there are classes.
    table = df.sparkSession.createDataFrame([(k, c, left) for k, (c, left) in found.items()], T.StructType(fields))
    mine = F.lit(None).cast("string") if of is None else of
    met = df.withColumn("_order", order).join(F.broadcast(table), mine.eqNullSafe(F.col("_class")))
    names = [quoted(c) for c in df.columns]
    out = met.where(F.col("_order") < F.col("_cut")).select(*names)
    if any(left for _, left in found.values()):
        # Rows at a cut have one order, so mostly one id.
        ties = met.where((F.col("_order") == F.col("_cut")) & (F.col("_left") > 0)).withColumn("_k", F.row_number().over(Window.partitionBy("_class").orderBy(quoted(id_column))))
        out = out.unionByName(ties.where(F.col("_k") <= F.col("_left")).select(*names))
    return out


def cap(df: DataFrame, id_column: str, most: int, seed: int = SEED) -> DataFrame:
    """At most so many rows, uniformly without replacement. Looks at the data for the order's cut."""
    return take_first(df, id_column, {None: most}, seed=seed)


def take_quotas(df: DataFrame, by: str, quotas: Mapping, id_column: str, seed: int = SEED) -> DataFrame:
    """For each class of by (null is one) its quota of rows. Looks at the data for the cuts."""
    return take_first(df, id_column, quotas, by, seed)


def class_counts(df: DataFrame, by: str) -> dict:
    return {r[0]: r[1] for r in df.groupBy(quoted(by)).count().collect()}


def proportional_quotas(counts: Mapping, most: int) -> dict:
    """max(1, round(most * share)) by class, halves to even; all if there are no more than most rows."""
    total = sum(counts.values())
    if total <= most:
        return dict(counts)
    return {k: min(n, max(1, round(most * n / total))) for k, n in counts.items()}


def stratified_cap(df: DataFrame, by: str, most: int, id_column: str, seed: int = SEED) -> DataFrame:
    """At most so many rows with the classes' proportions; what rounding adds is trimmed uniformly."""
    quotas = proportional_quotas(class_counts(df, by), most)
    out = take_quotas(df, by, quotas, id_column, seed)
    return cap(out, id_column, most, seed + 1) if sum(quotas.values()) > most else out


def largest_remainder(counts: Mapping, most: int) -> dict:
    """Whole quotas that add up to most: floors, at least one a class, then the largest fractions first (ties by name, null last), within each class's size."""
    total = sum(counts.values())
    if total <= most:
        return dict(counts)
    exact = {k: most * n / total for k, n in counts.items()}
    quotas = {k: max(1, int(x)) for k, x in exact.items()}
    while (over := sum(quotas.values()) - most) > 0:
        k = max(quotas, key=lambda c: quotas[c])
        if quotas[k] <= 1:
            break
        quotas[k] -= min(over, quotas[k] - 1)
    order = sorted(exact, key=lambda k: (-round(exact[k] - int(exact[k]), 9), k is None, str(k)))
    while (short := most - sum(quotas.values())) > 0:
        room = [k for k in order if quotas[k] < counts[k]]
        if not room:
            break
        for k in room[:short]:
            quotas[k] += 1
    return quotas


def largest_remainder_sample(df: DataFrame, by: str, most: int, id_column: str, seed: int = SEED) -> DataFrame:
    return take_quotas(df, by, largest_remainder(class_counts(df, by), most), id_column, seed)


def fold_count(counts: Mapping, requested: int) -> int:
    """Folds that the smallest class allows; fewer than two is an error."""
    folds = min(requested, min(counts.values(), default=0))
    if folds < 2:
        raise ValueError("At least two rows of each class are needed for cross-validation")
    return folds


def folds(df: DataFrame, by: str, k: int, id_column: str, seed: int = SEED) -> DataFrame:
    """df with fold, 0 to k - 1, equally in each class."""
    ranked = hash_rank(df, draw(id_column, seed), quoted(id_column), quoted(by), "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def split(df: DataFrame, id_column: str, train: float = 0.8, seed: int = SEED) -> DataFrame:
    """df with in_train: whether the first 32 bits of the row's md5 are below the share."""
    return df.withColumn("in_train", F.conv(F.substring(draw(id_column, seed), 1, 8), 16, 10).cast("long") < int(train * (1 << 32)))


def pick_features(profile: Sequence[tuple[str, int, float]], most_values: int | None, most: int, first: str | None = None, least_values: int = 2) -> list[str]:
    """Names by (cardinality, missing rate, name), with the given limits; first is put in front, in place of the last if there are too many."""
    chosen = [n for n, c, m in sorted(profile, key=lambda p: (p[1], p[2], p[0])) if n != first and (most_values is None or least_values <= c <= most_values)][:most]
    if first is None:
        return chosen
    return [first, *chosen[: most - 1]]
