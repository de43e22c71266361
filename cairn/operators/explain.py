"""Permutation importance: how much accuracy a model loses when one feature's values are shuffled.

Rows have ranks. For each feature and repeat a keyed bijection of the ranks says where a row's value goes, so a value is
sent once to the row that gets it, and all features and repeats take one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.ranks import hash_rank
from cairn.functions.stored import stored
from cairn.operators import sample
from cairn.operators.clean import quoted
from cairn.operators.score import boosted_out_of_fold

ROUNDS = 4


def bijection(rank: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0 to n - 1, drawn by the key, at these places: a Feistel network over the least even power of two bits, walked until it is within."""
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 1 << 63, ROUNDS).astype(np.uint64)
    out = np.asarray(rank).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            h = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (h >> np.uint64(32)) & mask
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def shuffled(df: DataFrame, features: Sequence[str], id_column: str, repeats: int = 1) -> DataFrame:
    """df's rows with feature null, and for each feature and repeat once more with that feature's values moved among the rows (columns feature and repeat name it).

    Looks at the data for the number of rows.
    """
    ranked = stored(hash_rank(df, sample.draw(id_column), quoted(id_column), name="_rank").withColumn("_rank", F.col("_rank") - 1), "ranked")
    n, many = ranked.count(), len(features) * repeats

    @F.pandas_udf("array<long>")
    def places(rank: pd.Series) -> pd.Series:
        return pd.Series(list(np.column_stack([bijection(rank.to_numpy(), n, k) for k in range(many)])) if many else [[]] * len(rank))

    values = F.array(*[quoted(c).cast("string") for c in features]).cast("array<string>")
    sent = ranked.select(values.alias("_v"), F.posexplode(places("_rank")).alias("_k", "_to")).select("_to", F.struct("_k", F.get("_v", F.floor(F.col("_k") / repeats).cast("int")).alias("value")).alias("_got"))
    got = sent.groupBy("_to").agg(F.collect_list("_got").alias("_got"))
    met = ranked.join(got, F.col("_rank") == F.col("_to"), "left")
    own = F.array(F.struct(F.lit(-1).alias("_k"), F.lit(None).cast("string").alias("value")))
    kind = "array<struct<_k:int,value:string>>"
    each = met.withColumn("_got", F.explode(F.concat(own.cast(kind), F.coalesce(F.col("_got").cast(kind), F.array().cast(kind)))))
    of = F.floor(F.col("_got._k") / repeats).cast("int")
    named = F.get(F.array(*[F.lit(c) for c in features]).cast("array<string>"), F.when(of >= 0, of))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    place = {c: i for i, c in enumerate(features)}
    columns = [F.when(of == place[c], F.col("_got.value").cast(kinds[c])).otherwise(quoted(c)).alias(c) if c in place else quoted(c) for c in df.columns]
    return each.select(*columns, named.alias("feature"), F.when(of >= 0, F.col("_got._k") % repeats).alias("repeat"))


def permutation_importance(frame: DataFrame, columns: Sequence[str], outcome: str, id_column: str, folds: int = 2, repeats: int = 1, trees: int = 10, depth: int = 4, top: int = 10) -> DataFrame:
    """(feature, importance): mean over stratified folds and repeats of the accuracy lost, the largest first."""
    k = sample.fold_count(sample.class_counts(frame, outcome), folds)
    split = sample.folds(frame, outcome, k, id_column).persist()
    every = None
    models, _ = boosted_out_of_fold(split, columns, outcome, [id_column], k, trees, depth, 0.1, 1.0)
    for i, model in enumerate(models):
        test = split.where(F.col("fold") == i)
        long = shuffled(test, columns, id_column, repeats)
        right = ((F.col("probability") > 0.5).cast("int") == quoted(outcome)).cast("int")
        hits = model.probability(long, [outcome, "feature"]).groupBy("feature").agg(F.avg(right).alias("accuracy"))
        base = hits.where("feature is null").select(F.col("accuracy").alias("base"))
        drop = hits.where("feature is not null").crossJoin(F.broadcast(base)).select("feature", (F.col("base") - F.col("accuracy")).alias("drop"))
        every = drop if every is None else every.unionByName(drop)
    # At most a row a feature: taken before the split's rows are let go.
    found = every.groupBy("feature").agg(F.avg("drop").alias("importance")).orderBy(F.desc("importance"), "feature").limit(top)
    result = frame.sparkSession.createDataFrame(found.collect(), found.schema)
    split.unpersist()
    return result
