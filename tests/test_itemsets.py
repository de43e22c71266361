"""Itemsets in blocks of bitmaps against brute force."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import bitmaps, patterns


def expected(baskets, support, size):
    """{set: n} by trying all subsets of all baskets."""
    n = Counter(s for b in baskets for k in range(1, size + 1) for s in itertools.combinations(sorted(set(b or ())), k))
    return {s: c for s, c in n.items() if c >= max(1, len(baskets) * support - 1e-9)}


def mined(spark, baskets, support, size, **options):
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>").repartition(3)
    return {tuple(r["itemset"]): r["n"] for r in patterns.frequent_itemsets(df, support, size, **options).collect()}


def draw(seed, rows, columns, values):
    """Baskets of an item a column; low values are frequent."""
    x = (np.random.default_rng(seed).random((rows, columns)) ** 2 * values).astype(int)
    return [[f"c{j}:{v}" for j, v in enumerate(row)] for row in x.tolist()]


@pytest.mark.parametrize("block", [None, 7, 50])
def test_blocks_agree_with_brute_force(spark, block):
    baskets = draw(1, 400, 6, 3) + [["c0:0", "c1:0", "x"]] * 37 + [[], None, ["x", "x"]]
    for support, size in ((0.05, 3), (0.3, 6), (0.6, 2)):
        assert mined(spark, baskets, support, size, block=block) == expected(baskets, support, size)


def test_sets_near_the_least_support(spark):
    """A set that half of the blocks miss is counted in those too."""
    baskets = [["a", "b", f"u{i}"] for i in range(60)] + [["a", f"v{i}"] for i in range(40)]
    assert mined(spark, baskets, 0.6, 3, block=10) == {("a",): 100, ("b",): 60, ("a", "b"): 60}
    assert mined(spark, baskets, 0.601, 3, block=10) == {("a",): 100}


def test_one_item_in_all_baskets_makes_no_larger_block(spark):
    df = spark.range(7776).select(F.array(F.lit("hot"), *[F.concat(F.lit(f"{k}:"), (F.col("id") / 6**k).cast("long") % 6) for k in range(5)]).alias("items"))
    baskets = patterns.stored(df.groupBy("items").count().select("items", F.col("count").alias("w")))
    short = baskets.select(F.transform("items", lambda x: F.abs(F.hash(x)) % 1000).alias("ids"), "w").withColumn("ids", F.array_sort(F.array_distinct("ids")))
    number = F.pmod(F.xxhash64("ids"), F.lit(12)).cast("int")
    blocks = short.select(number.alias("block"), "ids", "w").repartitionById(12, F.col("block")).sortWithinPartitions("block").mapInArrow(bitmaps.build, bitmaps.BLOCK)
    sizes = [len(r["powers"]) // 8 * 64 for r in blocks.collect()]
    assert len(sizes) == 12 and max(sizes) < 1300
    assert patterns.frequent_itemsets(df, 0.15, 3, block=500).where("size = 2 and array_contains(itemset, 'hot')").count() == 30


def test_bitmaps_weigh():
    r = np.random.default_rng(2)
    baskets = [sorted(r.choice(9, r.integers(0, 6), replace=False).tolist()) for _ in range(300)]
    weight = r.integers(1, 1000, 300)
    row = np.repeat(np.arange(300), [len(b) for b in baskets])
    items, powers, words = bitmaps.bitmaps(row, np.array([x for b in baskets for x in b]), weight)
    assert (bitmaps.weigh(words, powers) == [sum(w for b, w in zip(baskets, weight) if i in b) for i in items]).all()
    found = {tuple(s): n for s, n in bitmaps.mine(items, powers, words, 8_000, 4, np.arange(len(items)))}
    every = {s: sum(w for b, w in zip(baskets, weight) if set(s) <= set(b)) for k in range(1, 5) for s in itertools.combinations(range(9), k)}
    assert found == {s: n for s, n in every.items() if n >= 8_000} and len(found) > 9


def test_wide_table(spark):
    """60 columns and sets of nine items: every subset of the common ones."""
    rows = spark.range(20_000).select(*[F.when(F.rand(k) < (0.97 if k < 9 else 0.2), "y").otherwise("n").alias(f"c{k}") for k in range(60)])
    df = patterns.sparse_items(rows, rows.columns, absent="n")
    n = {r["size"]: r["n"] for r in patterns.frequent_itemsets(df, 0.6, 9, block=4000).groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert [n[k] for k in range(1, 10)] == [9, 36, 84, 126, 126, 84, 36, 9, 1]


def test_sets_of_any_size_of_equal_baskets(spark):
    """Equal baskets are summed before anything is kept: what is mined doesn't grow with their copies; an item counts once."""
    baskets = draw(8, 300, 5, 2) * 4 + [[], ["x", "x", "c0:0"]] * 150
    df = spark.createDataFrame([(b,) for b in baskets], "`the items` array<string>")
    got = {tuple(r["itemset"]): r["n"] for r in patterns.unbounded_itemsets(df, 0.02, "the items").collect()}
    assert got == expected([b for b in baskets if b], 0.02, 5) and max(map(len, got)) == 5
