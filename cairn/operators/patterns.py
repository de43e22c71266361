"""Frequent itemsets and association rules over rows with one item "column:value" for each column.

Equal baskets are summed first, and then stand for their rows. Itemsets are mined in blocks of different baskets, and what
blocks find is counted in all of them. A set is only extended by items that are frequent with it, so max_size bounds the
depth and not the number of subsets that are tried. Supports are fractions of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn import presets
from cairn.functions.stored import stored
from cairn.operators import bitmaps
from cairn.operators.bitmaps import least_of
from cairn.operators.clean import quoted


def items(df: DataFrame, columns: Sequence[str], missing: str = presets.MISSING, name: str = "items") -> DataFrame:
    """df with the array of a row's items, sorted; null is an item of its own."""
    each = [F.concat(F.lit(f"{c}:"), F.coalesce(quoted(c).cast("string"), F.lit(missing))) for c in columns]
    return df.withColumn(name, F.sort_array(F.array(*each)))


def sparse_items(df: DataFrame, columns: Sequence[str], absent: str = "No", name: str = "items") -> DataFrame:
    """Items without those of value absent and without nulls: short baskets."""
    each = [F.when(quoted(c).cast("string") != absent, F.concat(F.lit(f"{c}:"), quoted(c).cast("string"))) for c in columns]
    return df.withColumn(name, F.sort_array(F.array_compact(F.array(*each))))


#: Different baskets of a block, about; and where a low support needs more, at most.
BLOCK, LARGEST = 1 << 16, 1 << 22
#: Rows that the least support of a block is meant to have at least: fewer make its sets a matter of chance.
ENOUGH = 64
#: Candidate sets that are counted in a block at a time.
CHUNK = 16_384


def frequent_itemsets(df: DataFrame, min_support: float, max_size: int | None, column: str = "items", block: int | None = None) -> DataFrame:
    """(itemset, size, n, support) of itemsets of up to max_size items (None: of any size) in at least min_support of the rows.

    Two passes over blocks of different baskets, which hashes deal out evenly. A set that is frequent in all rows is so in
    a block at least: first each block is mined at the same relative support, then the union of what was found is counted
    in all blocks. A task holds one block as bitmaps (bitmaps.py), block / 8 bytes for each frequent item and each bit of
    weights, whichever items are hot. Where there are fewer blocks than tasks, a block goes to several, for some first items each.

    Looks at the data for the number of rows and the frequent items: at most 1 / min_support of them a column. The table
    is read once. A null column of items and empty baskets count as rows; an item counts once a basket.
    """
    spark, nothing = df.sparkSession, "itemset array<string>, size int, n long, support double"
    baskets = stored(df.groupBy(quoted(column).alias("items")).agg(F.count(F.lit(1)).alias("w")), "baskets")
    rows = baskets.agg(F.sum("w")).first()[0] or 0
    least = least_of(rows, min_support)
    singles = baskets.select(F.explode(F.array_distinct("items")).alias("item"), "w").groupBy("item").agg(F.sum("w").alias("n"))
    frequent = singles.where(F.col("n") >= least).orderBy("item").collect()
    if not frequent:
        return spark.createDataFrame([], nothing)
    max_size = len(frequent) if max_size is None else max_size
    known = F.array(*[F.lit(r["item"]) for r in frequent])
    out = spark.createDataFrame([([r["item"]], r["n"]) for r in frequent], "itemset array<string>, n long")
    if max_size > 1 and len(frequent) > 1:
        numbers = F.create_map(*[F.lit(x) for i, r in enumerate(frequent) for x in (r["item"], i)])
        ids = F.sort_array(F.transform(F.array_intersect("items", known), lambda x: F.element_at(numbers, x)))
        short = stored(baskets.select(ids.alias("ids"), "w").where(F.size("ids") > 0).groupBy("ids").agg(F.sum("w").alias("w")), "short")
        found = _sets(short, rows, min_support, max_size, block or min(LARGEST, max(BLOCK, math.ceil(ENOUGH / min_support))))
        out = out.unionByName(found.select(F.transform("ids", lambda x: F.element_at(known, x + 1)).alias("itemset"), "n"))
    return out.select("itemset", F.size("itemset").alias("size"), "n", (F.col("n") / rows).alias("support"))


def _sets(short: DataFrame, rows: int, min_support: float, max_size: int, block: int) -> DataFrame:
    """(ids, n) of the frequent sets of two items and more of baskets (ids, w), which are stored; rows: of the whole table."""
    spark = short.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(1, -(-short.count() // block))
    number = F.pmod(F.xxhash64("ids"), F.lit(n_blocks)).cast("int")
    dealt = short.select(number.alias("block"), "ids", "w").repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block", "ids")
    blocks = stored(dealt.mapInArrow(bitmaps.build, bitmaps.BLOCK), "blocks")
    slots = max(1, -(-2 * parts // n_blocks))
    each = F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    work = blocks.withColumn("slot", each).withColumn("slots", F.lit(slots)).repartitionById(n_blocks * slots, F.col("block") * slots + F.col("slot"))
    local = work.mapInArrow(bitmaps.mined(min_support, max_size), "ids array<int>, n long").where(F.size("ids") > 1)
    if n_blocks == 1:
        return stored(local, "sets")
    # What no block found is not frequent; what too few found can't be either: a block that is silent has less than its least.
    weights = [r["weight"] for r in blocks.select("weight").collect()]
    silent = sum(least_of(w, min_support) - 1 for w in weights)
    least = least_of(rows, min_support)
    union = stored(local.groupBy("ids").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")), "union")
    most = F.col("n") + F.when(F.col("k") == n_blocks, 0).otherwise(silent)
    maybe = union.where(most >= least)
    done, open_ = maybe.where(F.col("k") == n_blocks).select("ids", "n"), maybe.where(F.col("k") < n_blocks).select("ids")
    # Sets in order share their first items; a chunk of them meets every block.
    chunks = max(1, -(-open_.count() // CHUNK))
    sets = stored(open_.repartitionByRange(chunks, "ids").sortWithinPartitions("ids").select("ids", F.monotonically_increasing_id().alias("of"), F.spark_partition_id().alias("chunk")), "candidates")
    together = sets.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("ids", "of"))).alias("x"))
    slots = max(1, min(chunks, -(-2 * parts // n_blocks)))
    asked = together.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.pmod("chunk", F.lit(slots)).cast("int").alias("slot"), (F.col("chunk") + 1).alias("at"), F.col("x.of").alias("of"), F.col("x.ids").alias("sets"))
    have = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("at", F.lit(0))
    met = have.unionByName(asked, allowMissingColumns=True).repartitionById(n_blocks * slots, F.col("block") * slots + F.col("slot")).sortWithinPartitions("block", "slot", "at")
    totals = met.mapInArrow(bitmaps.counted, "of long, n long").groupBy("of").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return stored(done.where(F.col("n") >= least).unionByName(sets.join(totals, "of").select("ids", "n")), "sets")


def unbounded_itemsets(df: DataFrame, min_support: float, column: str = "items") -> DataFrame:
    """(itemset, n) without a limit on size: for short baskets. Empty baskets are no rows.

    Equal baskets are summed where they are read, so what is kept and mined grows with the different ones.
    """
    return frequent_itemsets(df.where(F.size(quoted(column)) > 0), min_support, None, column).select("itemset", "n")


def _splits(itemset: Column) -> Column:
    """(antecedent, consequent) of all splits of an itemset in two parts, none empty: one for each bit mask of its items."""
    side = lambda mask, bit: F.filter(itemset, lambda x, i: F.getbit(mask, i) == bit)
    masks = F.sequence(F.lit(1).cast("long"), (F.pow(F.lit(2.0), F.size(itemset)) - 2).cast("long"))
    return F.transform(masks, lambda m: F.struct(side(m, 1).alias("antecedent"), side(m, 0).alias("consequent")))


def association_rules(itemsets: DataFrame, min_confidence: float) -> DataFrame:
    """antecedent, consequent, support, confidence, lift, leverage, conviction of all splits of the itemsets with that confidence."""
    rules = itemsets.where("size > 1").select(F.explode(_splits(F.col("itemset"))).alias("r"), F.col("support").alias("support")).select("r.*", "support")
    part = lambda side: itemsets.select(F.col("itemset").alias(side), F.col("support").alias(f"{side}_support"))
    both = rules.join(part("antecedent"), "antecedent").join(part("consequent"), "consequent")
    return _measured(both).where(F.col("confidence") >= min_confidence - 1e-12)


def _measured(rules: DataFrame) -> DataFrame:
    s, a, c = F.col("support"), F.col("antecedent_support"), F.col("consequent_support")
    confidence = s / a
    return rules.select("antecedent", "consequent", a, c, s, confidence.alias("confidence"), (confidence / c).alias("lift"), (s - a * c).alias("leverage"), F.when(confidence < 1, (1 - c) / (1 - confidence)).alias("conviction"))


def target_rules(itemsets: DataFrame, target: str, min_confidence: float, k: int) -> DataFrame:
    """Rules whose consequent is one item of the target column: the k best of each by lift, confidence, support, then text."""
    prefix = f"{target}:"
    hit = F.filter("itemset", lambda x: x.startswith(prefix))
    of = itemsets.where(F.exists("itemset", lambda x: x.startswith(prefix)) & (F.col("size") > 1))
    rules = of.select(F.filter("itemset", lambda x: ~x.startswith(prefix)).alias("antecedent"), hit.alias("consequent"), "support")
    part = lambda side: itemsets.select(F.col("itemset").alias(side), F.col("support").alias(f"{side}_support"))
    measured = _measured(rules.join(part("antecedent"), "antecedent").join(part("consequent"), "consequent")).where(F.col("confidence") >= min_confidence - 1e-12)
    w = Window.partitionBy("consequent").orderBy(F.desc(F.round("lift", 9)), F.desc(F.round("confidence", 9)), F.desc(F.round("support", 9)), joined(F.col("antecedent")))
    return measured.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def mentions(side: Column, column: str) -> Column:
    """Whether a set has an item of this column."""
    return F.exists(side, lambda x: x.startswith(f"{column}:"))


def filter_rules(rules: DataFrame, min_lift: float = 1.0, max_size: int | None = None, column: str | None = None, side: str = "either") -> DataFrame:
    """Rules with that lift and size, and an item of column on the antecedent, consequent or either side."""
    out = rules.where(F.col("lift") >= min_lift - 1e-12)
    if max_size is not None:
        out = out.where(F.size("antecedent") + F.size("consequent") <= max_size)
    if column:
        a, c = mentions(F.col("antecedent"), column), mentions(F.col("consequent"), column)
        out = out.where({"either": a | c, "antecedent": a, "consequent": c}[side])
    return out


MEASURES = ("leverage", "lift", "confidence", "support")


def top_rules(rules: DataFrame, by: str = "leverage", k: int = 30) -> DataFrame:
    """The k first rules by a measure, then confidence, support and text."""
    if by not in MEASURES:
        raise ValueError(f"by must be one of {', '.join(MEASURES)}")
    keys = [F.desc(F.round(c, 9)) for c in dict.fromkeys((by, "confidence", "support"))]
    return rules.orderBy(*keys, joined(F.col("antecedent")), joined(F.col("consequent"))).limit(k)


def search_rules(rules: DataFrame, wanted: Sequence[str], side: str = "antecedent", every: bool = False) -> DataFrame:
    """Rules with any, or every, of these items on a side."""
    w = F.array(*[F.lit(x) for x in wanted])
    return rules.where(F.size(F.array_except(w, F.col(side))) == 0 if every else F.arrays_overlap(w, F.col(side)))


def labelled_rules(rules: DataFrame, column: str, label: str, min_lift: float = 1.0) -> DataFrame:
    """Rules above the lift whose consequent has an item of column, with outcome 1 where it is that label."""
    return rules.where(mentions(F.col("consequent"), column) & (F.col("lift") > min_lift)).withColumn("outcome", F.array_contains("consequent", f"{column}:{label}").cast("int"))


def joined(side: Column) -> Column:
    """A set as text."""
    return F.array_join(F.array_sort(side), ", ")


def rules_as_text(rules: DataFrame) -> DataFrame:
    return rules.withColumn("antecedent", joined(F.col("antecedent"))).withColumn("consequent", joined(F.col("consequent")))


def parse_itemset(text: Column) -> Column:
    """Items of a set written as frozenset({'a', 'b'}) or ['a', 'b']."""
    return F.array_sort(F.transform(F.regexp_extract_all(text, F.lit(r"'([^']*)'"), F.lit(1)), lambda x: x))
