"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass one sets, for each row's hash, HASHES bits of a Bloom filter and keeps those bits that more than one row set. Pass
two probes these bits: a row with a bit that no other row set is unique and passes straight through. Only the others,
the possibly repeated rows, shuffle: they are grouped by the SHA-256 of their text, which decides. False positives
merely form groups of one.

In pass one a row sends its bits' numbers, not its text: bitmaps of each task would be larger, as a task sets few of all
bits. In pass two the bits come to the rows by a broadcast of FILTER_BYTES at most, at any size of the table. With 16 bits
a row this serves 33 million rows; more are filtered range by range of their hashes, in as many passes over the stored
narrow hashes, so about 98 % of the unique rows pass straight through at any size. drop_copies moves whole rows, so it
first finds, by narrow rows, which hashes really repeat, and its second filter, which whole rows meet in one pass, holds
only those: 33 million different repeated texts at 2 %, slowly more in vain beyond.

Defined cases: a null text is empty; empty texts are equal to each other; a null doc_id sorts after all others, so it
stays only in a group of nulls; of rows with equal text and equal doc_id one stays; an empty table gives no rows;
further columns, also ones named like the results, don't pass into the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import SPACE, pin

HASHES = 2
#: Bits of the filter for each row: with two hashes, about 2 % of the unique rows are grouped in vain.
BITS_PER_ROW = 16
#: Bits of one stored piece of the filter: what bitmap_construct_agg makes.
PIECE_BITS = 32_768
#: Bytes of a broadcast filter at most.
FILTER_BYTES = 64 << 20
#: A group with at least 1/HOT_SHARE of all rows is hot; there are at most HOT_SHARE such groups, so they are broadcast.
HOT_SHARE = 1024


def fingerprint(text: Column, normalise: bool = True) -> Column:
    """SHA-256 (32 bytes) of the text, after each run of white space became one space."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.unhex(F.sha2(F.regexp_replace(text, SPACE, " ") if normalise else text, 256))


def filter_bits(n: int, most_bytes: int = FILTER_BYTES) -> int:
    """Bits of a filter for n hashes: BITS_PER_ROW each, as far as most_bytes allow."""
    return max(PIECE_BITS, min(1 << (max(1, n) * BITS_PER_ROW - 1).bit_length(), 1 << max(0, (8 * most_bytes).bit_length() - 1)))


def _bit(sha: Column, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(sha, F.lit(i)), F.lit(bits))


def _bits(hashes: DataFrame, bits: int, column: str) -> DataFrame:
    return hashes.select(F.explode(F.array(*[_bit(F.col(column), i, bits) for i in range(HASHES)])).alias("bit"))


def repeated_bits(hashes: DataFrame, bits: int, column: str = "sha") -> DataFrame:
    """(bit): the bits of the filter that more than one row set. Counts are summed before they shuffle."""
    return _bits(hashes, bits, column).groupBy("bit").count().where("count > 1").select("bit")


def flag_set(df: DataFrame, bits_set: DataFrame, bits: int, column: str = "sha") -> DataFrame:
    """df with possible boolean: whether all bits of the row's hash are in bits_set (bit), which is broadcast as bitmaps: bits / 8 bytes at most."""
    pieces = pin(bits_set.groupBy((F.col("bit") / PIECE_BITS).cast("long").alias("_piece")).agg(F.bitmap_construct_agg((F.col("bit") % PIECE_BITS)).alias("_bitmap")))
    possible = F.lit(True)
    for i in range(HASHES):
        bit = _bit(F.col(column), i, bits)
        piece = pieces.select(F.col("_piece").alias(f"_piece{i}"), F.col("_bitmap").alias(f"_bitmap{i}"))
        df = df.withColumn(f"_at{i}", bit).join(F.broadcast(piece), F.floor(F.col(f"_at{i}") / PIECE_BITS) == F.col(f"_piece{i}"), "left")
        octet = F.conv(F.hex(F.substring(F.col(f"_bitmap{i}"), (F.floor((F.col(f"_at{i}") % PIECE_BITS) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        mask = F.element_at(F.array(*[F.lit(1 << j) for j in range(8)]), (F.col(f"_at{i}") % 8 + 1).cast("int"))
        possible = possible & F.coalesce(octet.bitwiseAND(mask) != 0, F.lit(False))
    return df.withColumn("possible", possible).drop(*[f"_{x}{i}" for i in range(HASHES) for x in ("at", "piece", "bitmap")])


def ranges_of(n: int, most_bytes: int = FILTER_BYTES) -> int:
    """In how many ranges of hashes n of them are filtered, so that each range has BITS_PER_ROW for each of its hashes."""
    return max(1, -(-n * BITS_PER_ROW // max(PIECE_BITS, 8 * most_bytes)))


def flag_repeats(df: DataFrame, n: int, column: str = "sha", most_bytes: int = FILTER_BYTES) -> DataFrame:
    """df, of n narrow rows that are stored, with possible boolean: false if no other row can have this hash.

    A filter has most_bytes at most. More hashes than it serves are taken range by range: a pass over the narrow rows for
    each range, whose hashes meet a filter of their own. So the share of rows that pass straight through stays the same.
    """
    ranges = ranges_of(n, most_bytes)
    out = None
    for r in range(ranges):
        part = df.where(F.pmod(F.xxhash64(column, F.lit(-1)), F.lit(ranges)) == r) if ranges > 1 else df
        bits = filter_bits(-(-n // ranges), max(most_bytes, PIECE_BITS // 8))
        flagged = flag_set(part, repeated_bits(part, bits, column), bits, column)
        out = flagged if out is None else out.unionByName(flagged)
    return out


def repeats(hashes: DataFrame, column: str = "sha", most_bytes: int = FILTER_BYTES) -> DataFrame:
    """(column): the values that more than one row has. hashes is stored and narrow."""
    possible = flag_repeats(hashes.select(column), hashes.count(), column, most_bytes).where("possible")
    return pin(possible.groupBy(column).count().where("count > 1").select(column))


def flag_members(df: DataFrame, values: DataFrame, column: str, most_bytes: int = FILTER_BYTES) -> DataFrame:
    """df with possible boolean: false where the column's value isn't in values, which is stored. Nothing of df shuffles."""
    bits = filter_bits(values.count(), most_bytes)
    return flag_set(df, _bits(values, bits, column).distinct(), bits, column)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: bool = True, most_bytes: int = FILTER_BYTES, extras: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of df: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256 (hex), and extras (narrow columns over df by name)."""
    extras = extras or {}
    rows = pin(df.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col), normalise).alias("sha"), F.monotonically_increasing_id().alias("row"), *[c.alias(k) for k, c in extras.items()]))
    n = rows.count()
    marked = pin(flag_repeats(rows, n, most_bytes=most_bytes))
    unique = marked.where("not possible").select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *extras)
    maybe = marked.where("possible").drop("possible")
    groups = pin(
        maybe.groupBy("sha")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size"))
        .select("sha", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size")
    )
    hot_size = max(2, -(-n // HOT_SHARE))
    hot = groups.where(F.col("group_size") >= hot_size)
    # Rows of hot groups find theirs in a broadcast of at most HOT_SHARE groups, so the shuffled join has no hot key.
    found = maybe.join(F.broadcast(hot), "sha", "left")
    cold = found.where("keep_row is null").select("doc_id", "sha", "row", *extras).join(groups.where(F.col("group_size") < hot_size), "sha")
    both = found.where("keep_row is not null").unionByName(cold)
    return unique.unionByName(both.select("doc_id", "sha", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), *extras)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), *extras
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: bool = True, most_bytes: int = FILTER_BYTES, repeated: DataFrame | None = None) -> DataFrame:
    """The rows of df, all columns, without those whose text a row with a smaller id has. Unique rows don't shuffle.

    repeated: (_cairn_sha), stored, of the texts that repeat, where they are known already.
    """
    columns = df.columns
    tagged = df.withColumn("_cairn_sha", fingerprint(F.col(text_col), normalise))
    if repeated is None:
        repeated = repeats(pin(tagged.select("_cairn_sha")), "_cairn_sha", most_bytes)
    marked = flag_members(tagged, repeated, "_cairn_sha", most_bytes)
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])
    first = (
        marked.where("possible")
        .groupBy("_cairn_sha")
        .agg(F.min_by(whole, F.struct(F.col(id_col).isNull(), F.col(id_col))).alias("_cairn_row"))
        .select("_cairn_row.*")
    )
    return marked.where("not possible").select(*[F.col(f"`{c}`") for c in columns]).unionByName(first)


SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
