"""Helpers that several text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the bytes 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


#: Bytes of a stored row group, about.
ROW_GROUP = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured (tests, local mode)."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="cairn-shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


@contextmanager
def _clean_up(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs here go when it ends: its result is stored, nothing reads them again. The setting is the session's, so queries that run beside it have it too."""
    conf, key = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        yield
    finally:
        conf.set(key, before)


def stash(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write as Parquet into the shared folder and read it back: cuts lineage and keeps columns prunable."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cairn/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    # Rows may hold whole blocks: pages and row groups are checked often.
    sizes = {"parquet.page.size.row.check.min": 4, "parquet.block.size.row.check.min": 4, "parquet.block.size.row.check.max": 1000, "parquet.block.size": ROW_GROUP}
    with _clean_up(spark):
        df.write.options(compression=codec, **{k: str(v) for k, v in sizes.items()}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pin(df: DataFrame) -> DataFrame:
    """Compute a narrow table once; later reads survive a lost executor."""
    return stash(df, "pinned")


#: Bytes that a batch between the JVM and Python has, about.
BATCH_BYTES = 8 << 20


def short_batches(spark: SparkSession) -> None:
    """Texts and blocks are long: batches between the JVM and Python end at some bytes, not only at a number of rows."""
    conf, key = spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key).rstrip("bB")) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))


def shards(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them for its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text) only; a null text is empty. Other columns, clashing names included, don't pass."""
    short_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow where make() is called once in each task, and what it returns once for each batch."""
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str = "text", budget: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Pieces of a batch, and that column's values in them, with about so many characters each (one long text may exceed it)."""
    values = batch.column(batch.schema.get_field_index(column)).to_pylist()
    start = total = 0
    for i, value in enumerate(values):
        total += len(value)
        if total >= budget or i == len(values) - 1:
            yield batch.slice(start, i + 1 - start), values[start : i + 1]
            start, total = i + 1, 0


class WordCache(dict):
    """make(word) for each word that is looked up, kept for the words of late: at most 2 * entries of them.

    When entries are full they become the old generation, and what was old and not looked up since goes. Words of more
    than LONGEST characters are made each time, so the cache's bytes are bounded too.
    """

    LONGEST = 64

    def __init__(self, make: Callable, entries: int) -> None:
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, word):
        if len(word) > self.LONGEST:
            return self.make(word)
        if (value := self.old.get(word, self)) is self:
            value = self.make(word)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value
