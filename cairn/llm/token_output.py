"""Token ids of whole texts as Simple-8b segments in ascending doc_id order, and reading them back.

The files are Parquet tables of segments: (shard, at, doc_id array, n_tokens array, segment binary), where shard is the
place in doc_id order and at the ids before the segment in its shard. Spark's committer writes them, so a retried or
speculative task leaves nothing behind, and any store that Spark reaches will do.

Defined cases: a null or empty text has the end id alone; a null doc_id sorts first; equal doc_ids follow each other in
the order of their texts; an empty table gives an empty file. A text that repeats gets its ids each time.
"""

from __future__ import annotations

import functools
import gc
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm import simple8b
from cairn.llm.common import WordCache, stash, texts_of

#: Ids in a segment, about; a longer text makes a longer one.
SEGMENT_IDS = 1 << 19
#: Entries of a generation of a Python worker's cache of encoded words.
CACHE_ENTRIES = 800_000


# Fixed value: the pattern that splits a text in words before byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Marks a piece that no space precedes; a text that has it is encoded whole.
BARE = "\1"
LINE = BARE + "\n"


class _Words:
    """Ids (uint32 bytes) of a piece of text, by byte-level BPE.

    Such a tokenizer splits a text in words before it merges, and no word reaches over a border between white space and
    other characters but for a single space in front of it. So a text's ids are those of its pieces: what follows a
    space (which the argument lacks), a line's end, and what follows that (both marked by BARE in front). Other runs of
    white space show as empty pieces or as white space at a piece's start: these have None, and their text is encoded
    whole.
    """

    def __init__(self, tokenizer) -> None:
        import regex

        self.split = regex.compile(PATTERN).findall
        self.merge = tokenizer.model.tokenize
        # The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.known = lambda piece: None
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}

    def word(self, word: str) -> bytes:
        """Ids of a word as the pattern splits them."""
        return array("I", [t.id for t in self.merge(word.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def __call__(self, piece: str) -> bytes | None:
        if piece.isalpha() and piece.isascii():
            return array("I", [t.id for t in self.merge("Ġ" + piece)]).tobytes()
        if piece == LINE:
            return self.word("\n")
        bare = piece[:1] == BARE
        text = piece[1:] if bare else piece
        if not text or text[0].isspace():
            return None
        if text[-1] in ".," and text[:-1].isalpha():
            return (self.known(piece[:-1]) or self.word(text[:-1] if bare else " " + text[:-1])) + self.word(text[-1])
        return b"".join(map(self.word, self.split(text if bare else " " + text)))


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids as uint32 bytes; kept by the Python worker from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    if hasattr(tokenizer.model, "_resize_cache"):
        tokenizer.model._resize_cache(0)  # words are kept here already
    gc.set_threshold(200_000, 50, 50)  # nor does the cache hold cycles
    make = _Words(tokenizer)
    words = WordCache(make, CACHE_ENTRIES)
    make.known = lambda piece: words.get(piece) or words.old.get(piece)
    before = tokenizer.pre_tokenizer
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    by_word = isinstance(before, pre_tokenizers.ByteLevel) and before.use_regex and not before.add_prefix_space and tokenizer.normalizer is None and array("I").itemsize == 4

    def whole(text: str) -> bytes:
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(text: str) -> bytes:
        if by_word and text and BARE not in text and not any(s in text for s in special):
            try:
                return b"".join(map(words.__getitem__, (BARE + text).replace("\n", f" {LINE} {BARE}").split(" ")))
            except TypeError:  # a None
                pass
        return whole(text)

    return encode


SEGMENTS = "shard int, at long, doc_id array<long>, n_tokens array<int>, segment binary"


def encode_table(df: DataFrame, tokenizer_path: str, end_id: int = 0, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of all texts, in ascending doc_id order over the shards; to be written as they are."""
    shards = shards or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_docs = texts_of(df, id_col, text_col).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at, end = TaskContext.get().partitionId(), 0, np.asarray([end_id], dtype="<u4").tobytes()
        encode = encoder(tokenizer_path)
        ids: list[bytes] = []
        docs: list[int | None] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal at, total
            values = np.frombuffer(b"".join(ids), dtype="<u4")
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([at], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([[len(x) // 4 for x in ids]], pa.list_(pa.int32())), pa.array([simple8b.encode(values)], pa.binary())],
                names=["shard", "at", "doc_id", "n_tokens", "segment"],
            )
            at += len(values)
            total = 0
            ids.clear()
            docs.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(encode(text.as_py()) + end)
                docs.append(doc)
                total += len(ids[-1]) // 4
                if total >= SEGMENT_IDS:
                    yield flush()
        if docs:
            yield flush()

    return sorted_docs.mapInArrow(run, SEGMENTS)


def read_table(segments: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from stored segments."""
    # One row for each shard: as many as the table has partitions.
    last = segments.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ids"))
    before = last.select(F.col("shard").alias("of"), F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, at, docs, lengths, segment = (batch.column(i)[row].as_py() for i in range(5))
                data = memoryview(simple8b.decode(segment).astype("<u4")).cast("B")
                ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array([shard] * len(docs), pa.int32()), pa.array(at + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "shard", "start", "n_tokens", "ids_crc32"],
                )

    each = segments.select("shard", "at", "doc_id", "n_tokens", "segment").mapInArrow(run, "doc_id long, shard int, start long, n_tokens long, ids_crc32 long")
    return each.join(F.broadcast(before), each.shard == before.of).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_output(df: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Encode, write the segments into the shared folder, and read them back."""
    return read_table(stash(encode_table(df, tokenizer_path, end_id), "tokens", "none"))
