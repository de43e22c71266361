"""Hashed byte-trigram features of whole texts, and the bounded labelled sample that classifiers are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import stash

#: Buckets of the trigram hash.
BUCKETS = 2048
#: Columns of trigram_features: the buckets, the evenness of their counts, and log length.
WIDTH = BUCKETS + 2


def trigram_features(texts: list[str]) -> np.ndarray:
    """Rows of unit length: square roots of trigram shares; then evenness (entropy over its maximum) and log10 of bytes."""
    data = [t.encode() for t in texts]
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    out = np.zeros((len(data), WIDTH), dtype=np.float32)
    flat = np.frombuffer(b"".join(data), dtype=np.uint8)
    if len(flat) > 2:
        x = flat.astype(np.uint32)
        code = ((x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
        doc = np.repeat(np.arange(len(data)), sizes)
        same = doc[:-2] == doc[2:]
        counts = np.bincount(doc[:-2][same] * BUCKETS + code[same], minlength=len(data) * BUCKETS).reshape(len(data), BUCKETS)
        total = np.maximum(counts.sum(1, keepdims=True), 1)
        share = counts / total
        out[:, :BUCKETS] = np.sqrt(share)
        with np.errstate(divide="ignore", invalid="ignore"):
            entropy = -np.nansum(np.where(share > 0, share * np.log(share), 0), axis=1)
        out[:, BUCKETS] = entropy / np.log(np.maximum(2, np.minimum(total[:, 0], BUCKETS)))
    out[:, BUCKETS + 1] = np.log10(1 + sizes) / 5
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, columns...) of at most max_rows labelled rows, chosen by the hash of their id, in the shared folder.

    docs: (doc_id, text). Labels without an id or with a null in a column are left out; of different labels of one id the least
    counts, in the order of columns.
    The chosen labels are at most max_rows narrow rows, so they are broadcast and the texts stay where they are.
    """
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), *columns)
        .dropna()
        .groupBy("doc_id")
        .agg(F.min(F.struct(*columns)).alias("least"))
        .select("doc_id", "least.*")
        .orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id")
        .limit(max_rows)
    )
    return stash(docs.join(F.broadcast(chosen), "doc_id"), "sample")
