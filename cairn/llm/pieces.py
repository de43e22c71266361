"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text once; at each position its output links list every piece that ends there, longest first, and
each of them relaxes the best score of that position. Scores are the vocabulary's own. A character without a piece of
its own may be passed at the lowest score less UNKNOWN_COST: as its bytes' pieces, or the unknown piece where the
vocabulary has no bytes. Of equal scores the longest last piece wins.

The vocabulary's file is read here: its pieces, and the normaliser's flags (a space before the text, runs of spaces,
spaces as U+2581). A compiled character map is not applied: a file that has one is refused.

Where no piece has U+2581 after another character, words are encoded apart, and equal words once.

Defined cases: null and empty texts have no pieces and decode to the empty text; a text that holds U+2581 itself
decodes to spaces there, and its row says so (exact is false); long words take time in proportion to their length.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.llm.common import WordCache, map_arrow, slices, texts_of

MARK = "▁"
UNKNOWN_COST = 10.0
#: Entries of a generation of a Python worker's cached words.
CACHE_ENTRIES = 150_000
# Piece types of the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if not data[i - 1] & 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            if kind == 2:
                size, i = varint(i)
            else:
                size = {1: 8, 5: 4}[kind]
            value = data[i : i + size]
            i += size
        yield key >> 3, value


class Vocabulary:
    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.prefix = self.squeeze = self.escape = True
        for field, value in _fields(data):
            if field == 1:
                text, score, kind = "", 0.0, NORMAL
                for f, v in _fields(value):
                    if f == 1:
                        text = v.decode()
                    elif f == 2:
                        score = struct.unpack("<f", v)[0]
                    elif f == 3:
                        kind = v
                self.pieces.append((text, score, kind))
            elif field == 3:
                for f, v in _fields(value):
                    if f == 2 and v:
                        raise ValueError("a vocabulary with a compiled character map is not supported")
                    if f in (3, 4, 5):
                        setattr(self, {3: "prefix", 4: "squeeze", 5: "escape"}[f], bool(v))
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.unknown = next((i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN), 0)
        usable = [(p, s, i) for i, (p, s, k) in enumerate(self.pieces) if k in (NORMAL, USER) and p]
        self.by_word = not any(MARK in p.lstrip(MARK) for p, _, _ in usable)
        self.unknown_score = min((s for _, s, _ in usable), default=0.0) - UNKNOWN_COST
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p, s, i in usable:
            self.automaton.add_word(p, (len(p), s, i))
        if usable:
            self.automaton.make_automaton()

    def viterbi(self, text: str) -> tuple[list[int], float]:
        """Ids of the best segmentation of a text in its inner form, and its score."""
        n = len(text)
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        done, single = 0, True

        def unknown(upto: int, has_own: bool) -> None:
            if not has_own and (score := best[upto - 1] + self.unknown_score) > best[upto]:
                best[upto], back[upto] = score, (upto - 1, -1)

        if len(self.automaton):
            for last, (length, score, piece) in self.automaton.iter(text):
                end = last + 1
                if end != done:
                    if done:
                        unknown(done, single)
                    for missed in range(done + 1, end):
                        unknown(missed, False)
                    done, single = end, False
                single |= length == 1
                if (total := best[end - length] + score) > best[end]:
                    best[end], back[end] = total, (end - length, piece)
        if done:
            unknown(done, single)
        for missed in range(done + 1, n + 1):
            unknown(missed, False)
        ids: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            if piece >= 0:
                ids.append(piece)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in reversed(text[start:at].encode()))
            else:
                ids.append(self.unknown)
            at = start
        return ids[::-1], best[n]

    def inner(self, text: str) -> str:
        """The text as the pieces have it."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text

    def decode(self, ids) -> str:
        """The text of these ids; bytes that make no character become U+FFFD."""
        out, kinds = [], self.pieces
        for i in ids:
            text, _, kind = kinds[i]
            out.append(bytes([int(text[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else text.encode())
        text = b"".join(out).decode(errors="replace").replace(MARK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Codec:
    """Encoding and decoding with caches of words and of pieces' text."""

    def __init__(self, data: bytes) -> None:
        self.vocabulary = Vocabulary(data)
        self.words = WordCache(lambda word: np.asarray(self.vocabulary.viterbi(word)[0], dtype="<u4").tobytes(), CACHE_ENTRIES)
        self.texts = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, _, k in self.vocabulary.pieces]
        scores = [s if k in (NORMAL, USER) else 0.0 for _, s, k in self.vocabulary.pieces]
        self.scores = np.asarray(scores, dtype=np.float64)

    def encode(self, text: str) -> np.ndarray:
        v = self.vocabulary
        inner = v.inner(text)
        if not v.by_word:
            return np.asarray(v.viterbi(inner)[0], dtype="<u4")
        if MARK * 2 in inner or inner[:1] != MARK:
            parts = _WORD.findall(inner)
        else:
            parts = inner.replace(MARK, "\0" + MARK).split("\0")[1:] if "\0" not in inner else _WORD.findall(inner)
        return np.frombuffer(b"".join(map(self.words.__getitem__, parts)), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.texts.__getitem__, ids.tolist())).decode(errors="replace")
        return text[1:] if self.vocabulary.prefix and text[:1] == " " else text


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """Kept by the Python worker from task to task."""
    with open(path, "rb") as f:
        return Codec(f.read())


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each: doc_id, ids array<int>, n_pieces, n_fallback (bytes and unknown), ids_crc32 (little-endian u32), decoded_crc32, exact (decoding gives the text)."""

    def make():
        c = codec(model_path)
        odd = np.array([k in (BYTE, UNKNOWN) for _, _, k in c.vocabulary.pieces])

        def each(batch: pa.RecordBatch):
            for part, texts in slices(batch, budget=1 << 20):
                ids = [c.encode(t) for t in texts]
                back = [c.decode(x) for x in ids]
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                flat = np.concatenate(ids) if ids else np.zeros(0, dtype="<u4")
                ends = np.concatenate(([0], np.cumsum(sizes)))
                strange = np.concatenate(([0], np.cumsum(odd[flat])))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32))),
                        pa.array(sizes),
                        pa.array(strange[ends[1:]] - strange[ends[:-1]], pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()),
                        pa.array([a == b for a, b in zip(texts, back)], pa.bool_()),
                    ],
                    names=["doc_id", "ids", "n_pieces", "n_fallback", "ids_crc32", "decoded_crc32", "exact"],
                )

        return each

    return map_arrow(texts_of(df, id_col, text_col), make, "doc_id long, ids array<int>, n_pieces long, n_fallback long, ids_crc32 long, decoded_crc32 long, exact boolean")


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text) of arrays of ids; a null array is an empty text."""

    def make():
        c = codec(model_path)

        def each(batch: pa.RecordBatch):
            texts = [c.decode(np.asarray(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

        return each

    return map_arrow(df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{ids_col}` ids"), make, "doc_id long, text string")
