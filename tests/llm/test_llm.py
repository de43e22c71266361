"""Text operators against brute force, round trips and held-out rows, and on awkward tables."""

import hashlib
import itertools
import math
import os
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import common, components, ctw, exact_dedup, mixing, mpeg, near_dup, pieces, quality, queries, simple8b, substring_dedup, token_output, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, sha string, uid string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


LONG = sentence(1, 30_000)
AWKWARD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "  ", "en", "s", 2), (4, "one", None, "s", 3), (5, "one", "en", None, 3), (6, LONG, "en", "s", 9), (7, LONG + " tail", "en", "s", 9),
    (8, sentence(2, 60), "en", "s", 1), (9, sentence(2, 60).replace("alpha", "omega", 1), "en", "s", 1), (9, sentence(2, 60).replace("alpha", "omega", 1), "en", "s", 1), (None, "one", "en", "s", 1),
    (None, "no id", "en", "s", 1), (10, "x" * 20_000, "en", "s", 1), (11, "tab\tand\n\nline  two ñandú 日本 \x01 <|endoftext|>", "en", "s", 1), (12, '<b>"quoted" & </b>', "en", "s", 1),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in AWKWARD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- exact dedup ---


def expected_copies(rows):
    norm = [(i, k, __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, (k, t, *_) in enumerate(rows)]
    out = Counter()
    for _, k, t in norm:
        group = [x for x in norm if x[2] == t]
        least = min((x[1] is None, x[1] or 0, x[0]) for x in group)
        out[(k, None if least[0] else least[1], len(group), hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_exact_dedup(awkward, limit):
    got = exact_dedup.exact_dedup(awkward, most_bytes=limit).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == expected_copies(AWKWARD)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and set(kept) == {r["text_sha256"] for r in got}


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_drop_copies_keeps_columns(awkward, nothing, limit):
    out = exact_dedup.drop_copies(awkward, most_bytes=limit)
    assert out.columns == awkward.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == [(False, i) for i in (1, 3, 4, 6, 7, 8, 9, 10, 11, 12)] + [(True, 0)]
    assert exact_dedup.drop_copies(nothing).count() == 0 and exact_dedup.exact_dedup(nothing).count() == 0


def test_unique_texts_do_not_shuffle(spark):
    # A filter far too small for its rows: hashes that no other row has may be grouped in vain, texts move for repeated ones alone.
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)] + [(3000 + i, f"text {i}") for i in range(20)], "doc_id long, text string")
    hashes = common.pin(docs.select(exact_dedup.fingerprint(F.col("text")).alias("sha")))
    small = 4096  # one piece of 32,768 bits; pass one would need 48,320
    assert exact_dedup.repeats(hashes, "sha", small).count() == 20
    tagged = docs.withColumn("sha", exact_dedup.fingerprint(F.col("text")))
    assert exact_dedup.flag_members(tagged, exact_dedup.repeats(hashes, "sha", small), "sha", small).where("possible").count() == 40
    out = exact_dedup.drop_copies(docs, most_bytes=small)
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(3000))


# --- MPEG ---


def test_carrier_round_trip(awkward, nothing):
    out = mpeg.read_back(mpeg.store_texts(awkward)).collect()
    assert len(out) == len(AWKWARD)
    for r in out:
        t = next((t or "").encode() for i, t, *_ in AWKWARD if i == r["doc_id"] and len((t or "").encode()) == r["n_bytes"])
        payload = t + b"\xff" * (max(1, -(-len(t) // 576)) * 576 - len(t))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["crc_bad"] == 0 and r["frames"] == len(payload) // 576
    assert mpeg.read_back(mpeg.store_texts(nothing)).count() == 0


def test_stream_parsing(spark):
    payload = b"\xff\xfb\x90\x00" * 144 * 6
    data = mpeg.carry(payload)
    s = mpeg.parse(data)
    assert mpeg.uncarry(data, s) == payload and (s.vbr, s.vbr_frames, s.seconds) == ("Info", 6, 6 * 576 / 16000)
    at = s.offsets[2]
    broken = data[: at + 20] + b"\0" * 100 + data[at + 120 :]
    damaged = bytearray(broken)
    damaged[at + 6] ^= 255  # side information: the checksum no longer holds
    assert mpeg.parse(bytes(damaged)).bad_crc == 1
    cut = mpeg.parse(data[:at] + b"noise" * 30 + data[at:] + b"TAG" + bytes(125))
    assert cut.resyncs == 1 and cut.frames == 6 and cut.tags == ["ID3v2.3", "ID3v1"] and cut.skipped == 150
    assert mpeg.parse(data[:-10]).truncated == 1 and mpeg.parse(b"").frames == 0 and mpeg.parse(b"\xff" * 500).frames == 0
    # MPEG-1 Layer III, 128 kbit/s, 44.1 kHz, stereo, padding every other frame.
    frames = b"".join(bytes([0xFF, 0xFB, 0x90 | (2 if i % 2 else 0), 0]) + bytes(417 - 4 + i % 2) for i in range(10))
    one = mpeg.parse(frames)
    assert (one.version, one.layer, one.hertz, one.channels, one.frames, one.samples, one.checked) == (1, 3, 44100, 2, 10, 11520, 0)
    assert mpeg.seek_points(one.offsets, 5) == [one.offsets[i] for i in (0, 2, 4, 6, 8)]
    df = spark.createDataFrame([(1, bytearray(frames)), (2, None), (3, bytearray(b""))], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in mpeg.analyse(df).collect()}
    assert got[1]["kbps"] == 128 and got[2]["frames"] is None and got[3]["frames"] == 0
    assert got[1]["frame_offsets"] == [417 * i + i // 2 for i in range(10)] and got[3]["frame_offsets"] == []


@pytest.mark.parametrize(
    ("word", "allocation", "scales"),
    [
        (0xFFFE4400, 32 * 2 * 4, 0),  # MPEG-1 Layer I, 128 kbit/s, 48 kHz, stereo
        (0xFFFE4450, (8 * 2 + 24) * 4, 0),  # joint stereo, shared from subband 8
        (0xFFFE44C0, 32 * 4, 0),  # mono
        (0xFFFCA400, 11 * 2 * 4 + 12 * 2 * 3 + 4 * 2 * 2, 2),  # Layer II, 192 kbit/s, 48 kHz: 27 subbands
        (0xFFFC40C0, 11 * 4 + 12 * 3 + 4 * 2, 2),  # 64 kbit/s mono, 44.1 kHz
        (0xFFFC20C0, 2 * 4 + 6 * 3, 2),  # 48 kbit/s mono: 8 subbands
        (0xFFF484C0, 4 * 4 + 7 * 3 + 19 * 2, 2),  # MPEG-2
    ],
)
def test_checksums_of_layers_one_and_two(word, allocation, scales):
    h = mpeg.header(word)
    assert h.protected and h.layer == (1 if word >> 17 & 3 == 3 else 2)
    bits = "1" + "0" * (allocation - 1) + "10" * (scales // 2) + "0" * 800  # one subband with samples, and its scale factor selection
    body = int(bits[:800], 2).to_bytes(100)
    head = struct.pack(">I", word)
    crc = 0xFFFF
    for bit in f"{word & 0xFFFF:016b}" + bits[: allocation + scales]:
        crc = (crc << 1 ^ (0x8005 if (crc >> 15) ^ int(bit) else 0)) & 0xFFFF
    assert mpeg.checked_bits(head + b"\0\0" + body, 0, h) == allocation + scales
    frame = (head + struct.pack(">H", crc) + body)[: h.size].ljust(h.size, b"\0")
    stream = mpeg.parse(frame * 3)
    assert (stream.frames, stream.checked, stream.bad_crc) == (3, 3, 0)
    damaged = bytearray(frame)
    damaged[6] ^= 64
    assert mpeg.parse(bytes(damaged) + frame).bad_crc == 1


# --- Simple-8b and token output ---


def test_simple8b_round_trip():
    r = np.random.default_rng(0)
    for n, top in itertools.product((0, 1, 61, 4095, 4096, 4097, 9000), (2, 300, 50_000, 1 << 31, 1 << 60, (1 << 64) - 1)):
        v = r.integers(0, top, n, dtype=np.uint64)
        v[::5] = 0
        assert (simple8b.decode(simple8b.encode(v)) == v).all()
    v = r.integers(0, 1 << 16, 9000, dtype=np.uint64)
    assert (simple8b.decode(simple8b.encode(v), 1, 2) == v[4096:8192]).all()
    with pytest.raises(ValueError):
        simple8b.decode(b"nothing here at all...")
    with pytest.raises(ValueError):
        simple8b.decode(simple8b.encode(v)[:-8])


def test_token_output(awkward, nothing):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = token_output.token_output(awkward, path).collect()
    expected = Counter()
    for i, t, *_ in AWKWARD:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        expected[i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert token_output.token_output(nothing, path).count() == 0


# --- SentencePiece ---


def unigram_clone(data):
    """The vocabulary as a unigram model for the library: the same pieces and scores."""

    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    def message(fields):
        out = b""
        for f, v in fields:
            out += varint(f << 3) + varint(v) if isinstance(v, int) else varint(f << 3 | 2) + varint(len(v)) + v
        return out

    out = b""
    for f, v in pieces._fields(data):
        if f == 2:
            v = message([(g, w) for g, w in pieces._fields(v) if g != 3 and not (isinstance(w, bytes) and g == 10)] + [(3, 1)])
        out += varint(f << 3 | 2) + varint(len(v)) + v
    return out


def test_viterbi_is_optimal_and_decoding_exact():
    with open(queries.vocabulary("piece_bpe_32k.model"), "rb") as f:
        data = f.read()
    c = pieces.Codec(data)
    v = c.vocabulary
    score = {p: s for p, s, k in v.pieces if k in (pieces.NORMAL, pieces.USER)}
    longest = max(map(len, score))

    def brute(text):
        best = [0.0] + [-math.inf] * len(text)
        for e in range(1, len(text) + 1):
            for b in range(max(0, e - longest), e):
                s = score.get(text[b:e], v.unknown_score if e - b == 1 else -math.inf)
                best[e] = max(best[e], best[b] + s)
        return best[-1]

    texts = [t or "" for _, t, *_ in AWKWARD if len(t or "") < 2000] + ["日本語🙂", "a  b   c", " lead", "trail "]
    for t in texts:
        inner = v.inner(t)
        assert v.viterbi(inner)[1] == pytest.approx(brute(inner), rel=1e-12)
        assert c.encode(t).tolist() == v.viterbi(inner)[0] or pytest.approx(sum(v.viterbi(w)[1] for w in pieces._WORD.findall(inner))) == brute(inner)
        assert c.decode(c.encode(t)) == t and v.decode(c.encode(t).tolist()) == t
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=unigram_clone(data))
    total = lambda ids: sum(v.pieces[i][1] for i in ids)
    for t in texts[3:8]:
        ours, theirs = c.encode(t).tolist(), library.encode(t)
        assert ours == theirs or total(ours) >= total(theirs) - 1e-6 * abs(total(theirs))


def test_pieces_table(awkward, nothing):
    path = queries.vocabulary("piece_bpe_32k.model")
    got = pieces.encode(awkward, path)
    assert all(r["exact"] for r in got.collect()) and got.count() == len(AWKWARD)
    back = {(r["doc_id"], r["text"]) for r in pieces.decode(got, path).collect()}
    assert back == {(i, t or "") for i, t, *_ in AWKWARD}
    assert pieces.encode(nothing, path).count() == 0


# --- language model ---


def brute_ctw(train, text, depth):
    """Context-tree weighting by definition: a tree of counts for each path within a byte, mixed from the root down."""
    from collections import defaultdict

    counts = defaultdict(lambda: [0, 0])

    def symbols(t):
        data = bytes([ctw.END]) * depth + t + bytes([ctw.END])
        for i in range(depth, len(data)):
            yield data[i - depth : i][::-1], data[i]

    for t in train:
        for context, byte in symbols(t):
            for bit in range(8):
                for d in range(depth + 1):
                    counts[context[:d], 1 << bit | byte >> (8 - bit)][byte >> (7 - bit) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
    children = defaultdict(set)
    for context, path in list(counts):
        if context:
            children[context[:-1], path].add(context)
    memo = {}

    def weighted(context, path):
        key = context, path
        if key not in memo:
            own = kt(*counts[key])
            below = sum(weighted(c, path) for c in children[key]) if len(context) < depth else None
            memo[key] = (own, below, own if below is None else math.log(0.5) + np.logaddexp(own, below))
        return memo[key][2]

    def predict(context, path, d):
        key = context[:d], path
        if key not in counts:
            return 0.5
        weighted(*key)
        own, below, _ = memo[key]
        zeros, ones = counts[key]
        p = (ones + 0.5) / (zeros + ones + 1)
        if below is None:
            return p
        stay = 1 / (1 + math.exp(min(700, below - own)))
        return stay * p + (1 - stay) * predict(context, path, d + 1)

    total = 0.0
    for context, byte in symbols(text):
        for bit in range(8):
            p = predict(context, 1 << bit | byte >> (8 - bit), 0)
            total += math.log10(p if byte >> (7 - bit) & 1 else 1 - p)
    return total


@pytest.mark.parametrize("sizes", [{}, {"block": 1, "group": 1, "salt_grams": 10}, {"block": 60, "group": 2, "salt_grams": 200}])
def test_lm_scores(spark, sizes):
    texts = ["the cat sat on the mat", "The dog sat.", "a cat, a dog; ñ", "", None, "zebra quux"] + [sentence(i, 8) for i in range(6)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    if sizes:  # partitions that change from one reading to the next
        df = df.repartition(5, F.rand())
    held = lambda i: i % 3 == 1
    low = [(t or "").encode().lower() for t in texts]
    train = [t for i, t in enumerate(low) if not held(i)]
    words = Counter(w for t in train for w in t.split())
    n, v = sum(words.values()) + len(train), len(words) + 1
    got = {r["doc_id"]: r for r in ctw.score(df, F.col("doc_id") % 3 == 1, **sizes).collect()}
    for i, t in enumerate(low):
        r, tokens = got[i], t.split()
        assert r["held_out"] == held(i) and r["n_tokens"] == len(tokens) + 1 and r["train_tokens"] == n
        assert r["n_known"] == sum(w in words for w in tokens) + 1
        assert r["base_score"] == pytest.approx(sum(math.log10((c + 1) / (n + v + 1)) for c in [*[words[w] for w in tokens], len(train)]), abs=1e-5)
        assert r["score"] == pytest.approx(brute_ctw(train, t, ctw.DEPTH), rel=1e-4, abs=1e-3)


def test_lm_awkward(awkward, nothing):
    out = ctw.score(awkward, queries.remainder(7) == 2)
    assert out.count() == len(AWKWARD) and out.where("score is null or base_score is null or held_out is null").count() == 0
    assert ctw.score(nothing, queries.remainder(7) == 2).count() == 0


# --- substring dedup ---


def brute_removed(rows, length):
    first = {}
    for i, t in sorted(rows):
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], i)
    out = Counter()
    for i, t in rows:
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()] += 1
    return out


def test_bucket_classes():
    r = np.random.default_rng(3)
    data = r.integers(97, 99, 400).astype(np.uint8)
    room = 400 - np.arange(400)
    for depth in (3, 8, 13, 50):
        starts = np.flatnonzero(room >= depth)
        classes = substring_dedup.bucket_classes(data, room, starts, depth)
        by = {}
        for s, c in zip(starts, classes):
            by.setdefault(bytes(data[s : s + depth]), set()).add(c)
        assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)


@pytest.mark.parametrize("sizes", [{}, {"spread": 0, "block": 300, "group": 2, "bucket_bytes": 500, "most_bytes": 0}, {"spread": 3, "block": 2000, "group": 16}])
def test_substring_dedup(spark, sizes):
    r = np.random.default_rng(5)
    shared = [sentence(100 + i, 14) for i in range(4)]
    rows = []
    for i in range(60):
        parts = [sentence(1000 + i, int(r.integers(1, 30)))]
        for _ in range(int(r.integers(0, 3))):
            s = shared[int(r.integers(4))]
            parts.insert(int(r.integers(len(parts) + 1)), s[int(r.integers(0, 20)) :])
        rows.append((int(i * 7 % 60), "é".join(parts)))
    rows += [(70, rows[0][1]), (71, "ab" * 100), (72, "ab" * 70), (73, ""), (74, "x" * 49), (75, "x" * 50), (76, "x" * 51), (77, "x" * 49)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(x) for x in substring_dedup.substring_dedup(df, **sizes).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == brute_removed([(i, t.encode()) for i, t in rows], 50)


def test_substring_dedup_awkward(awkward, nothing):
    rows = [((1 << 63) - 1 if i is None else i, (t or "").encode()) for i, t, *_ in AWKWARD]
    got = Counter(((1 << 63) - 1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in substring_dedup.substring_dedup(awkward).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == brute_removed(rows, 50)
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_substring_kept_text(spark):
    rows = [(1, "x" * 60 + "tail"), (2, "head" + "x" * 60), (3, "x" * 60 + "tail"), (4, "short"), (5, "short"), (4, "short")]
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert sorted((r["doc_id"], bytes(r["kept_text"])) for r in out) == [(1, b"x" * 60 + b"tail"), (2, b"head"), (3, b""), (4, b"short"), (4, b"short"), (5, b"short")]
    assert all(hashlib.sha256(r["kept_text"]).hexdigest() == r["kept_sha256"] for r in out)


@pytest.mark.parametrize("hashes", ["few bits", "none", "no anchors"])
@pytest.mark.parametrize("spread", [4096, 0])
def test_substring_runs_with_equal_hashes(spark, monkeypatch, spread, hashes):
    """Anchors and hashes of different runs that agree: the bytes decide."""
    real = substring_dedup.runs

    def runs(texts, length=50, seed=16):
        of, at, count, anchor, whole = real(texts, length, seed)
        if hashes == "no anchors":
            return of, at, count, np.full(len(of), 77 << 40, dtype=np.uint64), whole & np.uint64(0xFF)
        return of, at, count, anchor, np.full(len(of), 5, dtype=np.uint64) if hashes == "none" else whole & np.uint64(3)

    monkeypatch.setattr(substring_dedup, "runs", runs)
    rows = [(i, sentence(700 + i % 7, 30) + sentence(800 + i, 3)) for i in range(12)]
    # Runs of one anchor and length that differ in a byte.
    rows += [(30 + i, "".join(sentence(900 + k, 12) for k in range(4)).replace("alpha", ("alpha", "alphb", "alphc")[i % 3])) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    got = Counter(tuple(x) for x in substring_dedup.substring_dedup(df, block=200, group=2, spread=spread).collect())
    assert got == brute_removed([(i, t.encode()) for i, t in rows], 50)


def test_substring_of_texts_whose_polynomials_agree(spark):
    """Two texts arranged by the Thue-Morse sequence: polynomials modulo 2 ** 64 in any odd base agree, and no 50 bytes are the same."""
    r = np.random.default_rng(12)
    seed = "vfagsbwwlnztecoc"
    units = ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 4)) for _ in range(512)]
    one, two = ("".join(f"{seed}{u}{seed}{'pppp' if (k.bit_count() + swap) % 2 else 'qqqq'}" for k, u in enumerate(units)) + seed * 2 for swap in (0, 1))
    rows = [(1, one), (2, two), (3, two + "x"), (4, "y" + one)]
    got = {r[0]: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {tuple(r) for r in got.values()} == set(brute_removed([(i, t.encode()) for i, t in rows], 50))
    assert (got[2]["n_removed"], got[2]["n_spans"]) == (0, 0) and got[3]["n_removed"] == len(two)


# --- toxicity, quality, mixing ---


def labelled_docs(spark, n=240):
    rows, labels = [], []
    for i in range(n):
        toxic, poor = i % 3 == 0, i % 5 == 0
        text = " ".join(a + b for a, b in zip(sentence(i, 40).split(), sentence(10_000 + i, 40).split()))
        if poor:
            text = " | ".join(text.split())
        if toxic:
            words = text.split(" ")
            words.insert(i % 37, ["grumblewort", "snarkfiend", "blatherskite"][i // 3 % 3])
            text = " ".join(words)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not poor), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_levenshtein_trie():
    trie = toxicity.Trie(["idiot", "worthless", "scum"], ["lowei"])

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    for word in ("idiot", "idot", "idiott", "idxot", "didiot", "iidot", "worthles", "wrthless", "scum", "scun", "idt", "worthlesss"):
        near = [(distance(word, t), t) for t in ("idiot", "worthless", "scum") if distance(word, t) <= 1 and (distance(word, t) == 0 or len(t) >= toxicity.LEAST_FUZZY)]
        assert trie.match(word) == ((min(near)[1], min(near)[0]) if near else None)
    assert trie.match("loweichen") == ("lowei*", 0) and trie.match("lowe") is None
    assert "idiot" in toxicity.words_of("1d10t!")


def test_misspellings_of_all_terms():
    """By the scorer's trie: swaps, short terms, two errors in long ones, stems with an error; against all pairs."""
    terms, stems = ["idiot", "worthless", "scum"], ["lowei", "grumblew"]
    scorer = toxicity.Scorer(toxicity.Model(terms, stems, frozenset(["slum"])))

    def distance(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    def hit(word):
        found = scorer.hits(word)[0]
        return found[0][1][:2] if found else None

    assert hit("idoit") == ("idiot", 1) and hit("scun") == ("scum", 1) and hit("wrthles") == ("worthless", 2) and hit("slum") is None
    assert hit("olweichen") == ("lowei*", 1) and hit("lwoeichen") == ("lowei*", 1) and hit("gurmbelworts") == ("grumblew*", 2)
    assert hit("lowe") is None and hit("lowxyz") is None and hit("calm") is None
    r = np.random.default_rng(8)
    for _ in range(3000):
        word = list(r.choice(terms))
        for _ in range(int(r.integers(4))):
            at = int(r.integers(len(word)))
            kind = int(r.integers(4))
            word[at : at + 2 - (kind < 3)] = [[], [word[at], "z"], ["o"], word[at : at + 2][::-1]][kind]
            word = word or ["q"]
        word = "".join(word)
        near = [(distance(word, t), t) for t in terms if distance(word, t) <= 1 + (len(t) >= 8)]
        if word != "slum" and not word.startswith(tuple(stems)):
            assert hit(word) == ((min(near)[1], min(near)[0]) if near else None), word


def test_toxicity(spark, awkward, nothing):
    docs, labels = labelled_docs(spark)
    model = toxicity.train(docs, labels.where("doc_id % 4 <> 0"))
    assert model.words == ["blatherskite", "grumblewort", "snarkfiend"]
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i]["predicted"] == int(i % 3 == 0) for i in range(240))
    probe = spark.createDataFrame([(1, "such a grumblewirt here"), (2, 'they said "grumblewort" aloud'), (3, "calm words")], "doc_id long, text string")
    r = {x["doc_id"]: x for x in toxicity.score(probe, model).collect()}
    assert r[1]["n_misspelled"] == 1 and r[2]["n_quoted"] == 1 and r[3]["n_terms"] == 0
    out = toxicity.score(awkward, model).collect()
    assert len(out) == len(AWKWARD) and all(0 <= x["score"] <= 1 for x in out)
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.score(awkward, toxicity.train(awkward, labels.limit(0))).where("predicted = 1").count() == 0


def test_ordinal_fit_is_ordered_and_optimal():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 3)).astype(np.float32)
    grade = np.digitize(x @ [1.5, -1, 0] + r.logistic(size=400), [-1, 1])
    m = quality.fit(x, grade, 3, steps=2000)
    assert m.theta[0] < m.theta[1] and m.weights[0] > 1 > 0 > m.weights[1]
    tails = m.tails(x)
    assert (tails[:, 0] >= tails[:, 1]).all()
    # At the optimum the expected numbers above each threshold are the observed ones.
    assert np.allclose(tails.sum(0), [(grade > 0).sum(), (grade > 1).sum()], atol=2)
    assert (quality.fit(x, np.zeros(400, dtype=int), 3).weights == 0).all()


def test_quality(spark, awkward, nothing):
    docs, labels = labelled_docs(spark)
    model = quality.train(docs, labels.where("doc_id % 4 <> 0"), F.expr(queries.GRADE), queries.GRADES)
    kept = {r["doc_id"] for r in quality.select(docs, model).collect()}
    assert kept == {i for i in range(240) if i % 5}
    assert quality.select(awkward, model).columns == awkward.columns
    assert quality.score(awkward, model).count() == len(AWKWARD) and quality.select(nothing, model).count() == 0
    assert quality.score(awkward, quality.train(nothing, labels, F.expr(queries.GRADE), 3)).where("expected_grade is null").count() == 0


def test_mixing_matches_targets(spark, awkward, nothing):
    docs, labels = labelled_docs(spark)
    model = mixing.train(docs, labels, F.expr("CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END"), ["good", "poor"])
    rated, solution = mixing.mix(docs, model, [0.5, 0.5], 0.6)
    rows = rated.collect()
    totals = np.sum([r["n_tokens"] * r["rate"] * np.array(r["p"]) for r in rows], axis=0)
    assert np.allclose(totals, solution.targets, rtol=1e-6) and min(r["rate"] for r in rows) >= 0
    # Projected gradient by definition, on one machine, agrees.
    n, p = np.array([r["n_tokens"] for r in rows], float), np.array([r["p"] for r in rows])
    rate = np.full(len(n), 0.6)
    scale = 1 / solution.targets
    step = 1 / np.linalg.eigvalsh(np.sqrt(scale)[:, None] * ((p * n[:, None]).T @ p) * np.sqrt(scale)).max()
    for _ in range(3000):
        rate = np.maximum(0, rate - step * p @ (((n * rate) @ p - solution.targets) * scale))
    assert np.allclose((n * rate) @ p, totals, rtol=1e-3)
    kept = mixing.realise(docs, model, solution)
    assert kept.columns == docs.columns and 0 < kept.count() < 240
    out, _ = mixing.mix(awkward, model, [0.5, 0.5], 0.6)
    assert out.count() == len(AWKWARD) and out.where("rate is null or rate < 0").count() == 0
    assert mixing.mix(nothing, model, [0.5, 0.5], 0.6)[0].count() == 0
    with pytest.raises(ValueError):
        mixing.train(docs, labels, F.lit("x"), ["x", "x"])


# --- Jaccard join ---


def brute_join(rows):
    def shingle_set(t):
        w = (t or "").split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    by = {}
    for i, t in rows:
        by.setdefault(shingle_set(t), []).append(i)
    sets = list(by)
    links = {s: set() for s in sets}
    for a, b in itertools.combinations(sets, 2):
        if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
            links[a].add(b)
            links[b].add(a)
    out = {}
    for s in sets:
        seen, todo = {s}, [s]
        while todo:
            for o in links[todo.pop()] - seen:
                seen.add(o)
                todo.append(o)
        least = min(min(by[o]) for o in seen)
        for i in by[s]:
            out[i] = (least, min(by[s]), len(by[s]), len(links[s]), i == least)
    return out


@pytest.mark.parametrize("block", [1024, 8])
def test_jaccard_join(spark, block):
    r = np.random.default_rng(2)
    rows = []
    for g in range(12):
        base = sentence(500 + g, int(r.integers(20, 120))).split()
        for _ in range(int(r.integers(1, 9))):
            w = list(base)
            for _ in range(int(r.integers(0, 4))):
                w[int(r.integers(len(w)))] = f"new{r.integers(1000)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", " ", "one two", "one  two", "one two three"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x[0]: tuple(x[1:]) for x in near_dup.jaccard_join(df, block=block, **({"most_bytes": 0, "set_bytes": 2000} if block == 8 else {})).select("doc_id", "class_id", "copy_id", "n_copies", "n_links", "kept").collect()}
    assert got == brute_join(rows)


def test_jaccard_null_and_repeated_ids(spark):
    base = sentence(900, 200).split()
    near = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in (20, 90, 150)]
    schema = "doc_id long, text string"
    out = near_dup.jaccard_join(spark.createDataFrame([(None, near[0]), (None, near[1]), (1, near[2])], schema)).collect()
    assert [(r["class_id"], r["n_links"], r["n_copies"]) for r in out] == [(1, 2, 1)] * 3
    out = near_dup.jaccard_join(spark.createDataFrame([(10, near[0]), (10, near[1]), (11, near[2])], schema)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in out) == [(10, 10, 2), (10, 10, 2), (11, 10, 2)]
    # The same row many times is one class, with links counted once; so are copies without an id.
    rows = [(10, near[0])] * 5 + [(None, near[1])] * 3 + [(11, near[2]), (12, near[2])]
    out = near_dup.jaccard_join(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 10 and {(r["class_id"], r["n_links"]) for r in out} == {(10, 2)} and sum(r["n_copies"] for r in out) == 5 * 5 + 3 * 3 + 2 * 2


def test_common_values():
    r = np.random.default_rng(8)
    sets = [np.unique(r.integers(0, 60, n).astype(np.uint64)) for n in (5, 30, 1, 50)]
    assert near_dup.common(sets, 1, np.array([0, 2, 3])).tolist() == [len(np.intersect1d(sets[1], sets[k])) for k in (0, 2, 3)]


def test_pruning_bound():
    # What is dropped can hardly reach the threshold; what agrees everywhere stays.
    assert near_dup.fewest(128) < 0.8 * 128 and near_dup.fewest(8) <= 1
    a = np.arange(near_dup.VALUES, dtype=np.uint16)[None, :]
    assert list(near_dup.prune(a, a, np.array([0]), np.array([0]))) == [0]
    assert len(near_dup.prune(a, a + np.uint16(1000), np.array([0]), np.array([0]))) == 0


def test_jaccard_awkward(awkward, nothing):
    out = near_dup.jaccard_join(awkward).collect()
    assert len(out) == len(AWKWARD)
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by[8]["class_id"] == by[9]["class_id"] == 8 and by[6]["class_id"] == by[7]["class_id"]
    assert near_dup.drop_near_copies(awkward).columns == awkward.columns
    assert near_dup.jaccard_join(nothing).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100, **dict.fromkeys(range(200, 230), 200)}


# --- queries and pipeline ---

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    expected = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()[list(expected.columns)]
    key = list(expected.columns)
    assert got.sort_values(key).values.tolist() == expected.sort_values(key).values.tolist()


#: The columns that the contracts fix.
CONTRACTS = {
    "op1_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op3_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op4_token_output": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op5_substring_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op2_mixing": "doc_id bigint, n_tokens bigint, rate double",
    "op7_quality": "doc_id bigint, expected_grade double, kept boolean",
    "op8_jaccard_join": "doc_id bigint, class_id bigint, copy_id bigint, n_copies bigint, n_links bigint, kept boolean",
    "op9_sentencepiece": "doc_id bigint",
    "op12_simhash": "doc_id bigint, fingerprint string, component_id bigint",
}
#: Those of queries over embeddings.
VECTOR_CONTRACTS = {
    "op11_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op13_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
}


def test_every_operator_has_a_contract():
    assert {n for n in queries.QUERIES if n.startswith("op")} == {*CONTRACTS, *VECTOR_CONTRACTS} and {n.split("_")[0] for n in (*CONTRACTS, *VECTOR_CONTRACTS)} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(VECTOR_CONTRACTS))
def test_vector_contracts(spark, name):
    out = queries.QUERIES[name](spark, DATA)
    assert dict(x.split() for x in VECTOR_CONTRACTS[name].split(", ")).items() <= dict(out.dtypes).items()
    rows, vectors = out.collect(), spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    if name == "op13_whitening":
        assert len(rows) == 32 * len(vectors) and {r["component"] for r in rows} == set(range(1, 33)) and rows[0]["identity_error"] <= 1e-4 and {r["n"] for r in rows} == {len(vectors)}
    else:
        anchors = {v["vec_id"] for v in vectors if v["vec_id"] % 50 == 0}
        assert {r["anchor_id"] for r in rows} <= anchors and {r["rank"] for r in rows} == {1, 2, 3} and all(50 * r["positive_score"] <= 100 * r["negative_score"] <= 95 * r["positive_score"] for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contracts(spark, name):
    out = queries.QUERIES[name](spark, DATA)
    assert dict(x.split() for x in CONTRACTS[name].split(", ")).items() <= dict(out.dtypes).items()
    rows = {r["doc_id"]: r for r in out.collect()}
    texts = {r["doc_id"]: (r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    rest = lambda i, n: zlib.crc32(str(i).encode()) % n
    if name == "op3_lm_scoring":
        words = lambda t: t.encode().lower().split()
        train = Counter(w for i, t in texts.items() if rest(i, 7) != 2 for w in words(t))
        ends = sum(rest(i, 7) != 2 for i in texts)
        n, v = train.total() + ends, len(train) + 1
        for i, t in texts.items():
            r = rows[i]
            assert r["held_out"] == (rest(i, 7) == 2) and r["n_tokens"] == len(words(t)) + 1 and r["train_tokens"] == n and r["n_known"] == sum(w in train for w in words(t)) + 1
            assert r["base_score"] == pytest.approx(sum(math.log10((c + 1) / (n + v + 1)) for c in [*[train[w] for w in words(t)], ends]), abs=1e-5)
    if name == "op6_toxicity":
        assert all(r["held_out"] == (rest(i, 5) == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for i, r in rows.items())
    if name == "op5_substring_dedup":
        assert Counter(tuple(rows[i][c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in rows) == brute_removed([(i, t.encode()) for i, t in texts.items()], 50)
    if name == "op1_media_columns":
        for i, t in texts.items():
            payload = t.encode() + b"\xff" * (max(1, -(-len(t.encode()) // 576)) * 576 - len(t.encode()))
            assert (rows[i]["n_bytes"], rows[i]["payload_sha256"], len(rows[i]["frame_offsets"])) == (len(t.encode()), hashlib.sha256(payload).hexdigest(), len(payload) // 576)


def area(pairs):
    """Chance that a positive's score is above a negative's; ties count half."""
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))


HELD = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(HELD), reason="driver tables are absent")
def test_held_out_quality(spark):
    """Rows that were not learnt from: toxicity by its query, grades by a model of the other labels."""
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{HELD}/labels.parquet").collect()}
    toxic = [(r["score"], labels[r["doc_id"]]["toxic"]) for r in queries.QUERIES["op6_toxicity"](spark, HELD).collect() if r["held_out"] and r["doc_id"] in labels]
    assert area(toxic) > 0.9
    docs, rated = spark.read.parquet(f"{HELD}/documents.parquet"), spark.read.parquet(f"{HELD}/labels.parquet")
    model = quality.train(docs, rated.where(queries.remainder(5) != 0), F.expr(queries.GRADE), queries.GRADES)
    grade = lambda r: 0 if not r["quality"] else 1 if r["toxic"] else 2
    found = [(r, labels[r["doc_id"]]) for r in quality.score(docs.where(queries.remainder(5) == 0), model).collect() if r["doc_id"] in labels]
    assert area([(r["tails"][0], y["quality"]) for r, y in found]) > 0.9
    assert np.mean([abs(r["expected_grade"] - grade(y)) for r, y in found]) < 0.5


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counts, before = [docs.count()], docs
    for name, stage in pipeline.STAGES[:-1]:
        after = common.stash(stage(spark, before, DATA), name)
        assert after.columns == docs.columns and after.join(before, "doc_id", "left_anti").count() == 0
        counts.append(after.count())
        before = after
    # What dedup leaves has neither equal texts nor links.
    assert counts[1] < counts[0] and counts[4] < counts[3]
    left = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert all(v[3] == 0 and v[2] == 1 for v in brute_join(left).values())
    last = pipeline.STAGES[-1][1](spark, before, DATA)
    assert last.count() == counts[-1] and last.where("exact").count() == counts[-1]


def test_word_cache_forgets_what_is_old():
    made = []
    cache = common.WordCache(lambda w: made.append(w) or w.upper(), 2)
    assert [cache[w] for w in "abacb"] == list("ABACB") and made == ["a", "b", "c"]
    assert len(cache) + len(cache.old) <= 4


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a" * 5, "b", "c" * 9])], names=["doc_id", "text"])
    assert [(p.column(0).to_pylist(), len(t)) for p, t in common.slices(batch, budget=6)] == [([1, 2], 2), ([3], 1)]
