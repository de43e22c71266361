"""Toxicity: Levenshtein automata intersected with a lexicon trie catch misspelled terms; the words around a match tell
quotation from abuse.

The lexicon is learned: words, and beginnings of words (stems), that labelled toxic documents have and others hardly
have. Its trie is walked with the automata of all strings within MAX_DISTANCE edits of the words of some texts (one more for
long terms; a swap of neighbours is one), so one walk finds each term that a word, or for stems its beginning, may be a
misspelling of, for all these words. What is near a term but ordinary in clean texts is no misspelling:
the fit collects these words. A match between quotation marks, or after a reporting word (some are given, others are
learned: those that stand before matches in clean texts far more often than in toxic ones), counts as quoted. A logistic
regression on the counts gives the score. Nothing but the text is an input of a score.

The fit uses at most MAX_ROWS labelled rows, chosen by hash.

Defined cases: null and empty texts get the score of no match; without toxic labels the lexicon is empty and every text
has about the share of toxic labels (1/4 without any label); words of any length take time in proportion to it; equal texts, equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import WordCache, map_arrow, slices, texts_of
from cairn.llm.features import labelled_sample
from cairn.llm.near_dup import minhash, shingles

#: Labelled rows that a fit uses at most.
MAX_ROWS = 20_000
MAX_DISTANCE = 1
#: Shorter words are not corrected, and shorter beginnings are no stems. Terms of LEAST_TWO letters or more may have two errors.
LEAST_FUZZY, LEAST_TWO, LEAST_STEM, MOST_STEM = 4, 8, 4, 10
#: Words before a match that are looked at for quotation marks, and for reporting words.
WINDOW, NEAR = 6, 3
#: Tokens that a worker remembers, and pairs of a word and a term that are filtered at a time.
CACHE_ENTRIES, FILTERED = 500_000, 1 << 18
#: Letters of a word that an automaton reads: no longer term is corrected, and a stem is shorter. A match that is none.
LONGEST, NONE = 60, 1 << 62
# Signs written for letters, and words that report speech.
LOOKALIKE = str.maketrans("0134578@$!", "oieastbasi")
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes word term phrase insult slur dijo dit sagte palabra mot wort".split())
#: Clean texts that must tell a reporting word, and the inputs of a text without a match.
LEAST_TOLD, NO_MATCH = 8, (1.0, 0.0, 0.0, 0.0, 0.0, 0.0)
QUOTES = "\"“”„«»‘’'`"

_LETTERS = re.compile(r"[^\W\d_]+")


class Trie:
    """Terms and stems; matching a word gives (term, distance) of the best one, or None.

    wide: stems may have errors too, a swap of neighbours is one error, and terms of LEAST_TWO letters may have one error more.
    """

    def __init__(self, words: list[str], stems: list[str], distance: int = MAX_DISTANCE, wide: bool = False) -> None:
        self.wide = wide
        self.words, self.stems = set(words), set(stems)
        self.stem_sizes = sorted({len(s) for s in stems})
        self.root: dict = {}
        self.allowed: dict[str, int] = {}
        for term in [*words, *(s + "*" for s in stems if wide)]:
            node = self.root
            for c in term.rstrip("*"):
                node = node.setdefault(c, {})
            # A term and a stem may end at one node.
            node["*" if term.endswith("*") else ""] = term
            n = len(term.rstrip("*"))
            self.allowed[term] = 0 if n < LEAST_FUZZY or n > LONGEST - 8 else distance + 1 if wide and n >= LEAST_TWO else distance
        self.ranked = sorted(self.allowed)
        self.rank = {t: i for i, t in enumerate(self.ranked)}
        # An error adds one letter at most and removes one: what differs by more is not near. Letters share 64 bits; a stem's word may go on.
        near = [t for t, k in self.allowed.items() if k]
        self.budget = np.array([self.allowed[t] for t in near], dtype=np.int64)
        # The letters of a term's halves lie in the word's first and last letters, as many as the half has and one for each error.
        half = np.array([len(t.rstrip("*")) // 2 for t in near], dtype=np.int64)
        self.front, self.back = (np.array([_signature(x) for x in part], dtype=np.uint64) for part in zip(*((t[:h], t.rstrip("*")[h:]) for t, h in zip(near, half.tolist())))) if near else (np.zeros(0, dtype=np.uint64),) * 2
        self.letters = self.front | self.back
        self.upto, self.since = half + self.budget, np.maximum(half - self.budget, 0)
        self.surplus = np.array([64 if t.endswith("*") else self.allowed[t] for t in near], dtype=np.int64)
        self.least = np.array([len(t.rstrip("*")) for t in near], dtype=np.int64) - self.budget
        self.most = np.array([1 << 40 if t.endswith("*") else len(t) + self.allowed[t] for t in near], dtype=np.int64)
        self.shortest = int(self.least.min()) if near else 1 << 40

    def near(self, words: list[str], k: int) -> dict[str, tuple[str, int]]:
        """The best term within k errors of each word that has one: the trie and the automata of all words, walked together.

        Bit i of level e of a word's states is the state that has read i letters with e errors. A node is entered with the
        words that still have a state there.
        """
        n = np.array([min(len(w), LONGEST) for w in words], dtype=np.uint64)
        letters = np.zeros((len(words), int(n.max(initial=1))), dtype=np.uint32)
        inside = np.arange(letters.shape[1]) < n[:, None].astype(np.int64)
        letters[inside] = np.frombuffer("".join(w[:LONGEST] for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        places = np.uint64(1) << np.arange(letters.shape[1], dtype=np.uint64)
        masks: dict[str, np.ndarray] = {}
        one, final = np.uint64(1), np.uint64(1) << n
        full = (final << one) - one
        best = np.full(len(words), NONE)
        zero = np.zeros((k + 1, len(words)), dtype=np.uint64)
        start = zero + np.array([[(1 << e + 1) - 1] for e in range(k + 1)], dtype=np.uint64)
        # swapped: states whose next letter but one was read; read: those that came by a letter of the word.
        stack = [(self.root, np.arange(len(words)), start & full, zero, zero)]
        while stack:
            node, at, states, swapped, read = stack.pop()
            for c, child in node.items():
                if c == "" or c == "*":
                    # A stem's last letter must be in the word, else each of its beginnings would match.
                    for e in range(min(k, self.allowed[child]) + 1):
                        there = at[(states[e] & final[at] if c == "" else read[e]) != 0]
                        best[there] = np.minimum(best[there], e << 32 | self.rank[child])
                    continue
                if c not in masks:
                    masks[c] = np.where(letters == ord(c), places, np.uint64(0)).sum(axis=1, dtype=np.uint64)
                mask, whole = masks[c][at], full[at]
                new, by, half = np.empty_like(states), np.empty_like(states), np.zeros_like(states)
                for e in range(k + 1):
                    s = (states[e] & mask) << one
                    if e and self.wide:  # the letters in the other order
                        s |= (swapped[e] & mask) << np.uint64(2)
                        half[e] = states[e - 1] & mask >> one
                    by[e] = s & whole
                    if e:  # a letter too many in the term, another letter, or one left out
                        s |= states[e - 1] | states[e - 1] << one | new[e - 1] << one
                    new[e] = s & whole
                live = np.flatnonzero((new[k] != 0) | (half != 0).any(axis=0))
                if len(live):
                    stack.append((child, at[live], new[:, live], half[:, live], by[:, live]))
        some = np.flatnonzero(best < NONE)
        return {words[i]: (self.ranked[int(best[i]) & 0xFFFFFFFF], int(best[i]) >> 32) for i in some.tolist()}

    def match(self, word: str, ordinary: frozenset | set = frozenset()) -> tuple[str, int] | None:
        return self.match_all([word], ordinary).get(word)

    def match_all(self, words: Collection[str], ordinary: frozenset | set = frozenset()) -> dict[str, tuple[str, int]]:
        """The match of each word that has one. One step of NumPy tells, for all words and terms, which may be near; the trie is walked for these words."""
        out: dict[str, tuple[str, int]] = {}
        rest = []
        for word in words:
            if word in self.words:
                out[word] = word, 0
                continue
            for size in self.stem_sizes:
                if word[:size] in self.stems:
                    out[word] = word[:size] + "*", 0
                    break
            else:
                if len(word) >= self.shortest and word not in ordinary:
                    rest.append(word)
        step = max(1, FILTERED // max(1, len(self.budget)))
        for i in range(0, len(rest), step):
            part = rest[i : i + step]
            errors = self.errors(part)
            for k in np.unique(errors[errors > 0]).tolist():
                out |= self.near([part[j] for j in np.flatnonzero(errors == k).tolist()], k)
        return out

    def errors(self, words: list[str]) -> np.ndarray:
        """How many errors a term that may be near each word allows at most; 0: none may be."""
        n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        bits = np.append(np.uint64(1) << (codes & np.uint32(63)).astype(np.uint64), np.uint64(0))
        start = np.cumsum(n) - n

        def letters(first: np.ndarray, last: np.ndarray) -> np.ndarray:
            """Signatures of letters first to last (without it) of each word."""
            pairs = np.column_stack([start + first, start + np.maximum(last, first)]).ravel()
            return np.where(last > first, np.bitwise_or.reduceat(bits, pairs)[::2], np.uint64(0))

        count, zero = np.bitwise_count, np.zeros_like(n)
        may = (n[:, None] >= self.least) & (n[:, None] <= self.most) & (count(letters(zero, n)[:, None] & ~self.letters) <= self.surplus)
        missing = np.zeros(may.shape, dtype=np.uint8)
        for upto in np.unique(self.upto).tolist():
            terms = np.flatnonzero(self.upto == upto)
            missing[:, terms] += count(self.front[terms] & ~letters(zero, np.minimum(upto, n))[:, None])
        for since in np.unique(self.since).tolist():
            terms = np.flatnonzero(self.since == since)
            missing[:, terms] += count(self.back[terms] & ~letters(np.minimum(since, n), n)[:, None])
        return np.where(may & (missing <= self.budget), self.budget, 0).max(axis=1, initial=0)


def _signature(word: str) -> int:
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


def words_of(token: str) -> list[str]:
    """Words of letters in a lower-case token; where signs stand between letters, also what they may stand for."""
    found = _LETTERS.findall(token)
    if len(found) > 1 or found and len(found[0]) < len(token.strip(QUOTES + ".,;:!?()[]{}|#%&*-")):
        plain = token.strip(QUOTES + ".,;:!?()[]{}|#%&*-").translate(LOOKALIKE)
        joined = "".join(_LETTERS.findall(plain))
        if joined and joined not in found:
            found.append(joined)
    return found


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    ordinary: frozenset = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(6))
    reporting: frozenset = REPORTING
    wide: bool = True


class Scorer:
    def __init__(self, model: Model) -> None:
        self.trie = Trie(model.words, model.stems, wide=model.wide)
        self.ordinary, self.reporting, self.weights = model.ordinary, model.reporting, model.weights
        #: Tokens that were looked up, and the (term, distance, word) of those that match.
        self.seen: set[str] = set()
        self.known: dict[str, tuple[str, int, str]] = {}

    def learn(self, tokens: set[str]) -> None:
        """Look up the tokens that are new, all at once."""
        if len(self.seen) > CACHE_ENTRIES:
            self.seen, self.known = set(), {}
        new = {t: words_of(t) for t in tokens - self.seen}
        self.seen.update(t for t in new if len(t) <= WordCache.LONGEST)
        found = self.trie.match_all({w for words in new.values() for w in words}, self.ordinary)
        if found:
            for token, words in new.items():
                hits = [(*found[w], w) for w in words if w in found]
                if hits:
                    self.known[token] = min(hits, key=lambda h: h[1])

    def hits_of(self, texts: list[str]) -> list[tuple[list[tuple[int, tuple[str, int, str]]], list[str]]]:
        """For each text (place, (term, distance, word)) of each match, and the tokens."""
        each = [t.lower().split() for t in texts]
        self.learn(set().union(*each))
        known = self.known
        return [([(i, known[t]) for i, t in enumerate(tokens) if t in known], tokens) for tokens in each]

    def hits(self, text: str) -> tuple[list[tuple[int, tuple[str, int, str]]], list[str]]:
        return self.hits_of([text])[0]

    def quoted(self, tokens: list[str], place: int) -> bool:
        """Whether the token stands in quotation marks or after a reporting word."""
        token = tokens[place]
        if token[0] in QUOTES and token.rstrip(".,;:!?")[-1] in QUOTES:
            return True
        before = tokens[max(0, place - WINDOW) : place]
        if any(t.strip(QUOTES + ".,;:!?()") in self.reporting for t in before[-NEAR:]):
            return True
        opened = token[0] in QUOTES
        for t in before:
            if t[0] in QUOTES:
                opened = True
            if t.rstrip(".,;:!?")[-1:] and t.rstrip(".,;:!?")[-1] in QUOTES:
                opened = False
        after = tokens[place : place + WINDOW]
        return opened and any(t.rstrip(".,;:!?")[-1:] and t.rstrip(".,;:!?")[-1] in QUOTES for t in after)

    def features(self, hits: list, tokens: list[str]) -> tuple[list[float], int]:
        """Inputs of the score, from what hits_of found in a text; and how many matches are quoted."""
        plain = quoted = fuzzy = 0
        for place, (_, distance, _) in hits:
            if self.quoted(tokens, place):
                quoted += 1
            elif distance:
                fuzzy += 1
            else:
                plain += 1
        return [1.0, float(plain > 0), np.log1p(plain), np.log1p(fuzzy), np.log1p(quoted), np.log1p(1000 * (plain + fuzzy) / max(50, len(tokens)))], quoted

    def context(self, hits: list, tokens: list[str]) -> set[str]:
        """The words that stand just before matches."""
        return {w for place, _ in hits for t in tokens[max(0, place - NEAR) : place] if (w := t.strip(QUOTES + ".,;:!?()"))}


def _parts(text: str) -> set[str]:
    """Words of a text, and their beginnings as stems."""
    words = set(_LETTERS.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in range(LEAST_STEM, min(MOST_STEM, len(w) - 1) + 1)}


def _all_parts(texts: list[str]) -> Iterator[set[str]]:
    return map(_parts, texts)


def choose_terms(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, least: int) -> tuple[list[str], list[str]]:
    """Words and stems that tell: in least toxic documents or more, and at most one clean document for each 50 toxic ones at equal shares.

    Of a stem and its only continuation the longer is taken; what a chosen stem covers is not taken again.
    """
    tells = {f for f, c in toxic.items() if c >= least and clean.get(f, 0) / max(1, n_clean) <= 0.02 * c / max(1, n_toxic)}
    stems = sorted((f[:-1] for f in tells if f.endswith("*")), key=lambda s: (len(s), s))
    words, chosen, covered = [], [], []
    longer: dict[str, list[str]] = {}
    for f in tells:
        name = f.rstrip("*")
        for k in range(LEAST_STEM, len(name) + 1):
            longer.setdefault(name[:k], []).append(f)
    for stem in stems:
        if any(stem.startswith(c) for c in covered):
            continue
        covered.append(stem)
        same = [f for f in longer.get(stem, []) if toxic[f] >= 0.95 * toxic[stem + "*"]]
        best = max(same, key=lambda f: (len(f.rstrip("*")), not f.endswith("*")))
        (chosen if best.endswith("*") else words).append(best.rstrip("*"))
    words += [f for f in tells if not f.endswith("*") and not any(f.startswith(c) for c in covered)]
    return sorted(words), sorted(chosen)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    w = np.zeros(x.shape[1])
    if not len(y):
        return w
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _count(df: DataFrame, of, only: frozenset | None = None) -> DataFrame:
    """(feature, n): documents that have each feature; of(texts) gives the features of each text. Summed in each batch, then over all."""

    def make():
        def each(batch: pa.RecordBatch):
            counts: Counter = Counter()
            for found in of(batch.column(0).to_pylist()):
                counts.update(found & only if only is not None else found)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["feature", "n"])

        return each

    return map_arrow(df.select("text"), make, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def without_near_copies(sample: DataFrame, keys: int = 8, width: int = 3) -> DataFrame:
    """The sample (doc_id, text, ...) without rows that share one of the first MinHash values with a row before: a text in many near copies would vote for each of its words."""

    def make():
        def each(batch: pa.RecordBatch):
            values = [minhash(shingles(t.as_py(), width))[:keys] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.astype(np.int64).tolist() for v in values], pa.list_(pa.int64()))], names=["doc_id", "keys"])

        return each

    # At most MAX_ROWS rows.
    rows = map_arrow(sample.select("doc_id", "text"), make, "doc_id long, keys array<long>").toArrow().sort_by("doc_id")
    seen: set[tuple[int, int]] = set()
    stay = []
    for doc, values in zip(rows["doc_id"].to_pylist(), rows["keys"].to_pylist()):
        marks = set(enumerate(values))
        if not marks & seen:
            stay.append((doc,))
        seen |= marks
    return sample.join(F.broadcast(sample.sparkSession.createDataFrame(stay, "doc_id long")), "doc_id")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, wide: bool = True) -> Model:
    """Learn lexicon, ordinary and reporting words and weights from labels (id, 0/1). wide: see Trie."""
    sample = labelled_sample(texts_of(docs, id_col, text_col), labels.select(id_col, F.col(label_col).cast("int").alias("toxic")), ["toxic"], max_rows, id_col)
    sample = without_near_copies(sample)
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        share = (n1 + 0.5) / (n1 + n0 + 2)
        return Model(weights=np.array([np.log(share / (1 - share)), 0, 0, 0, 0, 0.0]))
    least = max(5, -(-n1 // 100))
    # A feature of at least 1 % of the sample's toxic documents: as many as they have words, times 100, at most.
    toxic = {r["feature"]: r["n"] for r in _count(sample.where("toxic = 1"), _all_parts).where(F.col("n") >= least).collect()}
    only = frozenset(toxic)
    clean = {r["feature"]: r["n"] for r in _count(sample.where("toxic = 0"), _all_parts, only).collect()}
    words, stems = choose_terms(toxic, clean, n1, n0, least)
    model = Model(words, stems, wide=wide)

    def misspelled(texts: list[str]) -> list[set[str]]:
        return [{h[2] for _, h in hits if h[1]} for hits, _ in Scorer_of(model).hits_of(texts)]

    near = {y: {r["feature"]: r["n"] for r in _count(sample.where(F.col("toxic") == y), misspelled).collect()} for y in (0, 1)}
    model.ordinary = frozenset(w for w, n in near[0].items() if n / n0 >= 0.5 * near[1].get(w, 0) / n1)

    def contexts(texts: list[str]) -> list[set[str]]:
        """What stands before matches; an empty word for each text that has one."""
        scorer = Scorer_of(model)
        return [scorer.context(*found) | {""} if found[0] else set() for found in scorer.hits_of(texts)]

    before = [{r["feature"]: r["n"] for r in _count(sample.where(F.col("toxic") == y), contexts).where("n > 1 or feature = ''").collect()} for y in (0, 1)]
    model.reporting = REPORTING | reporting_words(*before)

    def make():
        scorer = Scorer_of(model)

        def each(batch: pa.RecordBatch):
            x = [scorer.features(*found)[0] for found in scorer.hits_of(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

        return each

    rows = map_arrow(sample.select("doc_id", "text", "toxic"), make, "doc_id long, toxic int, x array<double>").toArrow().sort_by("doc_id")
    model.weights = _logistic(np.array(rows.column("x").to_pylist()), rows.column("toxic").to_numpy().astype(float))
    return model


def reporting_words(clean: dict[str, int], toxic: dict[str, int]) -> frozenset:
    """Words that stand before matches in clean texts far more often than in toxic ones: clean, toxic: texts by word, and at "" those with a match."""
    n0, n1 = clean.get("", 0), toxic.get("", 0)
    return frozenset(w for w, n in clean.items() if w and n >= max(LEAST_TOLD, 0.05 * n0) and n / n0 >= 5 * (toxic.get(w, 0) + 1) / (n1 + 1))


_scorers: dict[tuple, Scorer] = {}


def Scorer_of(model: Model) -> Scorer:  # noqa: N802
    """The scorer of a model, one a Python worker."""
    key = (tuple(model.words), tuple(model.stems), model.ordinary, model.reporting, model.wide)
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, n_terms, n_misspelled, n_quoted, terms of each row."""

    def make():
        scorer = Scorer_of(model)
        weights = model.weights

        def each(batch: pa.RecordBatch):
            out: list[list] = [[] for _ in range(4)]
            names = []
            for _, texts in slices(batch, budget=FILTERED):
                for hits, tokens in scorer.hits_of(texts):
                    x, quoted = scorer.features(hits, tokens) if hits else (NO_MATCH, 0)
                    out[0].append(float(1 / (1 + np.exp(-np.clip(np.dot(x, weights), -40, 40)))))
                    out[1].append(len(hits))
                    out[2].append(sum(h[1] > 0 for _, h in hits))
                    out[3].append(quoted)
                    names.append(sorted({h[0] for _, h in hits}))
            scores = np.array(out[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), *[pa.array(c, pa.int64()) for c in out[1:]], pa.array(names, pa.list_(pa.string()))],
                names=["doc_id", "score", "predicted", "n_terms", "n_misspelled", "n_quoted", "terms"],
            )

        return each

    return map_arrow(texts_of(df, id_col, text_col), make, "doc_id long, score double, predicted int, n_terms long, n_misspelled long, n_quoted long, terms array<string>")
