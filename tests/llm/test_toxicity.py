"""Toxicity scores against features computed word by word, with all distances."""

import itertools

import numpy as np
import pytest

from cairn.llm import toxicity

TERMS, STEMS, ORDINARY = ["idiot", "worthless", "scum"], ["lowei", "grumblew"], frozenset(["slum", "idiom"])
WEIGHTS = np.array([-2.0, 1.5, 0.75, 0.5, -1.25, 0.3])


def distance(a, b):
    """Edits, a swap of neighbours being one."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def match(word):
    """(distance, term) of the best term, or None. A stem's last letter must be one of the word's."""
    if word in TERMS:
        return 0, word
    for s in sorted(STEMS, key=len):
        if word.startswith(s):
            return 0, s + "*"
    if word in ORDINARY:
        return None
    near = [(distance(word, t), t) for t in TERMS if distance(word, t) <= 1 + (len(t) >= 8)]
    for s in STEMS:
        ends = [distance(word[:k], s) for k in range(1, len(word) + 1) if s.endswith(word[k - 1]) or word[k - 2 : k] == s[: -3 : -1]]
        near += [(d, s + "*") for d in ends if d <= 1 + (len(s) >= 8)]
    return min(near, default=None)


def quoted(tokens, place, reporting):
    """In quotation marks that open within six tokens before and close within six, or near after a reporting word."""
    q = set(toxicity.QUOTES)
    ends = [t.rstrip(".,;:!?")[-1:] in q and t.rstrip(".,;:!?") != "" for t in tokens]
    starts = [t[0] in q for t in tokens]
    if starts[place] and ends[place] or any(t.strip(toxicity.QUOTES + ".,;:!?()") in reporting for t in tokens[max(0, place - 3) : place]):
        return True
    state = starts[place]
    for i in range(max(0, place - 6), place):
        state = (state or starts[i]) and not ends[i]
    return state and any(ends[place : place + 6])


def expected(text, reporting):
    tokens = text.lower().split()
    plain = fuzzy = inside = 0
    for i, t in enumerate(tokens):
        hits = [m for w in toxicity.words_of(t) if (m := match(w))]
        if hits:
            if quoted(tokens, i, reporting):
                inside += 1
            elif min(hits)[0]:
                fuzzy += 1
            else:
                plain += 1
    if not plain + fuzzy + inside:
        x = [1, 0, 0, 0, 0, 0]
    else:
        x = [1, plain > 0, np.log1p(plain), np.log1p(fuzzy), np.log1p(inside), np.log1p(1000 * (plain + fuzzy) / max(50, len(tokens)))]
    return float(1 / (1 + np.exp(-np.dot(x, WEIGHTS)))), inside


def texts():
    r = np.random.default_rng(17)
    words = [*TERMS, "loweichen", "grumbleworts", "idoit", "worthles", "slum", "idiom", "calm", "river", "said", "murmured", "1d10t!", "scum.", "x" * 70, "lowei" + "z" * 80]
    for _ in range(400):
        out = [str(w) for w in r.choice(words, r.integers(0, 14))]
        for _ in range(int(r.integers(0, 4))):
            if out:
                i = int(r.integers(len(out)))
                out[i] = [f'"{out[i]}"', f'"{out[i]}', f'{out[i]}",', f"({out[i]})", out[i].upper()][int(r.integers(5))]
        yield " ".join(out)
    yield from ("", "   ", '"', '"scum', 'scum"', "He said: idiot", "idiot " * 300)


@pytest.mark.parametrize("reporting", [toxicity.REPORTING, frozenset(["murmured"])])
def test_scores(spark, reporting):
    model = toxicity.Model(TERMS, STEMS, ORDINARY, WEIGHTS, reporting)
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model).collect()}
    for i, text in rows:
        score, inside = expected(text, reporting)
        assert got[i]["score"] == pytest.approx(score, abs=1e-12) and got[i]["n_quoted"] == inside, text
    assert sum(r["n_quoted"] > 0 for r in got.values()) > 40 and sum(r["n_misspelled"] > 0 for r in got.values()) > 100


def test_batches_and_single_words_agree():
    trie = toxicity.Trie(TERMS, STEMS, wide=True)
    r = np.random.default_rng(4)
    words = {"".join(r.choice(list("idotwrhlescumgb"), r.integers(1, 12))) for _ in range(800)} | {t[:i] + c + t[j:] for t in [*TERMS, *STEMS] for i in range(len(t)) for j in (i, i + 1) for c in "xo"}
    together = trie.match_all(words, ORDINARY)
    assert together == {w: m for w in words if (m := trie.match(w, ORDINARY))} and len(together) > 50
    for w in words:
        assert (together[w][::-1] if w in together else None) == match(w), w


def test_reporting_words_are_learned():
    clean = {"": 100, "murmured": 30, "the": 60, "rare": 3}
    assert toxicity.reporting_words(clean, {"": 100, "the": 70}) == {"murmured"}
    assert toxicity.reporting_words({}, {"": 5}) == frozenset()
