import math
import random
import zlib
from collections import Counter

import pytest

from callscope.llm import lm_scoring
from callscope.llm.lm_scoring import MU, score_documents


def brute(rows, mu=MU):
    def tokens(text):
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            text = text.replace(c, " ")
        return [w for w in text.split(" ") if w] + [None]

    out = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    words, pairs = Counter(), Counter()
    for (_, text), held in zip(rows, out):
        if not held:
            own = tokens(text)
            words.update(own)
            pairs.update(zip([None, *own], own))
    n, v = sum(words.values()), len(words)
    root = lambda w: (words[w] + 0.1) / (n + 0.1 * (v + 1))
    for (i, text), held in zip(rows, out):
        own = tokens(text)
        p = [(pairs[a, b] + mu * root(b)) / (words[a] + mu) for a, b in zip([None, *own], own)]
        yield i, held, len(own), sum(words[w] > 0 for w in own), n, sum(math.log10(root(w)) for w in own), sum(map(math.log10, p))


def data():
    rng = random.Random(8)
    vocabulary = [f"Word{k}" for k in range(60)] + ["É", "é", "a\x1cb", "x\x85y"]
    rows = [(k, rng.choice(" \n\t").join(rng.choices(vocabulary, k=rng.randrange(60)))) for k in range(300)]
    return rows + [(5, "again again"), (5, "again again"), (None, "no id"), (900, None), (901, ""), (902, "very long " * 20_000)]


@pytest.mark.parametrize("size", [16_000_000, 2_000])
def test_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", size)
    rows = data()
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, n string").repartition(3)
    key = lambda r: tuple(map(str, (*r[:5], round(r[5], 6), round(r[6], 6))))
    got, want = sorted(map(tuple, score_documents(docs).collect()), key=key), sorted(brute(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_probabilities_of_a_state_add_up():
    """Over all known words and one unknown word, for a seen and an unseen state."""
    rows = [(k, t) for k, t in enumerate(["a b a", "b b c", "c a"] * 10)]
    training = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    words = Counter(w for _, t in training for w in t.split()) + Counter({None: len(training)})
    n, v = sum(words.values()), len(words)
    root = {w: (words[w] + 0.1) / (n + 0.1 * (v + 1)) for w in [*words, "new"]}
    pairs = Counter(p for _, t in training for own in [[None, *t.split(), None]] for p in zip(own, own[1:]))
    for state in ["a", "unseen"]:
        assert sum((pairs[state, w] + MU * root[w]) / (words[state] + MU) for w in root) == pytest.approx(1.0)


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([(None, "some words")], "doc_id long, text string")
    [row] = score_documents(docs).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)
    assert score_documents(docs.limit(0)).count() == 0


def test_automaton_walks_arcs_and_failure_arcs():
    """Lanes give what one walk, token by token, over plain dictionaries gives."""
    import math

    import numpy as np

    from callscope.llm.lm_scoring import LANE, BackoffAutomaton

    rng = np.random.default_rng(5)
    n, mu = 40, 3.0
    words = np.r_[rng.integers(1, 30, 30), np.zeros(10)].astype(float)
    known = [(v, w) for v in range(30) for w in range(30) if rng.random() < 0.2]
    unseen = [(v, w) for v in range(n) for w in range(n) if rng.random() < 0.1 and (v, w) not in set(known)]
    pairs = {p: float(rng.integers(1, 5)) for p in known} | {p: 0.0 for p in unseen}
    at = np.array(list(pairs))
    total, distinct = int(words.sum()), 30
    automaton = BackoffAutomaton(words, np.array(list(pairs.values())), at[:, 0], at[:, 1], total, distinct, mu)
    assert len(automaton.arc_key) == len(known)  # no arc for what training does not hold
    tokens = rng.integers(0, n, 3 * LANE + 17)
    starts = np.array([0, 1, 300, 700])
    want, state = [], 7
    for w in tokens.tolist():
        root = (words[w] + 0.1) / (total + 0.1 * (distinct + 1))
        if state is not None and pairs.get((state, w), 0) > 0:
            want.append(math.log10((pairs[state, w] + mu * root) / (words[state] + mu)))
        else:
            want.append(math.log10(root) + (math.log10(mu / (words[state] + mu)) if state is not None else 0.0))
        state = w if words[w] > 0 else None
    assert np.allclose(automaton.traverse(tokens, starts, 7), np.add.reduceat(want, starts))
    empty = BackoffAutomaton(np.zeros(3), np.zeros(0), np.zeros(0, int), np.zeros(0, int), 0, 0, mu)
    assert np.allclose(empty.traverse(np.array([0, 2]), np.array([0]), 1), 0.0)
