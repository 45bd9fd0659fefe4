import hashlib

import numpy as np

from callscope.llm.merkle import differing, edited, fingerprint_and_compare, likeness, parse, tree


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 4
        changed = text[: len(text) - n] + following[:n]
        a, b, c = tree(text), tree(changed), tree(following)
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), str(a), str(b), likeness(a, b), likeness(a, c)))
    return out


def test_edits_stay_local():
    rng = np.random.default_rng(5)
    words = [f"word{k}" for k in range(900)]
    lines = [" ".join(rng.choice(words, 30)) + ". " + " ".join(rng.choice(words, 40)) for _ in range(40)]
    a = tree("\n".join(lines))
    b = tree("\n".join([*lines[:20], "One new line.", *lines[20:]]))
    x, y = differing(a, b)
    assert not x and len(y) == 1
    assert likeness(a, b) > 0.98 and likeness(a, a) == 1.0
    assert likeness(a, tree(" ".join(rng.choice(words, 300)))) == 0.0
    text = "\n".join(lines)
    assert 0.65 < likeness(a, tree(edited(text, "other " * 5000))) < 0.85
    assert str(tree("a\nb")) != str(tree("a\n\nb")) and str(tree(None)) == str(tree(""))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    words = ["été", "Über", "x", "one.", "two\n", "three!", "漢字", " "]
    rows = [(int(k), " ".join(rng.choice(words, int(rng.integers(0, 120))))) for k in rng.permutation(300)]
    rows += [(5, "again"), (5, "again"), (5, None), (None, "no id"), (-9, ""), (10**12, None), (17, "long " * 20_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _bucket int").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted((tuple(r) for r in fingerprint_and_compare(docs).collect()), key=key) == sorted(brute(rows), key=key)


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    [row] = fingerprint_and_compare(docs).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1.0
    assert fingerprint_and_compare(docs.limit(0)).count() == 0


def test_roots_cover_line_ends_and_strings_give_trees_back():
    texts = ["", "\n", "\n\n", "a", "a\n", "\na", "a\n\n", "a\nb", "a\n\nb", "\n\na\nb\n", "b\na", "a b", "a. b", "a.\nb", "a.  b", " a", "a ", "long " * 400, "long " * 400 + "x. " * 90 + "\n" * 7 + "end"]
    texts += ["\n".join(f"line {k} of {n}. And more." for k in range(n)) for n in (3, 30, 300)]
    trees = [tree(t) for t in texts]
    assert len({t.root for t in trees}) == len(texts)
    for a in trees:
        assert parse(str(a)) == a
        for b in trees:
            assert likeness(parse(str(a)), parse(str(b))) == likeness(a, b)
