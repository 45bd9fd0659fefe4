import random

import numpy as np
import pytest
import xxhash

from callscope.llm.simhash import fingerprint, near_duplicates, near_links


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_equals_brute_force():
    for text in [None, "", "  \n", "One", "One two THREE", "a b c d", "É É é a b c\x85d e", "x y " * 500, "a\x1cb c d e f", " "]:
        assert fingerprint(text) == brute_fingerprint(text), text


def brute_components(rows, most=4):
    """rows: (doc_id, fp)"""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= most:
                root[find(i)] = find(j)
    best = {}
    for k, (doc, _) in enumerate(rows):
        best[find(k)] = min(best.get(find(k), doc), doc)
    return [best[find(k)] for k in range(len(rows))]


@pytest.mark.parametrize("most", [4, 8])
def test_links_connect_as_all_pairs_do(spark, most):
    from callscope.operators.components import connected_components

    rng = random.Random(1)
    fps = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 90])):
            x = base
            for _ in range(rng.randrange(7)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {0, (1 << 64) - 1, 0b1111, 0b11111}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = connected_components(near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), most))
    got = {r.node % (1 << 64): r.component for r in found.collect()}
    want = brute_components(list(enumerate(fps)), most)
    groups = {}
    for f, w in zip(fps, want):
        groups.setdefault(w, []).append(f)
    for members in groups.values():
        if len(members) > 1:
            assert len({got[m] for m in members}) == 1
        else:
            assert members[0] not in got
    assert len({got[m[0]] for m in groups.values() if len(m) > 1}) == sum(len(m) > 1 for m in groups.values())


def test_table_with_nulls_and_copies(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choice(words, 80)) for _ in range(30)]
    near = [t.replace(" w1", " v1", 1) for t in texts[:10]]
    rows = [(k, t) for k, t in enumerate(texts + near + texts[:5] + [None, "", " \n", "x"])] + [(3, texts[3]), (3, texts[3])]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fp string").repartition(3)
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect())
    prints = [(d, brute_fingerprint(t)) for d, t in rows]
    want = sorted((d, f"{f:016x}", c) for (d, f), c in zip(prints, brute_components(prints)))
    assert got == want
    assert near_duplicates(docs.limit(0)).count() == 0
