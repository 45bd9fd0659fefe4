import random

from callscope.llm.near_dedup import keep_one
from callscope.llm.simhash import fingerprint


def plain_set(text):
    w = text.split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_links_are_exact_indices(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(4000)]
    texts = []
    for _ in range(60):
        base = rng.choices(words, k=rng.randrange(40, 200))
        texts.append(base)
        for _ in range(3):
            other = list(base)
            for at in rng.sample(range(len(base)), rng.randrange(1, 1 + len(base) // 30 + 1)):
                other[at] = "new" + rng.choice(words)
            texts.append(other)
    texts = [" ".join(t) for t in texts] + ["a b", "a b c d e", "a b c d e f"]
    sets = [plain_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    far = close = 0
    for i in range(len(texts)):
        for j in range(i):
            bits = (fingerprint(texts[i], 5) ^ fingerprint(texts[j], 5)).bit_count()
            if alike(sets[i], sets[j]):
                far += bits > 8
                root[max(find(i), find(j))] = min(find(i), find(j))
            else:
                close += bits <= 8
    assert far and close  # pairs that one fingerprint within 8 bits loses, and pairs that it links wrongly
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == sorted({find(k) for k in range(len(texts))})


def test_large_group_and_blanks(spark):
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join([*base, f"x{k}"])) for k in range(600)] + [(700, ""), (701, " \n"), (702, None), (702, None), (None, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == [0, 700]
    assert keep_one(docs.limit(0)).count() == 0


def test_chunks_lose_no_link(spark):
    """Components that are dealt to many small chunks give the groups of one search."""
    import numpy as np

    from callscope.llm import groups
    from callscope.operators.components import connected_components

    rng = random.Random(5)
    # Items on lines: neighbours at distance 1 link; line 0 has gaps, line 1 is one long chain, line 2 is loose.
    rows = [(0, k, float(k + k // 40 * 3)) for k in range(400)] + [(1, 1000 + k, float(k)) for k in range(300)] + [(2, 2000 + k, 10.0 * k) for k in range(60)] + [(3, 3000, 0.0), (3, 3001, 1.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, item long, at double").repartition(3)
    chunks = spark.createDataFrame([(0, 13), (1, 9), (2, 4)], "g long, n long")

    def read(columns):
        return columns[0].to_pylist()

    def roots_of(kept):
        kept = np.array(kept)
        order = np.argsort(kept)
        start = np.r_[True, np.diff(kept[order]) > 1]
        root = np.empty(len(kept), np.int64)
        root[order] = order[np.maximum.accumulate(np.where(start, np.arange(len(kept)), 0))]
        return root

    for most in (1000, 3):  # representatives searched at once, or in chunks again
        links = groups.links(df, chunks, read, roots_of, most)
        got = {}
        for r in connected_components(links).collect():
            got.setdefault(r.component, set()).add(r.node)
        want = {}
        for g, item, at in rows:
            if g == 0:
                want.setdefault((0, item // 40), set()).add(item)
            elif g == 1 or g == 3:
                want.setdefault(g, set()).add(item)
        assert sorted(map(min, got.values())) == sorted(map(min, want.values()))
        assert sorted(map(len, got.values())) == sorted(map(len, want.values()))


def test_large_keys_lose_no_link(spark):
    from callscope.llm.simhash import near_links
    from callscope.operators.components import connected_components

    rng = random.Random(6)
    fps = {0}
    for _ in range(3):
        base = rng.getrandbits(63)
        for _ in range(300):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(20), 3)))
    fps |= {rng.getrandbits(63) for _ in range(300)}
    df = spark.createDataFrame([(f,) for f in sorted(fps)], "fp long").repartition(3)
    found = [{(r.node, r.component) for r in connected_components(near_links(df, 4, most)).collect()} for most in (100_000, 60)]
    assert found[0] == found[1] and len(found[0]) > 700
