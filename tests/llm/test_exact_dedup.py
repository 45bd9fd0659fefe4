"""Exact dedup on its own: filters, nulls, ties, repeated rows, clashing columns."""

import random
from collections import Counter

import numpy as np

from callscope.llm.exact_dedup import CountingQuotientFilter, annotate, dedup, repeated_fingerprints

DDL = "doc_id long, text string, kept string, group_size int, _cs_note string"


def rows():
    rng = random.Random(4)
    texts = [f"text {k}" for k in range(60)] + ["", None, "Text 1", "text 1 ", "é", "é", "x" * 300_000]
    out = [(k, rng.choice(texts)) for k in range(200)] + [(None, "text 1"), (None, "only null"), (None, "only null"), (7, None), (500, "twice"), (500, "twice"), (500, "twice"), (499, "twice")]
    return [(i, t, rng.choice(["mine", "his"]), k, "n") for k, (i, t) in enumerate(out)]


def test_annotate_equals_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame(data, DDL).repartition(5)
    best, size = {}, Counter()
    for i, t, *_ in data:
        t = t or ""
        size[t] += 1
        best[t] = i if t not in best or best[t] is None or (i is not None and i > best[t]) else best[t]
    got = annotate(docs).collect()
    assert len(got) == len(data)
    for r in got:
        assert (r.keep_id, r.group_size) == (best[r.text or ""], size[r.text or ""])
        assert not r.kept or r.doc_id == r.keep_id
    assert Counter(r.text or "" for r in got if r.kept) == Counter(dict.fromkeys(size, 1))


def test_dedup_keeps_the_columns_of_the_table(spark):
    data = rows()
    docs = spark.createDataFrame(data, DDL).repartition(5)
    out = dedup(docs)
    assert out.schema == docs.schema
    kept = [tuple(r) for r in out.collect()]
    assert set(kept) <= set(data) and len(kept) == len({t or "" for _, t, *_ in data})
    assert dedup(docs.limit(0)).count() == 0 and annotate(docs.limit(0)).count() == 0


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    for n in (1, 40, 5000):
        fps = rng.integers(0, 1 << 20, n).astype(np.uint64)
        parts = [CountingQuotientFilter.from_bytes(CountingQuotientFilter.from_fingerprints(p, 60).to_bytes()) for p in np.array_split(fps, 4) if len(p)]
        whole = CountingQuotientFilter.from_bytes(CountingQuotientFilter.merge(parts, 60).to_bytes())
        names, counts = np.unique(fps, return_counts=True)
        assert (whole.fingerprints(60) == names).all() and (whole.counts == counts).all()


def test_repeated_fingerprints(spark):
    values = [5, 5, -1, -1, -1, 7, 1 << 62]
    fps = spark.createDataFrame([(v,) for v in values], "fp long").repartition(3)
    assert sorted(tuple(r) for r in repeated_fingerprints(fps).collect()) == [(-1, 3), (5, 2)]
