import hashlib
import random
import re

from callscope.llm.pii import FEATURES, Training, as_column, boost, evaluate, fit, scan

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def check(kind, m):
    d = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def brute(text):
    spans = [(kind, *m.span()) for kind, p in PLAIN.items() for m in p.finditer(text or "") if check(kind, m.group())]
    joined = ",".join("%s:%d:%d" % s for s in spans)
    return [sum(s[0] == k for s in spans) for k in PLAIN], hashlib.sha256(joined.encode()).hexdigest(), joined


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(11)
    parts = ["a", "b.c", "@", ".", "..", "_", "-", " ", "1", "12", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", "+", "+1 (017) 555-7713", "(", ")", "é", "x@y.zz", "1.2.3.4", "0001", "\n", "日本", "5500005555555559", "+49"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 16))) for _ in range(3000)]
    texts += [None, "", "7" * 60_000, "a" * 60_000 + "@", "1." * 30_000, "+1" + "(" * 50_000, "1 " * 40_000 + "x", "4111111111111111 " * 300, "a@b.c_d@e.f"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(4)
    got = {r.doc_id: r for r in scan(docs).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        counts, sha, joined = brute(text)
        r = got[k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == sha, text
        assert r.spans == joined or r.spans.startswith(joined), text


def test_added_spans(spark):
    yes = ["call me on (212) 555-0199 today", "SSN 219-09-9999", "IBAN DE89 3704 0044 0532 0130 00 please", "write to jane.doe (at) mail (dot) com", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"]
    no = ["on 2024-01-15 we met", "order 12345678", "ISBN 978-3-16-148410-0", "12 34 56 78 90 12", "we met at noon. dot", "plain words only", "look at word.word now"]
    docs = spark.createDataFrame(list(enumerate(yes + no)), "doc_id int, text string")
    spans = {r.doc_id: r.spans for r in scan(docs).collect()}
    assert all(spans[k] for k in range(len(yes))), spans
    assert not any(spans[k] for k in range(len(yes), len(yes + no))), spans


def test_trees_as_sql(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    x = rng.integers(0, 9, (400, len(FEATURES))).astype(float)
    y = ((x[:, 0] > 4) & (x[:, 3] <= 2)).astype(float)
    trees = boost(x, y, Training())
    odds = sum(evaluate(t, x) for t in trees)
    assert ((odds > 0) == (y > 0)).mean() > 0.99
    df = spark.createDataFrame([(tuple(r),) for r in x.tolist()], "f struct<" + ",".join(f"{n}:double" for n in FEATURES) + ">")
    got = [r[0] for r in df.select(sum((as_column(t, F.col("f")) for t in trees), F.lit(0.0))).collect()]
    assert np.allclose(got, odds)
    assert all(np.isfinite(t) for t in fit(spark).thresholds.values())


def test_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "a@b.cc"), (1, "a@b.cc"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.spans) for r in scan(docs).collect()) == [("1", "email:0:6"), ("1", "email:0:6"), ("None", "")]
    assert scan(docs.limit(0)).count() == 0


def test_overlapping_proposals(spark):
    """The right one of overlapping spans is chosen, next to years and in lists."""
    texts = ["call 555-123-4567 555-987-6543 now", "SSN 123-45-6789 2021", "from fe80::8a2e:370:7334 today", "IBAN DE89 3704 0044 0532 0130 00 2021", "card 4111 1111 1111 1111, phone 555-123-4567"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: [texts[r.doc_id][int(s):int(e)] for kind, s, e in (x.split(":") for x in r.spans.split(",")) if kind != "card"] for r in scan(docs).collect()}
    assert got == {0: ["555-123-4567", "555-987-6543"], 1: ["123-45-6789"], 2: ["fe80::8a2e:370:7334"], 3: ["DE89 3704 0044 0532 0130 00"], 4: ["555-123-4567"]}


def test_choice_equals_plain_code(spark):
    """Base spans shut candidates out; of overlapping candidates the better stays."""
    from pyspark.sql import functions as F

    from callscope.llm.pii import _chosen

    rng = random.Random(8)
    rows = []
    for k in range(300):
        spans = lambda n: [(s := rng.randrange(60 if k else 9000), s + rng.randrange(1, 12)) for _ in range(n)]  # noqa: B023, E731
        many = 2000 if k == 0 else rng.randrange(9)
        rows.append((k, spans(many // 2), [(0, s, e, "m", float(rng.randrange(4))) for s, e in spans(many)]))
    df = spark.createDataFrame(rows, "k int, base array<struct<s:int,e:int>>, scored array<struct<kind:int,s:int,e:int,m:string,odds:double>>").repartition(3)
    got = {r.k: [(x.s, x.e) for x in r.out] for r in df.select("k", _chosen(F.col("base"), F.col("scored")).alias("out")).collect()}
    for k, base, scored in rows:
        held, out = None, []
        for s, e, o in sorted((s, e, o) for _, s, e, _, o in scored if all(e <= b or s >= d for b, d in base)):
            if held and s >= held[1]:
                out.append(held[:2])
                held = None
            if held is None or (o, e - s) > (held[2], held[1] - held[0]):
                held = (s, e, o)
        assert got[k] == out + ([held[:2]] if held else [])
        assert all(e <= b or s >= d for s, e in got[k] for b, d in base) and all(a[1] <= b[0] for a, b in zip(got[k], got[k][1:]))


def test_many_matches_in_one_text(spark):
    import time

    text = " ".join(f"555-{k % 900 + 100}-{k % 9000 + 1000}" for k in range(100_000))
    docs = spark.createDataFrame([(0, "phone " + text)], "doc_id int, text string")
    scan(docs.limit(0)).count()
    began = time.time()
    r = scan(docs).collect()[0]
    assert len(r.spans) > 1_000_000 and time.time() - began < 60


def test_audit(spark):
    from callscope.llm.pii import audit

    docs = spark.createDataFrame([(0, "IBAN DE89 3704 0044 0532 0130 00 or IBAN DE88 3704 0044 0532 0130 00"), (1, "SSN 219-09-9999, SSN 000-12-3456")], "doc_id int, text string")
    assert sorted(tuple(r) for r in audit(docs).collect()) == [("account", 2, 1), ("social", 2, 1)]
