import hashlib
import math
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from callscope.llm.secrets import WINDOW, base_spans, redact, scan, scan_documents, window_entropies

PLAIN = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}
PARTS = ["password", "PassWd", "SECRET", "token", "api_key", "APIKEY", "'", '"', " ", "  ", ":", "=", "abc", "12345678", "AKIA", "ABCDEF123456", "0123456789abcdef", "é", "\n", "long.value-9", "deadbeef" * 5]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=20).map("".join))
def test_base_spans_equal_the_plain_patterns(text):
    want = [(*m.span(), "assign") for m in PLAIN["assign"].finditer(text) if len(m.group(2)) >= 8]
    want += [(*m.span(), "access") for m in PLAIN["access"].finditer(text) if len(m.group()) >= 16]
    want += [(*m.span(), "hex") for m in PLAIN["hex"].finditer(text) if len(m.group()) >= 32]
    assert sorted(base_spans(text)) == sorted(want)
    base, spans = scan(text)
    assert set(base) <= set(spans) and [s[0] for s in spans] == sorted(s[0] for s in spans)


@settings(max_examples=200, deadline=None)
@given(st.text("ab01XY", min_size=WINDOW, max_size=80))
def test_incremental_entropy(text):
    for k, h in enumerate(window_entropies(text)):
        counts = Counter(text[k : k + WINDOW]).values()
        assert math.isclose(h, -sum(c / WINDOW * math.log2(c / WINDOW) for c in counts), abs_tol=1e-9)


def test_added_spans_and_allow_list():
    kinds = lambda t: [k for _, _, k in scan(t)[1]]
    assert kinds("see q7Zp0LmX2vB9sKd4TgW8yRfA1 here") == ["entropy"]
    assert kinds("key is 9b0b3c6a43eb78aa99cbd704 here") == ["entropy"]
    for clean in ["internationalisation_of_words", "123e4567-e89b-12d3-a456-426614174000", "2024-01-01T00:00:00-00", "z" * 500, "1234 " * 50, "path/to/some/file/of/2024/data", "ABCDEFGHIJKLMNOPQRSTUVWXYZabc", "exampleK3yF0rTheD0cs9Zz1"]:
        assert kinds(clean) == [], clean
    assert redact('a token = "abcdefgh1" b') == 'a [secret]" b' and redact(None) is None


def test_rows(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh", "x"), (1, "token=abcdefgh", "x"), (2, None, "y"), (3, "", "z"), (None, "f" * 100_000, "z")], "doc_id long, text string, spans string")
    got = sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in scan_documents(docs).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted([("1", 1, 0, 0, sha("assign:0:14"), "assign:0:14")] * 2 + [("2", 0, 0, 0, sha(""), ""), ("3", 0, 0, 0, sha(""), ""), ("None", 0, 0, 1, sha("hex:0:100000"), "hex:0:100000")])
    assert scan_documents(docs.limit(0)).count() == 0
