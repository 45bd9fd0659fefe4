import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from callscope.llm.token_counts import count_tokens, token_counter

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.no_padding()
TOKENIZER.no_truncation()
PIECES = ["a", "aaaa", "Zebra", " ", "  ", "\n", "\t", "don't", "I'LL", "1234", "\xe9", "É", "\xdf.", "<|endoftext|>", "<|startoftext|>", "<|end", "<", "\x1c", "\x85", "\xa0", " ", "漢字", "!!!!", "\x00", "ΣΣ", "İ", "internationalisation", "\U0001f600"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_counts_equal_the_library(text):
    assert token_counter(PATH).count([text]) == [len(TOKENIZER.encode(text, add_special_tokens=False).ids)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x17F), max_size=40))
def test_any_latin_text(text):
    assert token_counter(PATH).count([text]) == [len(TOKENIZER.encode(text, add_special_tokens=False).ids)]


def test_whole_texts_nulls_and_repeats(spark):
    rows = [(1, "One two"), (1, "One two"), (2, None), (3, ""), (None, "x" * 50_000), (4, "word " * 30_000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int")
    out = count_tokens(docs, PATH)
    want = sorted((str(i), len((t or "").encode()), n := len(TOKENIZER.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()) == want
    assert count_tokens(docs.limit(0), PATH).count() == 0


def test_long_pretokens():
    """Half a million letters without a space, at random and in one run, against the library."""
    import random
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    from callscope.llm.token_counts import TokenCounter

    path = public_tokenizers.path("word_bpe_49k.json")
    library, counter = Tokenizer.from_file(path), TokenCounter(path)
    library.no_truncation(), library.no_padding()
    rng = random.Random(3)
    for letters, n in (("abcdefghijklmnopqrstuvwxyz", 700), ("etaoin", 5000), ("ab", 3001), ("a", 4001), ("éaü漢", 2000)):
        text = "".join(rng.choices(letters, k=n))
        assert counter.count([text]) == [len(library.encode(text, add_special_tokens=False).ids)]
    began = time.time()
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=500_000))
    n = counter.count([text])[0]
    assert time.time() - began < 60 and 100_000 < n < 500_000
