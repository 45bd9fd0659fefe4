import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from callscope.llm.packing import Limits, pack_documents, pack_examples, unit_encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Zeb", " ", "  ", "\n", "\t", "don't", "12", "\xe9", "\xdf.", "<|endoftext|>", "<|end", "\x1c", "\x85", "\xa0", "\u2003", "\u6f22", "!!", "\x00", "e\u0301"]), max_size=14).map("".join))
def test_units_join_to_the_library_ids(text):
    [ids] = unit_encoder(PATH).encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_round_trip_of_all_pieces(spark):
    texts = {1: "a b c", 2: None, 3: "", 4: "word " * 5000, 5: "Zahl 12  und\n\nmehr ", 6: "x" * 9000}
    for k in range(7, 200):
        texts[k] = f"Text {k} " * (k % 37)
    docs = spark.createDataFrame([(k, t, "s") for k, t in texts.items()], "doc_id long, text string, start string").repartition(3)
    rows = pack_documents(docs, PATH).collect()
    for k, t in texts.items():
        ids = [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)]).tolist()[:-1]
        assert sum(r.length for r in own) == len(ids) and {r.doc_tokens for r in own} == {len(ids)}
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0, *(n for _, n in pieces)]).tolist()[:-1]
        total = sum(n for _, n in pieces)
        assert total <= 2048 and total & (total - 1) == 0 and len(pieces) <= Limits().segments


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(docs, PATH).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string").coalesce(1)
    assert sorted(r.length for r in pack_documents(docs, PATH).where("doc_id = 1").collect()) == [3, 3]


def test_examples_keep_all_three_limits(spark):
    rng = np.random.default_rng(0)
    rows = [(k, int(t), int(t * f)) for k, (t, f) in enumerate(zip(rng.integers(1, 900, 500), rng.random(500)))] + [(900, 5000, 10), (901, None, None)]
    limits = Limits(tokens=1000, segments=5, loss=400)
    out = pack_examples(spark.createDataFrame(rows, "example_id long, tokens long, loss_tokens long"), limits).collect()
    assert sorted(r.example_id for r in out) == sorted(r[0] for r in rows)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append(r)
    for members in sequences.values():
        if len(members) > 1:
            assert sum(r.tokens for r in members) <= 1000 and sum(r.loss_tokens for r in members) <= 400 and len(members) <= 5


def test_conversations_under_three_limits(spark):
    """Every conversation lies in one sequence, whole and gapless, and all three limits hold."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from callscope.llm.packing import INSTRUCTION_LIMITS, conversation_examples, pack_examples

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, rng = Tokenizer.from_file(path), random.Random(4)
    turns = [(c if c else None, k, rng.choice(["user", "assistant", None]), rng.choice([None, "", "some words of it " * rng.randrange(1, 60)])) for c in range(120) for k in range(rng.randrange(1, 5))]
    turns += [(500, 0, "assistant", "too long " * 3000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    want = {}
    for c, _, role, text in turns:
        n = len(library.encode(text or "", add_special_tokens=False).ids) + 1
        t, loss = want.get(c, (0, 0))
        want[c] = (t + n, loss + (n if role == "assistant" else 0))
    rows = pack_examples(conversation_examples(df, path), INSTRUCTION_LIMITS).collect()
    assert {r.example_id: (r.tokens, r.loss_tokens) for r in rows} == want and len(rows) == len(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.tokens for x in own[:k]) for k in range(len(own))]
        if len(own) > 1:
            assert sum(r.tokens for r in own) <= INSTRUCTION_LIMITS.tokens and len(own) <= INSTRUCTION_LIMITS.segments and sum(r.loss_tokens for r in own) <= INSTRUCTION_LIMITS.loss
