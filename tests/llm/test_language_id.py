import zlib

import numpy as np

from callscope.llm.language_id import LanguageFilters, Settings, _codes, fit, ngrams, predict_documents, reject_unknown

WORDS = {
    "en": "the of and to in is was that with for as on are this from have".split(),
    "de": "der die das und ist nicht mit von für auf über schön groß ein eine".split(),
    "fr": "le la les des est dans pour que une être français où très avec sur".split(),
}


def rows(n=240):
    rng = np.random.default_rng(4)
    out = []
    for k in range(n):
        lang = sorted(WORDS)[k % 3]
        out.append((k, " ".join(rng.choice(WORDS[lang], 25)), lang))
    return out


def test_ngrams_stay_inside_a_text():
    codes, owner, letters = _codes(["ab, c", "", "1", "dé"])
    assert letters.tolist() == [3, 0, 0, 2]
    h, own = ngrams(codes, owner, 3)
    alone = [ngrams(*_codes([t])[:2], 3)[0].tolist() for t in ["ab, c", "", "1", "dé"]]
    assert [h[own == k].tolist() for k in range(4)] == alone and [len(a) for a in alone] == [4, 0, 0, 2]


def test_filter_returns_every_language_that_has_it():
    f = LanguageFilters([f"l{k:02}" for k in range(70)], Settings())
    rng = np.random.default_rng(1)
    own = [rng.integers(0, 2**63, 400).astype(np.uint64) for _ in range(70)]
    for k, h in enumerate(own):
        f.add(k, h)
    f.finish()
    for k, h in enumerate(own):
        bits = np.unpackbits(f.containing(h), axis=1, bitorder="little")
        assert bits[:, k].all()
    strangers = np.unpackbits(f.containing(rng.integers(0, 2**63, 20000).astype(np.uint64)), axis=1, bitorder="little")
    assert abs(strangers[:, :70].mean() - f.false_rate.mean()) < 1e-4


def test_held_out_accuracy_and_defined_cases(spark):
    data = rows() + [(900, None, "en"), (901, "", "fr"), (902, "123 !!", "de"), (903, "the of and", None), (903, "the of and", None), (None, "der die das und", "de"), (904, "und nicht " * 20_000, "de")]
    docs = spark.createDataFrame([(*r, 0.5) for r in data], "doc_id long, text string, lang string, score double").repartition(3)
    got = {r.doc_id: r for r in predict_documents(docs).collect()}
    held = [r for r in data if r[0] is not None and r[0] < 240 and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]].held_out and got[r[0]].lang_pred == r[2] for r in held) and len(held) > 20
    assert [got[k].lang_pred for k in (900, 901, 902, 903, None, 904)] == ["und", "und", "und", "en", "de", "de"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert predict_documents(docs).count() == len(data)
    kept = reject_unknown(docs)
    assert kept.columns == docs.columns and kept.count() == len(data) - 3


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in predict_documents(docs).collect()] == ["und"]
    assert predict_documents(docs.limit(0)).count() == 0
    assert fit(docs).languages == []


def test_predictions_equal_plain_code(monkeypatch):
    """Batches and pieces of any size give what one text at a time, n-gram by n-gram, gives."""
    import random

    import numpy as np
    import pytest

    from callscope.llm import language_id
    from callscope.llm.language_id import LanguageFilters, Settings, _codes, ngrams

    filters = LanguageFilters(["de", "en"], Settings())
    for k, words in enumerate(["der die das und ist nicht schön", "the of and to in is that"]):
        for n, _ in filters.settings.sizes:
            codes, owner, _ = _codes([words])
            filters.add(k, ngrams(codes, owner, n)[0])
    filters.finish()
    rng = random.Random(7)
    words = "der die das und the of and to in ,, 12 Ünd naïve ΣΑΣ \U0001F600 x".split()
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 400))) for _ in range(30)] + ["", "12 ..", "the" * 5000, "a\ud800b"]

    def plain(text):
        """Letters with one blank between words, every n-gram looked up for itself."""
        letters = [c if c.isalpha() else "\0" for c in f"\0{text.lower()}\0"]
        line = [c for c, before in zip(letters, ["a", *letters]) if c != "\0" or before != "\0"]
        hits, total = np.zeros(2), 0
        for n, _ in filters.settings.sizes:
            for at in range(len(line) - n + 1):
                gram = line[at : at + n]
                if any(c != "\0" for c in gram):
                    codes = np.array([0 if c == "\0" else ord(c) for c in gram], np.uint64)
                    mask = int(filters.containing(ngrams(codes, np.zeros(n, np.int64), n)[0])[0, 0])
                    hits += [mask & 1, mask >> 1 & 1]
                    total += 1
        if not any(c.isalpha() for c in text) or not total:
            return "und", 0.0
        share = np.clip((hits / total - filters.false_rate) / (1 - filters.false_rate), 0, 1)
        return filters.languages[int(share.argmax())], float(share.max())

    want = [plain(t) for t in texts]
    for size in (1 << 18, 500, 97):
        monkeypatch.setattr(language_id, "BATCH_CHARS", size)
        for (lang, score), (lang_, score_) in zip(filters.predict(texts), want):
            assert lang == lang_ and score == pytest.approx(score_)
