"""The pipeline's stages against plain code on a small table."""

import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from callscope.llm.mixing import mix_documents
from tests.llm.test_near_dedup import alike, plain_set


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(2)
    words = {"en": "the of and to in is was that with for as on".split(), "de": "der die das und ist nicht mit von für auf über schön".split()}
    rows = []
    for k in range(120):
        lang = rng.choice(["en", "de"])
        rows.append((k, " ".join(f"{rng.choice(words[lang])}{rng.choice(words[lang])}" for _ in range(rng.randrange(60, 200))), lang))
    rows += [(200 + k, *rows[k][1:]) for k in range(15)]  # exact copies
    rows += [(300 + k, rows[k][1] + " the", rows[k][2]) for k in range(20, 40)]  # near copies
    rows += [(400, None, "en"), (401, "", "de"), (402, "12345 !!! ???", "en"), (None, "the of and " * 30, "en"), (403, "the word " * 30_000, "en")]
    rows += [rows[5], rows[5]]
    out = [(i, t, lang, f"s{k % 4}" if k % 5 else None, len(t or "")) for k, (i, t, lang) in enumerate(rows)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    columns, (language, exact, near, mix, pack) = docs.columns, [f for _, f in corpus_pipeline.STAGES]
    start = docs.collect()

    docs = language(spark, docs, table)
    assert docs.columns == columns
    kept = docs.collect()
    assert Counter(kept) == Counter(r for r in start if r.doc_id not in (400, 401, 402))

    docs = spark.createDataFrame(kept, docs.schema)
    after = exact(spark, docs, table).collect()
    best = {}
    for r in kept:
        if r.text not in best or (r.doc_id is not None and (best[r.text] is None or r.doc_id > best[r.text])):
            best[r.text] = r.doc_id
    assert sorted((r.text, str(r.doc_id)) for r in after) == sorted((t, str(i)) for t, i in best.items())

    docs = spark.createDataFrame(after, docs.schema)
    out = near(spark, docs, table)
    assert out.columns == columns
    rows, sets = after, [plain_set(r.text.lower()) for r in after]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(find(k), []).append(r.doc_id)
    want = sorted(str(min(g, key=lambda i: (i is None, i or 0))) for g in groups.values())
    kept = out.collect()
    assert sorted(str(r.doc_id) for r in kept) == want and len(want) < len(rows)

    docs = spark.createDataFrame(kept, docs.schema)
    mixed = mix(spark, docs, table)
    assert mixed.columns == columns
    taken = {r.doc_id: r for r in mix_documents(docs).collect()}
    copies = Counter(r.doc_id for r in mixed.collect())
    for i, r in taken.items():
        assert abs(copies[i] * r.size - r.taken) <= 1.5 * r.size

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = pack(spark, mixed, table).collect()
    tokens = Counter()
    for p in pieces:
        tokens[p.doc_id] += p.length
    texts = {r.doc_id: r.text for r in kept}
    assert tokens == Counter({i: n * (len(tokenizer.encode(texts[i], add_special_tokens=False).ids) + 1) for i, n in copies.items()})


def test_run_equals_the_stages(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, table)
    total = lambda df: Counter((r.doc_id, r.doc_tokens, r.length) for r in df.groupBy("doc_id", "doc_tokens").sum("length").withColumnRenamed("sum(length)", "length").collect())
    assert total(corpus_pipeline.run(spark, table)) == total(docs)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
