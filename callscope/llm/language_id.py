"""Language identification by bit-sliced Bloom filters of n-grams.

One table of masks serves all languages: row r holds, bit by bit, which languages'
Bloom filters have bit r set. The rows of an n-gram's hashes, taken together by AND,
are the set of all languages that contain it. Per-language popcounts over a text,
corrected for each filter's false-positive rate, decide.

The filters are fitted on a bounded sample of labelled documents (`sample` for each
language, about); prediction reads every whole text and nothing but the text.

Defined results: `und` with score 0 if the text is null or has no letter, or if
nothing was learned; equal scores go to the first language by name; repeated rows
are predicted alike; a null doc_id counts as the empty id in the split; an empty
table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.memory import give_back

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """sizes: n -> n-grams kept for each language. sample: labelled documents for each language, about. rows: a power of two."""

    sizes: tuple[tuple[int, int], ...] = ((2, 200), (3, 600), (4, 2000))
    sample: int = 2000
    rows: int = 1 << 16
    hashes: int = 3


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool)


#: Characters that are looked at together; longer texts are read in pieces of so many.
BATCH_CHARS = 1 << 18


def batches_of(texts: list[str]) -> Iterator[slice]:
    """Neighbouring texts of BATCH_CHARS characters together, a longer one by itself."""
    start = held = 0
    for k, t in enumerate(texts):
        if k > start and held + len(t) > BATCH_CHARS:
            yield slice(start, k)
            start, held = k, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts in lower case, with one 0 for whatever lies between words and around a text; each code's text; each text's number of letters."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(f"\x00{t}\x00" for t in lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in lowered])
    letter = _letters()[codes]
    n_letters = np.bincount(owner[letter], minlength=len(texts))
    fresh = np.r_[True, owner[1:] != owner[:-1]]
    keep = letter | np.r_[True, letter[:-1]] | fresh
    codes = np.where(letter, codes, 0)[keep].astype(np.uint64)
    return codes, owner[keep], n_letters


def _pieces(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """The codes of one long text piece by piece, and each piece's number of letters."""
    lowered = text.lower()
    after_letter = True  # the 0 around a text stays
    for at in range(-1, len(lowered) + 1, BATCH_CHARS):
        raw = lowered[max(at, 0) : at + BATCH_CHARS]
        raw = ("\x00" if at < 0 else "") + raw + ("\x00" if at + BATCH_CHARS > len(lowered) else "")
        codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[codes]
        keep = letter | np.r_[after_letter, letter[:-1]]
        after_letter = bool(letter[-1])
        yield np.where(letter, codes, 0)[keep].astype(np.uint64), int(letter.sum())


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def ngrams(codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every n-gram that lies in one text and isn't all white space."""
    if len(codes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.full(len(codes) - n + 1, n, np.uint64)
        some = np.zeros(len(h), bool)
        for k in range(n):
            part = codes[k : len(codes) - n + 1 + k]
            h = h * np.uint64(0x100000001B3) + part
            some |= part != 0
        whole = (owner[: len(h)] == owner[n - 1 :]) & some
        return _mixed(h[whole]), owner[: len(whole)][whole]


class LanguageFilters:
    """Bit-sliced Bloom filters of all languages."""

    def __init__(self, languages: list[str], settings: Settings):
        self.languages, self.settings = languages, settings
        self.bytes = max(1, -(-len(languages) // 8))
        self.table = np.zeros((settings.rows, self.bytes), np.uint8)

    def _rows(self, h: np.ndarray) -> Iterator[np.ndarray]:
        bits = np.uint64(self.settings.rows.bit_length() - 1)
        for k in range(self.settings.hashes):
            yield ((h >> (bits * np.uint64(k))) & np.uint64(self.settings.rows - 1)).astype(np.int64)

    def add(self, language: int, h: np.ndarray) -> None:
        for rows in self._rows(h):
            self.table[rows, language // 8] |= np.uint8(1 << (language % 8))

    def finish(self) -> LanguageFilters:
        fill = np.unpackbits(self.table, axis=1, bitorder="little").mean(axis=0)[: len(self.languages)]
        self.false_rate = fill**self.settings.hashes
        return self

    def containing(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the mask of the languages that contain it."""
        masks = None
        for rows in self._rows(h):
            masks = self.table[rows] if masks is None else masks & self.table[rows]
        return masks

    def _add(self, codes: np.ndarray, owner: np.ndarray, n: int, hits: np.ndarray, total: np.ndarray) -> None:
        h, own = ngrams(codes, owner, n)
        if len(h) and self.languages:
            bits = np.unpackbits(self.containing(h), axis=1, bitorder="little")[:, : len(self.languages)]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            hits[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            total += np.bincount(own, minlength=len(total))

    def _count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: n-grams that each language contains, n-grams, letters."""
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        if len(texts) > 1 or len(texts[0]) <= BATCH_CHARS:
            codes, owner, letters = _codes(texts)
            for n, _ in self.settings.sizes:
                self._add(codes, owner, n, hits, total)
            return hits, total, letters
        letters, before = 0, np.zeros(0, np.uint64)
        longest = max(n for n, _ in self.settings.sizes)
        for codes, own_letters in _pieces(texts[0]):
            letters += own_letters
            for n, _ in self.settings.sizes:
                whole = np.r_[before[len(before) - min(n - 1, len(before)) :], codes]
                self._add(whole, np.zeros(len(whole), np.int64), n, hits, total)
            before = np.r_[before, codes][-(longest - 1) :]
        return hits, total, np.array([letters])

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        out = []
        for part in batches_of(texts):
            hits, total, letters = self._count(texts[part])
            share = hits / np.maximum(total, 1)[:, None]
            share = np.clip((share - self.false_rate) / (1 - self.false_rate), 0, 1) if self.languages else share
            for k in range(len(total)):
                if not letters[k] or not total[k] or not self.languages:
                    out.append((UNKNOWN, 0.0))
                else:
                    best = int(share[k].argmax())
                    out.append((self.languages[best], float(share[k, best])))
        return out


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def fit(docs: DataFrame, settings: Settings = Settings()) -> LanguageFilters:
    """Filters from the labelled documents of the training part (crc32 of doc_id not 0 modulo 5)."""
    train = docs.select("doc_id", "text", "lang").where((remainder(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}  # one row per language
    languages = sorted(counts)
    filters = LanguageFilters(languages, settings)
    if not languages:
        return filters.finish()
    # A document is in the sample if its hash lies in its language's share.
    share = F.create_map(*(x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, settings.sample / counts[lang])))))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = train.where(draw < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                texts = part["text"].tolist()
                for few in batches_of(texts):
                    codes, owner, _ = _codes(texts[few])
                    for n, _ in settings.sizes:
                        h, c = np.unique(ngrams(codes, owner, n)[0], return_counts=True)
                        yield pd.DataFrame({"lang": lang, "n": n, "h": h.view(np.int64), "c": c})

    grams = sample.mapInPandas(count, "lang string, n int, h long, c long").groupBy("lang", "n", "h").agg(F.sum("c").alias("c"))
    keep = F.create_map(*(F.lit(x) for pair in settings.sizes for x in pair))
    place = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.col("c").desc(), "h"))
    kept = grams.withColumn("place", place).where(F.col("place") <= keep[F.col("n")]).select("lang", "h").toPandas()  # languages times the sizes, at most
    for lang, part in kept.groupby("lang"):
        filters.add(languages.index(lang), part["h"].to_numpy(np.int64).view(np.uint64))
    return filters.finish()


def predict(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """docs with lang_pred and score (columns of these names are replaced)."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("lang string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(sent.value.predict(texts.fillna("").tolist()), columns=["lang", "score"])

    docs = docs.drop("lang_pred", "score").withColumn("_cs_found", of("text"))
    return docs.withColumns({"lang_pred": F.col("_cs_found.lang"), "score": F.col("_cs_found.score")}).drop("_cs_found")


def predict_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = sent.value.predict([t or "" for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x for x, _ in found]), pa.array([x for _, x in found])], names=["doc_id", "held_out", "lang_pred", "score"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def reject_unknown(docs: DataFrame, min_score: float = 0.15, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs whose language is known: not `und`, and at least min_score of the n-grams explained."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, settings))
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = sent.value.predict([t or "" for t in part.column(at_text).to_pylist()])
                yield part.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in found]))
        give_back()

    return docs.mapInArrow(run, docs.schema)
