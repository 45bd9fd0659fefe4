"""Language-model scores by a weighted backoff automaton.

Words seen in training are states. The arc from v to w, for each pair seen in
training, carries the smoothed bigram's weight; where v has no arc for a word, its
failure arc leads to the root, whose arcs are the smoothed words. A left-to-right
traversal carries the state and adds up the arcs' log-probabilities; the state after
a text's end is the state before the next text. The order is 2: trigram keys would
take more disk for the shuffle than 4 times the input.

    P1(w)    = (c(w) + 0.1) / (N + 0.1 (V + 1))
    P(w | v) = (c(v, w) + mu P1(w)) / (c(v) + mu)        failure arc: mu / (c(v) + mu)

Counts cover all training documents. Documents are cut into chunks of about
CHUNK_BYTES of text and kept as word numbers. Every chunk asks for the counts of its
distinct words and pairs: requests go in sorted blocks to the owners of hash ranges,
owners add up and answer in the order asked, and a chunk's automaton is built from
its answers. So no task and no broadcast ever holds the vocabulary, a frequent word
is one request for each chunk, and what is shuffled grows with the distinct words
and pairs of a chunk, not with its tokens.

Words and pairs are identified by 64-bit hashes.

Defined results: a null or empty text has the end token only; repeated rows are
documents of their own (training counts both); a null doc_id counts as the empty id;
an empty table gives an empty result; with no training document every word has
probability 1 at the root.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.runtime import shuffle_partitions, spill

CHUNK_BYTES = 6_000_000
#: Weight of the root in a state, in tokens (the best of 20, 100, 500 on held-out text, nearly).
MU = 100.0
#: Hash of the end token; no word holds white space.
END = xxhash.xxh64_intdigest(b"\n", 42)
#: Tokens for each hash range of an owner, about.
RANGE_TOKENS = 500_000

CHUNKS_DDL = "chunk long, kind int, range long, ids array<string>, n long, a binary, b binary, c binary"
WORD, PAIR, TEXT = 0, 1, 2


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpack(data: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def held_out(doc_id: str | None) -> bool:
    return zlib.crc32((doc_id or "").encode()) % 10 == 0


# ---------------------------------------------------------------- chunks


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Rows of kind TEXT: a: tokens of each document (u4); b: hashes of the distinct words, ascending (u8); c: every token's place there (u4)."""
    number, size = TaskContext.get().partitionId() << 24, 0
    ids: list[str | None] = []
    lengths, tokens = array("I"), array("I")
    words = _Numbers({b"\n": 0})

    def close() -> pa.RecordBatch:
        nonlocal number, size, lengths, tokens, words
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(w, 42) for w in words), np.uint64, len(words))
        order = np.argsort(hashes)
        place = np.empty(len(order), "<u4")
        place[order] = np.arange(len(order), dtype="<u4")
        row = [[number], [TEXT], [0], [ids[:]], [len(tokens)], [_pack(np.array(lengths, "<u4"))], [hashes[order].astype("<u8").tobytes()], [_pack(place[np.array(tokens, np.uint32)])]]
        number, size = number + 1, 0
        ids.clear()
        lengths, tokens, words = array("I"), array("I"), _Numbers({b"\n": 0})
        types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["chunk", "kind", "range", "ids", "n", "a", "b", "c"])

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                data = (text or "").encode().lower()
                own = data.split()
                tokens.extend(map(words.__getitem__, own))
                tokens.append(0)
                lengths.append(len(own) + 1)
                ids.append(None if doc_id is None else str(doc_id))
                size += len(data) + 16
                if size >= CHUNK_BYTES:
                    yield close()
    if ids:
        yield close()


class Chunk:
    """The word numbers of a chunk's documents and the keys of its distinct words and pairs."""

    def __init__(self, ids: list[str | None], a: bytes, b: bytes, c: bytes):
        self.ids = list(ids)
        self.lengths = _unpack(a, "<u4").astype(np.int64)
        self.words = np.frombuffer(b, "<u8")
        self.tokens = _unpack(c, "<u4").astype(np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.out = np.array([held_out(i) for i in self.ids], bool)
        self.training = np.repeat(~self.out, self.lengths)
        # The state before a token is the token before it, before a text the end token.
        self.end = int(np.searchsorted(self.words, np.uint64(END)))
        self.before = np.r_[self.end, self.tokens[:-1]]

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.training], minlength=len(self.words))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the distinct pairs, ascending, and every token's place there."""
        local = self.before * len(self.words) + self.tokens
        distinct, where = np.unique(local, return_inverse=True)
        with np.errstate(over="ignore"):
            h = self.words[distinct // len(self.words)] * np.uint64(0x9E3779B97F4A7C15) + self.words[distinct % len(self.words)]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h = h ^ (h >> np.uint64(32))
        order = np.argsort(h)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return h[order], place[where]


# ---------------------------------------------------------------- counts


def _planes(keys: np.ndarray) -> bytes:
    """The low 56 bits of ascending keys, byte by byte, leading bytes first: those of a sorted block compress."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:].T).tobytes()


def _from_planes(data: bytes, top: int, bits: int) -> np.ndarray:
    low = np.zeros((len(data) // 7, 8), np.uint8)
    low[:, 1:] = np.frombuffer(data, np.uint8).reshape(7, -1).T
    return (low.view(">u8").ravel().astype(np.uint64) & np.uint64((1 << (64 - bits)) - 1)) | np.uint64(top << (64 - bits))


def _blocks(chunk: int, kind: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> list[tuple]:
    ranges = (keys >> np.uint64(64 - bits)).astype(np.int64)
    found, starts = np.unique(ranges, return_index=True)
    ends = np.r_[starts[1:], len(keys)]
    return [(chunk, kind, r, None, 0, _planes(keys[s:e]), counts[s:e].astype("<u4").tobytes(), None) for r, s, e in zip(found.tolist(), starts, ends)]


_COLUMNS = ["chunk", "kind", "range", "ids", "n", "a", "b", "c"]


def _ask(bits: int):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                chunk = Chunk(r.ids, r.a, r.b, r.c)
                yield pd.DataFrame(_blocks(r.chunk, WORD, chunk.words, chunk.word_counts(), bits), columns=_COLUMNS)
                keys, where = chunk.pairs()
                yield pd.DataFrame(_blocks(r.chunk, PAIR, keys, np.bincount(where[chunk.training], minlength=len(keys)), bits), columns=_COLUMNS)

    return ask


def _answer(bits: int):
    """For each block its keys' counts over all blocks (a, u4), and in the first block of a range the tokens (n) and distinct words (ids[0]) there."""

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in b.itertuples(index=False))
        for (kind, top), group in groupby(rows, key=lambda r: (r.kind, r.range)):
            blocks = [(r.chunk, _from_planes(r.a, top, bits), np.frombuffer(r.b, "<u4")) for r in group]
            keys = np.concatenate([k for _, k, _ in blocks])
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
            totals = np.add.reduceat(np.concatenate([c for _, _, c in blocks])[order].astype(np.int64), first)
            back = np.empty(len(keys), "<u4")
            back[order] = np.repeat(totals, np.diff(np.r_[first, len(keys)]))
            at, out = 0, []
            for k, (chunk, own, _) in enumerate(blocks):
                lead = kind == WORD and k == 0
                out.append((chunk, kind, top, [str((totals > 0).sum())] if lead else None, int(totals.sum()) if lead else 0, _pack(back[at : at + len(own)]), None, None))
                at += len(own)
            for k in range(0, len(out), 256):
                yield pd.DataFrame(out[k : k + 256], columns=_COLUMNS)

    return answer


# ---------------------------------------------------------------- scores


#: Tokens that a lane of the traversal reads.
LANE = 256


class BackoffAutomaton:
    """State 0 is the root, state w + 1 the history of word w. Arcs are sorted by (state, word); every state but the root has a failure arc.

    words, pairs: training counts of the chunk's words and pairs. A word that was never
    seen has no state of its own: it leads to the root.
    """

    def __init__(self, words: np.ndarray, pairs: np.ndarray, pair_from: np.ndarray, pair_to: np.ndarray, total: int, distinct: int, mu: float):
        self.width = len(words)
        root = (words + 0.1) / (total + 0.1 * (distinct + 1))
        self.root_weight, self.root_to = np.log10(root), np.where(words > 0, np.arange(1, self.width + 1), 0)
        self.failure_weight, self.failure_to = np.r_[0.0, np.log10(mu / (words + mu))], np.zeros(self.width + 1, np.int64)
        seen = pairs > 0
        source, label = pair_from[seen], pair_to[seen]
        key = (source + 1) * self.width + label
        order = np.argsort(key)
        self.arc_key, self.arc_to = key[order], self.root_to[label][order]
        self.arc_weight = np.log10((pairs[seen] + mu * root[label]) / (words[source] + mu))[order]

    def step(self, state: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, weight) of each lane: along the state's arc, or along failure arcs until a state has one; the root has all."""
        state, weight, following = state.copy(), np.zeros(len(state)), np.empty(len(state), np.int64)
        lanes = np.arange(len(state))
        while len(lanes):
            own, word = state[lanes], label[lanes]
            key = own * self.width + word
            at = np.minimum(np.searchsorted(self.arc_key, key), max(len(self.arc_key) - 1, 0))
            hit = self.arc_key[at] == key if len(self.arc_key) else np.zeros(len(lanes), bool)
            weight[lanes[hit]] += self.arc_weight[at[hit]]
            following[lanes[hit]] = self.arc_to[at[hit]]
            rooted = own == 0
            weight[lanes[rooted]] += self.root_weight[word[rooted]]
            following[lanes[rooted]] = self.root_to[word[rooted]]
            failed = ~hit & ~rooted
            lanes, own = lanes[failed], own[failed]
            weight[lanes] += self.failure_weight[own]
            state[lanes] = self.failure_to[own]
        return following, weight

    def traverse(self, tokens: np.ndarray, starts: np.ndarray, first: int) -> np.ndarray:
        """The log-probability of each text of a stream; first: the word before the stream.

        The stream is read from left to right in lanes of LANE tokens, side by side. A
        state holds one word of history, so the word before a lane gives its state.
        """
        begin = np.arange(0, len(tokens), LANE)
        state = self.root_to[np.r_[first, tokens[begin[1:] - 1]]]
        weights = np.empty(len(tokens))
        for t in range(min(LANE, len(tokens))):
            at = begin + t
            at = at[at < len(tokens)]  # only the last lane can be shorter
            state, weights[at] = self.step(state[: len(at)], tokens[at])
        return np.add.reduceat(weights, starts)


SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(total: int, distinct: int, mu: float):
    def score(rows: pd.DataFrame) -> pd.DataFrame:
        text = next(rows[rows["kind"] == TEXT].itertuples(index=False))
        chunk = Chunk(text.ids, text.a, text.b, text.c)

        def counts(kind: int) -> np.ndarray:
            own = rows[rows["kind"] == kind].sort_values("range")
            return np.concatenate([_unpack(a, "<u4") for a in own["a"]]).astype(np.float64)

        words, pairs = counts(WORD), counts(PAIR)
        _, where = chunk.pairs()
        some = np.empty(len(pairs), np.int64)
        some[where] = np.arange(len(where))  # a token for each pair
        automaton = BackoffAutomaton(words, pairs, chunk.before[some], chunk.tokens[some], total, distinct, mu)
        return pd.DataFrame({
            "doc_id": pd.array([None if i is None else int(i) for i in chunk.ids], dtype="Int64"), "held_out": chunk.out, "n_tokens": chunk.lengths,
            "n_known": np.add.reduceat((words > 0)[chunk.tokens].astype(np.int64), chunk.starts), "train_tokens": total,
            "base_score": np.add.reduceat(automaton.root_weight[chunk.tokens], chunk.starts), "score": automaton.traverse(chunk.tokens, chunk.starts, chunk.end),
        })

    return score


def score_documents(docs: DataFrame, mu: float = MU) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    chunks = spill(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_chunk, CHUNKS_DDL))
    tokens = chunks.agg(F.sum("n")).first()[0] or 0
    bits = max(8, math.ceil(math.log2(max(1, tokens) / RANGE_TOKENS)))
    asked = chunks.mapInPandas(_ask(bits), CHUNKS_DDL)  # a scan's task reads a few chunks
    answers = spill(asked.repartition(parts, "kind", "range").sortWithinPartitions("kind", "range", "chunk").mapInPandas(_answer(bits), CHUNKS_DDL))
    total, distinct = answers.where(F.col("kind") == WORD).agg(F.sum("n"), F.sum(F.col("ids")[0].cast("long"))).first()
    return chunks.unionByName(answers).groupBy("chunk").applyInPandas(_score(total or 0, distinct or 0, mu), SCORES_DDL)
