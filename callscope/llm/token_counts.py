"""Token counts by rank-synchronous array merging.

The pre-tokens new to a task are held together as one ragged numpy array of symbols.
Each round looks up the rank of every adjacent pair, applies each sequence's
lowest-rank pair at all its places simultaneously and drops the sequences that have
no pair left; what survives is counted. A long pre-token is merged by itself, its
places held by rank, so that a round only touches what it merges. Rules, merges and special strings come from
the tokenizer's own file.

Defined results: a null text is empty and has no token; repeated rows are counted
alike; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings between single spaces that a worker remembers before it starts again.
CACHE_UNITS = 300_000
NO_RANK = np.iinfo(np.int64).max
#: Bytes of a pre-token beyond which it is merged by itself.
LONG = 512


class RankMerger:
    """Counts of the symbols that survive merging, for many pre-tokens at once."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        size = max(vocab.values()) + 1
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        named = {b: chr(b) for b in plain}
        named |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in named)}
        self.inner = np.array([vocab[named[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[named[b] + suffix] for b in range(256)], np.int64)
        self.size = size
        keys = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.order[at], NO_RANK)

    def count_long(self, token: bytes) -> int:
        """One long pre-token. Places wait in a heap by their pair's rank; each round merges all places of the lowest one and looks up only the pairs beside them."""
        n = len(token)
        symbols = self.inner[np.frombuffer(token, np.uint8)]
        symbols[-1] = self.final[token[-1]]
        before, after = np.arange(-1, n - 1, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
        rank = np.full(n, NO_RANK, np.int64)
        left, waiting, heap = n, {}, []

        def wait(at: np.ndarray) -> None:
            """Look up the pairs that begin at these places."""
            at = at[after[at] < n]
            found = rank[at] = self._ranks(symbols[at], symbols[after[at]])
            at, found = at[found != NO_RANK], found[found != NO_RANK]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else found
            for r, part in zip(found[starts].tolist(), np.split(at, starts[1:])):
                if r not in waiting:
                    heapq.heappush(heap, r)
                    waiting[r] = []
                waiting[r].append(part)

        wait(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # A pair of equal symbols can overlap itself: keep every second place of a run.
            fresh = np.r_[True, after[at[:-1]] != at[1:]]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = after[at]
            symbols[at], rank[gone], after[at] = self.made[r], NO_RANK, after[gone]
            rank[at] = NO_RANK
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            left -= len(at)
            beside = before[at]
            wait(np.unique(np.r_[at, beside[beside >= 0]]))
        return left

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """tokens: none empty."""
        long = [k for k, t in enumerate(tokens) if len(t) > LONG]
        if long:
            out = np.array([0 if len(t) > LONG else 1 for t in tokens], np.int64)
            short = np.flatnonzero(out)
            if len(short):
                out[short] = self.counts([tokens[k] for k in short])
            out[long] = [self.count_long(tokens[k]) for k in long]
            return out
        lengths = np.array([len(t) for t in tokens], np.int64)
        symbols = self.inner[np.frombuffer(b"".join(tokens), np.uint8)]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.final[np.frombuffer(b"".join(t[-1:] for t in tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), lengths)
        out = lengths.copy()
        while len(symbols) > 1:
            rank = self._ranks(symbols[:-1], symbols[1:])
            rank[owner[:-1] != owner[1:]] = NO_RANK
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(np.r_[rank, NO_RANK], starts)
            of = np.repeat(least, np.diff(np.r_[starts, len(symbols)]))
            hit = np.r_[(rank == of[:-1]) & (rank != NO_RANK), False]
            # A pair of equal symbols can overlap itself: keep every second place of a run of hits.
            run = np.flatnonzero(hit)
            if len(run):
                fresh = np.r_[True, np.diff(run) > 1]
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))
                run = run[(np.arange(len(run)) - first) % 2 == 0]
            symbols[run] = self.made[rank[run]]
            keep = np.ones(len(symbols), bool)
            keep[run + 1] = False
            out -= np.bincount(owner[run], minlength=len(out))
            # Sequences without a pair are done.
            keep &= of != NO_RANK
            symbols, owner = symbols[keep], owner[keep]
        return out


class TokenCounter:
    """Token counts of whole texts, as the library gives them for the file at `path`."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merger = RankMerger(model["vocab"], merges, model["end_of_word_suffix"] or "")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))))
        self.units: dict[str, int] = {"": 0}
        self.tokens: dict[str, int] = {}

    @staticmethod
    def _normal(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # lowered letter by letter

    def _learn(self, units: list[str]) -> None:
        special, split = {}, {}
        for u in units:
            if "<" in u:
                special[u] = len(self.special.findall(u))
                split[u] = [t for part in self.special.split(u) for t in self.pattern.findall(self._normal(part))]
            else:
                split[u] = self.pattern.findall(self._normal(u))
        new = list({t for ts in split.values() for t in ts if t not in self.tokens})
        if new:
            self.tokens.update(zip(new, self.merger.counts([t.encode() for t in new]).tolist()))
        for u, ts in split.items():
            self.units[u] = special.get(u, 0) + sum(self.tokens[t] for t in ts)

    def count(self, texts: list[str]) -> list[int]:
        """No pre-token holds white space, so what stands between two spaces is counted for itself."""
        if len(self.units) + len(self.tokens) > CACHE_UNITS:
            self.units, self.tokens = {"": 0}, {}
        parts = [t.split(" ") for t in texts]
        units = self.units
        new = list({u for p in parts for u in p if u not in units})
        if new:
            self._learn(new)
        return [sum(map(units.__getitem__, p)) for p in parts]


@lru_cache(maxsize=2)
def token_counter(path: str) -> TokenCounter:
    return TokenCounter(path)


COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = counter.count(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=COUNTS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
