"""Vector bin packing of token sequences for instruction data.

A sequence has three limits at once: tokens, segments (pieces) and loss-bearing
tokens. The next piece is the one whose demand vector, in shares of the limits, has
the largest dot product with what the open sequence has left (dot-product
heuristic). Every task packs the rows it reads, so packing needs no shuffle and a
lost task repeats alone.

Documents may be cut freely: slices of a whole sequence leave directly, remainders
are packed, the last gap of a sequence is filled with a cut of the largest pending
remainder, and what cannot be filled is cut into sequences whose lengths are powers
of two, which need no padding.

Defined results: a null or empty text has the closing id only; repeated rows are
packed as documents of their own; a null doc_id stays null; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.memory import give_back


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. By default documents are limited by tokens; segments bind for very short ones."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


class OpenSequence:
    """What the open sequence has left, as shares of the limits."""

    def __init__(self, limits: Limits):
        self.capacity = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.left = self.capacity.copy()

    def choose(self, demands: np.ndarray) -> int:
        """Index of the demand that fits and has the largest dot product with what is left, or -1."""
        fits = (demands <= self.left).all(axis=1)
        if not fits.any():
            return -1
        score = (demands / self.capacity) @ (self.left / self.capacity)
        score[~fits] = -1.0
        return int(score.argmax())

    def take(self, demand: np.ndarray) -> None:
        self.left = self.left - demand


# ---------------------------------------------------------------- token ids

#: The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units held per worker before the cache starts again.
CACHE_UNITS = 500_000
#: White space as the pattern's \s has it (Python's has four control characters more).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_PLAIN = re.compile("[\n -~\xc0-\u024f]*")


class UnitEncoder:
    """Ids of a text as little-endian 32-bit bytes, unit by unit.

    A unit is a run of white space with the run of other characters after it; no
    pre-token crosses a unit's end, so ids of units join to the ids of the text.
    Units of plain letters, new to the cache, are encoded together; others, and any
    that hold a special string, go to the library's own tokenizer.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        back = {c: b for b, c in _byte_characters().items()}
        ranks = {bytes(back[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.cache: dict[str, bytes] = {}  # units after one space
        self.runs: dict[str, bytes] = {}  # units with all that they begin with

    def _learn(self, units: list[str]) -> None:
        """units: without the one space that precedes each."""
        if not self._plain(" ".join(units)):
            rest = [u for u in units if not u or not self._plain(u)]
            for u, e in zip(rest, self.tokenizer.encode_batch([" " + u for u in rest], add_special_tokens=False)):
                self.cache[u] = np.array(e.ids, "<u4").tobytes()
            units = [u for u in units if u not in self.cache]
        if units:
            text = " " + " ".join(units)
            ids = np.array(self.fast.encode_ordinary(text), "<u4")
            # Every unit begins with the only space it holds; ids end where units do.
            ends = np.r_[np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 32)[1:], len(text.encode())]
            cuts = (4 * (np.searchsorted(np.cumsum(self.lengths[ids]), ends, side="left") + 1)).tolist()
            raw = ids.tobytes()
            self.cache.update(zip(units, [raw[x:y] for x, y in zip([0, *cuts], cuts)]))

    def _plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) + len(self.runs) > CACHE_UNITS:
            self.cache.clear()
            self.runs.clear()
        heads, parts = [], []
        for text in texts:
            # Spaces in a row, or one at an end, meet other white space across a cut at single spaces.
            if "  " in text or text[:1].isspace() or text[-1:].isspace():
                heads.append(None)
                parts.append(_UNIT.findall(text))
            else:
                head, *tail = text.split(" ")
                heads.append(head)
                parts.append(tail)
        cache = self.cache
        new = list({u for h, p in zip(heads, parts) if h is not None for u in p if u not in cache})
        if new:
            self._learn(new)
        return [b"".join(map(self._run, p)) if h is None else self._run(h) + b"".join(map(cache.__getitem__, p)) for h, p in zip(heads, parts)]

    def _run(self, unit: str) -> bytes:
        """A unit together with whatever white space it begins with."""
        if unit not in self.runs:
            self.runs[unit] = np.array(self.tokenizer.encode(unit, add_special_tokens=False).ids, "<u4").tobytes()
        return self.runs[unit]


def _byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def unit_encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path)


# ---------------------------------------------------------------- documents

#: A remainder waiting for a place: document row, its first id there, ids.
Pending = tuple[int, int, bytes]
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class DocumentPacker:
    """Packs the documents of one task. pool: remainders that wait at most."""

    def __init__(self, limits: Limits, partition: int, pool: int = 512):
        self.limits, self.pool = limits, pool
        self.next_id = partition << 33
        self.demands = np.zeros((pool + 1, 3))
        self.pending: list[tuple] = []
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        """pieces: (doc_id, doc_tokens, start, ids). Whole or power-of-two sequences leave as they are, others are cut into such."""
        total = sum(len(p[3]) for p in pieces) // 4
        size = total if total == self.limits.tokens else 1 << (total.bit_length() - 1) if total else 0
        offset, queue = 0, pieces[::-1]
        while queue:
            doc_id, doc_tokens, start, ids = queue.pop()
            room = size - offset
            n = len(ids) // 4
            if n > room:
                queue.append((doc_id, doc_tokens, start + room, ids[4 * room :]))
                ids, n = ids[: 4 * room], room
            self.rows.append((doc_id, start, n, zlib.crc32(ids), doc_tokens, self.next_id, offset))
            offset += n
            if offset == size:
                total -= size
                self.next_id += 1
                offset, size = 0, 1 << (total.bit_length() - 1) if total else 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, whole = len(ids) // 4, min(self.limits.tokens, self.limits.loss)
        start = 0
        while n - start >= whole:
            self._emit([(doc_id, n, start, ids[4 * start : 4 * (start + whole)])])
            start += whole
        if start < n:
            k = len(self.pending)
            self.demands[k] = (n - start, 1, n - start)
            self.pending.append((doc_id, n, start, ids[4 * start :]))
            if len(self.pending) >= self.pool:
                self.close_one()

    def _pop(self, k: int) -> tuple:
        last = len(self.pending) - 1
        item = self.pending[k]
        self.pending[k], self.demands[k] = self.pending[last], self.demands[last]
        self.pending.pop()
        return item

    def close_one(self) -> None:
        """Fill one sequence from the pending remainders."""
        sequence, pieces = OpenSequence(self.limits), []
        while self.pending:
            demands = self.demands[: len(self.pending)]
            k = sequence.choose(demands)
            if k < 0:
                break
            sequence.take(demands[k])
            pieces.append(self._pop(k))
        gap = int(min(sequence.left[0], sequence.left[2]))
        if self.pending and gap and sequence.left[1] >= 1:
            k = int(self.demands[: len(self.pending), 0].argmax())
            doc_id, n, start, ids = self.pending[k]
            pieces.append((doc_id, n, start, ids[: 4 * gap]))
            self.pending[k] = (doc_id, n, start + gap, ids[4 * gap :])
            self.demands[k] -= (gap, 0, gap)
        self._emit(pieces)

    def finish(self) -> None:
        while self.pending:
            self.close_one()

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[] for _ in PIECES]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PIECES.types)], schema=PIECES)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, limits: Limits = Limits()) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_encoder(tokenizer_path)
        packer = DocumentPacker(limits, TaskContext.get().partitionId())
        closing = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                    packer.add(doc_id, ids + closing)
                if len(packer.rows) > 4096:
                    yield packer.flush()
        packer.finish()
        yield packer.flush()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(pack, PIECES_DDL)


# ---------------------------------------------------------------- instruction examples

#: Limits that all bind for conversations: few examples a sequence, half of the tokens bearing loss.
INSTRUCTION_LIMITS = Limits(tokens=2048, segments=16, loss=1024)


def conversation_examples(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """example_id, tokens and loss_tokens of each conversation (conv_id, role, text): each turn's ids and one closing id; the assistant's bear loss. Turns without a conv_id are one example."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = [len(ids) // 4 + 1 for ids in encoder.encode([t or "" for t in part.column(2).to_pylist()])]
                loss = [x if role == "assistant" else 0 for x, role in zip(n, part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(loss, pa.int64())], names=["example_id", "tokens", "loss_tokens"])
        give_back()

    rows = turns.select(F.col("conv_id").cast("long").alias("example_id"), "role", "text").mapInArrow(count, "example_id long, tokens long, loss_tokens long")
    return rows.groupBy("example_id").agg(F.sum("tokens").alias("tokens"), F.sum("loss_tokens").alias("loss_tokens"))

EXAMPLES_DDL = "example_id long, tokens long, loss_tokens long, sequence_id long, offset long"


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Place whole examples (example_id, tokens, loss_tokens) without cutting them.

    An example that exceeds a limit by itself gets a sequence of its own and is
    never cut or dropped; nulls count as zero.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id, pending = TaskContext.get().partitionId() << 33, []
        rows: list[tuple] = []

        def close(floor: int) -> None:
            nonlocal next_id
            while len(pending) > floor:
                sequence, offset = OpenSequence(limits), 0
                demands = np.array([(t, 1, loss) for _, t, loss in pending], float)
                alive = np.ones(len(pending), bool)
                while alive.any():
                    where = np.flatnonzero(alive)
                    k = sequence.choose(demands[where])
                    if k < 0 and offset == 0:
                        k = 0  # too large for any sequence
                    elif k < 0:
                        break
                    at = where[k]
                    example_id, tokens, loss = pending[at]
                    rows.append((example_id, tokens, loss, next_id, offset))
                    offset += tokens
                    sequence.take(demands[at])
                    alive[at] = False
                pending[:] = [p for p, a in zip(pending, alive) if a]
                next_id += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * 5
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["example_id", "tokens", "loss_tokens", "sequence_id", "offset"])
            rows.clear()
            return out

        for batch in batches:
            for example in zip(*(c.to_pylist() for c in batch.columns)):
                pending.append(example)
                if len(pending) >= 512:
                    close(256)
            yield flush()
        close(0)
        yield flush()

    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    return examples.select(F.col("example_id").cast("long").alias("example_id"), zero("tokens"), zero("loss_tokens")).mapInArrow(pack, EXAMPLES_DDL)
