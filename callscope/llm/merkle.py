"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces.

A paragraph is a line. It is cut into pieces behind sentence ends, and a piece
without one where its content says so, so that an edit only moves the pieces it
touches. A section is a run of paragraphs that ends behind a paragraph whose own
hash says so. Every node's hash covers its children's; equal roots mean equal texts,
and a comparison walks down only where branches differ.

The fingerprint string is `root:sections`, sections joined by `;`, their paragraphs
by `,`, their pieces by `.`. Root has 32 hex digits, a piece 8. The root is a hash of
its sections' hashes alone, these of their paragraphs', these of their pieces' and of
the line ends that follow, 128 bits each, so equal roots mean equal texts. `parse`
gives the tree of a string back, and likeness follows from two strings.

Defined results: a null text is empty; an empty text has a root and no piece;
repeated rows follow each other in the order of their texts; rows without a doc_id
come last; the document after the last is the first, so a single row is its own next
document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.runtime import shuffle_partitions

#: A paragraph hash divisible by this ends its section.
SECTION_EVERY = 4
#: Words of a piece without a sentence end, about.
WORDS_EVERY = 16
_SENTENCE = re.compile(r"(?<=[.!?]) ")


@dataclass(frozen=True)
class Tree:
    """root: hash of all. sections: (hash, [(hash, [piece hashes])])."""

    root: str
    sections: list[tuple[int, list[tuple[int, list[int]]]]]

    def __str__(self) -> str:
        return f"{self.root}:" + ";".join(",".join(".".join(f"{x:08x}" for x in pieces) for _, pieces in paragraphs) for _, paragraphs in self.sections)

    def size(self) -> int:
        return sum(len(pieces) for _, paragraphs in self.sections for _, pieces in paragraphs)


def _node(children: list[int]) -> int:
    return xxhash.xxh64_intdigest(b"".join(c.to_bytes(8, "little") for c in children), 1)


def _pieces(line: str) -> list[str]:
    """A line cut behind sentence ends, long rests behind words whose hash says so."""
    out = []
    for sentence in _SENTENCE.split(line):
        if len(sentence) < 8 * WORDS_EVERY:
            out.append(sentence)
            continue
        own: list[str] = []
        for word in sentence.split(" "):
            own.append(word)
            if xxhash.xxh32_intdigest(word.encode(), 7) % WORDS_EVERY == 0:
                out.append(" ".join(own))
                own = []
        if own:
            out.append(" ".join(own))
    return out


def _covers(kind: bytes, children: list[bytes], gap: int = 0) -> bytes:
    """128 bits over a node's children; gap: the line ends that follow it."""
    return xxhash.xxh3_128_digest(kind + gap.to_bytes(8, "little") + b"".join(children))


def tree(text: str | None) -> Tree:
    lines = (text or "").split("\n")
    sections, paragraphs = [], []
    tops, inner = [], []  # what the root covers: sections, and paragraphs of the open one, with the line ends between
    digest = xxhash.xxh32_intdigest
    first = next((k for k, line in enumerate(lines) if line), len(lines) - 1)
    for k, line in enumerate(lines):
        if not line:
            continue
        gap = k + 1
        while gap < len(lines) and not lines[gap]:
            gap += 1
        parts = [p.encode() for p in _pieces(line)]
        pieces = [digest(p, 3) for p in parts]
        paragraphs.append((_node(pieces), pieces))
        inner.append(_covers(b"p", [xxhash.xxh3_128_digest(p) for p in parts], gap - k - (gap == len(lines))))
        if paragraphs[-1][0] % SECTION_EVERY == 0:
            sections.append((_node([h for h, _ in paragraphs]), paragraphs))
            tops.append(_covers(b"s", inner))
            paragraphs, inner = [], []
    if paragraphs:
        sections.append((_node([h for h, _ in paragraphs]), paragraphs))
        tops.append(_covers(b"s", inner))
    return Tree(hashlib.blake2b(first.to_bytes(8, "little") + b"".join(tops), digest_size=16).hexdigest(), sections)


def parse(fingerprint: str) -> Tree:
    """The tree that a fingerprint string was made of."""
    root, rest = fingerprint.split(":")
    sections = []
    for section in rest.split(";") if rest else []:
        pieces = [[int(x, 16) for x in paragraph.split(".")] for paragraph in section.split(",")]
        paragraphs = [(_node(own), own) for own in pieces]
        sections.append((_node([h for h, _ in paragraphs]), paragraphs))
    return Tree(root, sections)


def _common(a: list[tuple], b: list[tuple]) -> tuple[Counter, list, list]:
    """Hashes that both levels hold, and the nodes of each beyond them."""
    both = Counter(h for h, _ in a) & Counter(h for h, _ in b)
    rest = []
    for side in (a, b):
        left, own = Counter(both), []
        for node in side:
            if left[node[0]] > 0:
                left[node[0]] -= 1
            else:
                own.append(node)
        rest.append(own)
    return both, *rest


def differing(a: Tree, b: Tree) -> tuple[list[int], list[int]]:
    """Pieces of a and of b below branches that the other doesn't hold: where the edits are."""
    if a.root == b.root:
        return [], []
    _, sa, sb = _common(a.sections, b.sections)
    _, pa_, pb = _common([p for _, ps in sa for p in ps], [p for _, ps in sb for p in ps])
    ca, cb = Counter(x for _, xs in pa_ for x in xs), Counter(x for _, xs in pb for x in xs)
    return list((ca - cb).elements()), list((cb - ca).elements())


def likeness(a: Tree, b: Tree) -> float:
    """Share of pieces under branches that both hold, of all pieces of both; 1 for equal roots."""
    if a.root == b.root:
        return 1.0
    total = a.size() + b.size()
    if not total:
        return 0.0
    x, y = differing(a, b)
    return (total - len(x) - len(y)) / total


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by as many of the beginning of `following`, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
OUT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_bucket, doc_id, text, _own), sorted; rows not _own only serve as the next document of the row before."""
    rows: list[tuple] = []

    def pair(a: tuple, b: tuple) -> None:
        (_, doc_id, text, tree_a), (_, _, following, tree_b) = a, b
        changed = edited(text, following)
        tree_c = tree(changed)
        rows.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), str(tree_a), str(tree_c), likeness(tree_a, tree_c), likeness(tree_a, tree_b)))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[] for _ in OUT]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, OUT.types)], schema=OUT)

    before = None
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for bucket, doc_id, text, own in zip(*(c.to_pylist() for c in part.columns)):
                now = (bucket, doc_id, text, tree(text))
                if before is not None and before[0] == bucket:
                    pair(before, now)
                before = now if own else None
            yield flush()


def fingerprint_and_compare(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likenesses (columns of OUT_DDL).

    Rows are dealt by doc_id ranges; each range also gets the first row of the next
    range that has rows, the last one that of the first. So the text is shuffled once
    and no task sees more than a range.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ranges = 2 * shuffle_partitions(spark)
    steps = [k / ranges for k in range(1, ranges)]
    found = base.agg(F.percentile_approx("doc_id", steps, 10 * ranges)).first()[0]
    bounds = sorted(set(found or []))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        """How many bounds lie below a doc_id; rows without one are in the last range."""
        at = np.searchsorted(np.array(bounds, np.int64), ids.fillna(0).to_numpy(np.int64), side="left")
        return pd.Series(np.where(ids.isna(), len(bounds), at), dtype="int32")

    base = base.withColumn("_bucket", range_of("doc_id") if bounds else F.lit(0))
    # One row for each range: its first document. Among repeated doc_ids the least text leads, as in the sort below.
    heads = {r["_bucket"]: r["head"] for r in base.groupBy("_bucket").agg(F.min(F.struct(F.col("doc_id").isNull().alias("gone"), "doc_id", F.sha2("text", 256).alias("sha"))).alias("head")).collect()}
    filled = sorted(heads)
    spark_rows = [(filled[k - 1], heads[b]["doc_id"], heads[b]["sha"]) for k, b in enumerate(filled)]
    # The first range's head serves the last range; a single range serves itself.
    sha = F.sha2("text", 256)
    extra = spark.createDataFrame(spark_rows, "_serves int, _head long, _sha string") if spark_rows else spark.createDataFrame([], "_serves int, _head long, _sha string")
    first = base.where(F.col("doc_id").isin([h["doc_id"] for h in heads.values() if h["doc_id"] is not None]) | F.col("doc_id").isNull())
    served = (
        first.join(F.broadcast(extra), F.col("doc_id").eqNullSafe(F.col("_head")) & (sha == F.col("_sha")))
        .dropDuplicates(["_serves"])
        .select(F.col("_serves").alias("_bucket"), "doc_id", "text", F.lit(False).alias("_own"))
    )
    dealt = base.select("_bucket", "doc_id", "text", F.lit(True).alias("_own")).unionByName(served)
    dealt = dealt.repartition(shuffle_partitions(spark), "_bucket")
    dealt = dealt.sortWithinPartitions("_bucket", F.col("_own").desc(), F.col("doc_id").asc_nulls_last(), F.sha2("text", 256))
    return dealt.select("_bucket", "doc_id", "text", "_own").mapInArrow(_compare, OUT_DDL)
