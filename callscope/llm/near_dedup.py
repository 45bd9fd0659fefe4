"""SimHash near-duplicate removal, verified by the exact Jaccard index of word shingles.

A text's wide fingerprint has WORDS words of 64 SimHash bits over its distinct
shingles. Of two texts with a Jaccard index of 0.8 some 15 % of the bits differ (the
angle between their shingle sets), so candidates agree in all of a few drawn bits
with a known probability: `tables` keys of `bits` drawn bits each leave out a pair at
that share with probability MISS. More fingerprints make longer and more keys, so
that groups of unrelated fingerprints stay small. Within a key's group, tables of
distances to reference fingerprints discard pairs and the Hamming distance verifies
the survivors (simhash.links_of_keys); a group reports a spanning forest.

Connected candidates are then searched with their texts in hand, and a pair is
linked only if its exact index is at least LIKE; linked texts leave the search. A
component of many texts is dealt to chunks (groups.py), so no task holds more than
CHUNK_TEXTS of them.

Defined results: words are parted by white space and ASCII case is ignored; a text of
fewer words than a shingle is one shingle, texts without words are alike; shingles are
compared by their XXH64 (seed 42); equal texts are alike; of a group the smallest
doc_id stays (a null one only if the group has no other), among equal ones the smallest
hash of the text; rows equal in both stay together; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm import groups, simhash
from callscope.llm.memory import give_back
from callscope.operators.components import connected_components
from callscope.runtime import beside, cut

SHINGLE_WORDS = 5
#: The index from which two texts are linked, as a fraction.
LIKE = (4, 5)
#: 64-bit words of a wide fingerprint.
WORDS = 4
#: Share of the bits in which candidates differ at most: what an index of LIKE gives (0.152), and 3 deviations.
MOST_DIFFERING = 0.22
#: Probability that no key is shared at the share of bits that an index of LIKE gives.
MISS = 0.001
#: Unrelated fingerprints in a key's group that are accepted, as a power of two, and the bits of a key at least.
CROWD, LEAST_BITS = 6, 16
#: Keys that are looked at before the others.
FIRST_KEYS = 8
#: Texts, and bytes of text, of a component that are searched in one task.
CHUNK_TEXTS, CHUNK_BYTES = 500, 8_000_000


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    found = (text or "").encode().lower().split()
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = [e + k for k, e in enumerate(accumulate(map(len, found)))]
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :])), np.uint64, len(found) - words + 1))


# ---------------------------------------------------------------- candidates


@cache
def _seeds(name: str, n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{name} {k}".encode(), 42) | 1 for k in range(n)], np.uint64)


def wide_fingerprint(own: np.ndarray) -> np.ndarray:
    """WORDS words of a set of shingles: a bit is 1 if over half of the shingles' mixed hashes have it."""
    sums = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(own), 4096):
        h = own[at : at + 4096, None] * _seeds("word", WORDS)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        sums += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(sums * 2 > len(own), bitorder="little").view(np.uint64)


def differing_share() -> float:
    """Share of the bits that differ, on average, in sets of one size with an index of LIKE."""
    j = LIKE[0] / LIKE[1]
    return math.acos(2 * j / (1 + j)) / math.pi


def key_plan(n: int) -> tuple[int, int]:
    """(keys of a fingerprint, drawn bits of each) for n fingerprints."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(n, 1))) - CROWD)
    return math.ceil(math.log(MISS) / math.log1p(-((1 - differing_share()) ** bits))), bits


def _drawn(tables: int, bits: int) -> np.ndarray:
    rng = np.random.default_rng(64 * WORDS)
    return np.stack([rng.permutation(64 * WORDS)[:bits] for _ in range(tables)])


def keyed(fps: DataFrame, tables: range, bits: int) -> DataFrame:
    """key and the columns of fps, for every key of every fingerprint."""
    columns = fps.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = _drawn(tables.stop, bits)[tables.start :]
        weights, base = np.int64(1) << np.arange(bits, dtype=np.int64), np.array(tables, np.int64) << bits
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words = np.stack([part.column(f"f{k}").to_numpy() for k in range(WORDS)], axis=1)
                set_bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
                keys = base + (set_bits[:, drawn] @ weights)
                lists = pa.ListArray.from_arrays(np.arange(len(words) + 1, dtype=np.int32) * len(tables), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([lists, *part.columns], names=["keys", *columns])

    made = fps.mapInArrow(run, "keys array<long>, " + ", ".join(f"{c} long" for c in columns))
    return made.select(F.explode("keys").alias("key"), *columns)


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, h (XXH64 of the text, seed 42) and the words f0, f1, ... of every row."""
    names = [f"f{k}" for k in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(1).to_pylist()
                found = np.stack([wide_fingerprint(shingles(t, words)) for t in texts]).view(np.int64)
                own = np.array([xxhash.xxh64_intdigest((t or "").encode(), 42) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], names=["doc_id", "h", *names])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, h long, " + ", ".join(f"{c} long" for c in names))


def candidates(sketches: DataFrame) -> DataFrame:
    """(h, part) of the texts that may be alike another one; alike texts that were found share a part.

    The first keys find the families; the others only report links between what does not hang together yet.
    """
    rest = [f"f{k}" for k in range(1, WORDS)]
    nodes = cut(sketches.groupBy("f0").agg(F.min(F.struct(*rest)).alias("rest"), (F.min("h") != F.max("h")).alias("many")))
    fps = nodes.select("f0", "rest.*")
    tables, bits = key_plan(nodes.count())
    most = int(64 * WORDS * MOST_DIFFERING)
    first = cut(connected_components(simhash.links_of_keys(fps, partial(keyed, tables=range(FIRST_KEYS), bits=bits), most)).toDF("f0", "node"))
    named = cut(fps.join(beside(first), "f0", "left").withColumn("node", F.coalesce("node", "f0")))
    others = simhash.links_of_keys(named, partial(keyed, tables=range(FIRST_KEYS, tables), bits=bits), most)
    second = cut(connected_components(others).toDF("node", "part"))
    whole = named.select("f0", "node").join(beside(second), "node", "left").join(nodes.select("f0", "many"), "f0")
    own = whole.where(F.col("part").isNotNull() | (F.col("node") != F.col("f0")) | F.col("many")).select("f0", F.coalesce("part", "node").alias("part"))
    # A node that others were joined to is its own name, so its family is looked up by the name.
    own = own.unionByName(first.where("f0 = node").select("f0").join(own, "f0", "left_anti").select("f0", F.col("f0").alias("part")))
    return sketches.select("h", "f0").distinct().join(beside(cut(own)), "f0").select("h", "part")


# ---------------------------------------------------------------- exact links


def _index(sets: list[np.ndarray], alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, where the rows of each begin, rows) of the rows `alive`."""
    flat, rows = np.concatenate([sets[k] for k in alive]), np.repeat(alive, [len(sets[k]) for k in alive])
    order = np.argsort(flat, kind="stable")
    names, starts = np.unique(flat[order], return_index=True)
    return names, np.r_[starts, len(flat)], rows[order]


def groups_of(sets: list[np.ndarray]) -> np.ndarray:
    """The group of each set, where pairs with an index of at least LIKE are linked: the place of its first member."""
    n = len(sets)
    size, root, alive = np.array([len(s) for s in sets], np.int64), np.arange(n), np.ones(n, bool)
    names, starts, rows = _index(sets, np.arange(n))
    held = left = n
    for first in range(n):
        if not alive[first]:
            continue
        alive[first], left, frontier = False, left - 1, [first]
        while frontier and left:
            if 2 * left <= held:  # what has left the search costs nothing more
                names, starts, rows = _index(sets, np.flatnonzero(alive))
                held = left
            x = frontier.pop()
            at = np.minimum(np.searchsorted(names, sets[x]), len(names) - 1)
            at = at[names[at] == sets[x]]
            lengths = starts[at + 1] - starts[at]
            places = np.repeat(starts[at] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum()) if len(at) else np.zeros(0, np.int64)
            near, common = np.unique(rows[places], return_counts=True)
            near = near[alive[near] & ((LIKE[0] + LIKE[1]) * common >= LIKE[0] * (size[near] + size[x]))]
            alive[near], root[near], left = False, first, left - len(near)
            frontier.extend(near.tolist())
    return root


def near_groups(docs: DataFrame, words: int = SHINGLE_WORDS, chunk_texts: int = CHUNK_TEXTS) -> tuple[DataFrame, DataFrame]:
    """(doc_id and h of every row; h and root of the texts that are linked to another text)."""
    sketches = cut(_sketches(docs, words))
    members = cut(candidates(sketches))
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h")
    texts = docs.select(own, "text").join(beside(members), "h").select(F.col("part").alias("g"), F.col("h").alias("item"), "text")
    sizes = members.groupBy("part").count().where(F.col("count") > 1).select(F.col("part").alias("g"))
    bytes_of = texts.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("text")).alias("b"))
    n = F.greatest(F.ceil(F.col("c") / chunk_texts), F.ceil(F.col("b") / CHUNK_BYTES)).cast("long")
    chunks = bytes_of.select("g", n.alias("n")).where("n > 1").join(sizes, "g", "left_semi")

    def read(columns: list[pa.Array]) -> list:
        return [shingles(t, words) for t in columns[0].to_pylist()]

    found = cut(groups.links(texts, chunks, read, groups_of, chunk_texts))
    return sketches.select("doc_id", "h"), cut(connected_components(found).toDF("h", "root"))


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of docs without all but one document of each near-duplicate group."""
    rows, linked = near_groups(docs, words)
    # Texts with one row and no link can't lose a row; the others are few.
    shared = rows.groupBy("h").count().where(F.col("count") > 1).select("h", F.col("h").alias("root"))
    found = cut(linked.unionByName(shared.join(linked, "h", "left_anti")))
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("h"))
    members = rows.join(beside(found), "h").select("root", "doc_id", "h", rank.alias("rank"))
    first = members.groupBy("root").agg(F.min("rank").alias("first"))
    losers = cut(members.join(first, "root").where(~F.col("rank").eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("_cs_id"), F.col("h").alias("_cs_h")).distinct())
    mine = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(beside(losers), docs["doc_id"].eqNullSafe(F.col("_cs_id")) & (mine == F.col("_cs_h")), "left_anti")
