"""SimHash near-duplicates, linked through pivot distance tables.

A fingerprint has a bit where over half of a text's shingle hashes have it. Equal
fingerprints are one node. Candidate groups come from pigeonhole keys: of
`max_distance + AGREE` blocks of a fingerprint at least `AGREE` are the same in two
fingerprints that differ in `max_distance` bits, so every linked pair agrees in some
choice of that many blocks. Inside a group each fingerprint has a row in a table of
distances to reference fingerprints (pivots); by the triangle inequality a pair
whose rows differ by more than `max_distance` anywhere can't link, and only
survivors are verified bit by bit. A group only reports a spanning forest of its
links, never all its pairs: a fingerprint that has found its component leaves the
search. Keys get longer with the number of fingerprints, so that groups of unrelated
ones stay small; a group that is large all the same is dealt to chunks (see groups.py).

Defined results: a null or empty text, or one without words, has fingerprint zero
and is linked like any other; repeated rows share a fingerprint; a null doc_id is
never a component's id unless the component has no other; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm import groups
from callscope.llm.memory import give_back
from callscope.operators.components import connected_components
from callscope.runtime import beside, cut, shuffle_partitions

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
#: Blocks that two linked fingerprints agree in at least, of max_distance + AGREE; more where there are more fingerprints.
AGREE = 2
#: Fingerprints of a key's group, were they dealt evenly, beyond which keys get longer.
GROUP_ROWS = 64
#: Fingerprints of a group beyond which it is dealt to chunks, and one in how many is drawn to find such groups.
LARGE_GROUP, SAMPLE = 20_000, 16
PIVOTS = 24
#: Up to this size all pairs of a group go through the pivot table side by side; larger groups are searched.
SMALL_GROUP = 48
BITS = np.uint64(64)


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e + k for k, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle_words:
        hashes = [digest(joined, 42)]
    else:
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle_words - 1 :])]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and h (XXH64 of the text, seed 42) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                found = np.array([fingerprint(t, shingle_words) for t in texts], np.uint64).view(np.int64)
                own = np.array([xxhash.xxh64_intdigest((t or "").encode(), 42) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found), pa.array(own)], names=["doc_id", "fp", "h"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, fp long, h long")


# ---------------------------------------------------------------- links


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same everywhere."""
    return np.array([[xxhash.xxh64_intdigest(b"pivot %d" % k, 42)] for k in range(n)], np.uint64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, whose words are the last axis."""
    x = np.bitwise_count(a ^ b)
    return x[..., 0] if x.shape[-1] == 1 else x.sum(axis=-1, dtype=np.int16)


def distances(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The table of distances to the references: a row for each fingerprint."""
    return np.stack([differing(fps, r[None, :]) for r in references], axis=1).astype(np.int16)


def block_masks(blocks: int = MAX_DISTANCE + AGREE, max_distance: int = MAX_DISTANCE) -> list[int]:
    """A mask for each choice of blocks that two linked fingerprints can agree in."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    single = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(single, blocks - max_distance)]


def agreeing_blocks(n: int, max_distance: int = MAX_DISTANCE) -> int:
    """How many blocks must agree so that a key's group has GROUP_ROWS of n fingerprints at most, were they dealt evenly."""
    agree = AGREE
    while agree < 8 and n / 2 ** (64 * agree // (max_distance + agree)) > GROUP_ROWS:
        agree += 1
    return agree


def _small_groups(fps: np.ndarray, table: np.ndarray, group: np.ndarray, max_distance: int) -> list[np.ndarray]:
    """Links (two places) within groups of at most SMALL_GROUP neighbouring rows: row k against row k + d, for each d."""
    found = []
    for d in range(1, SMALL_GROUP):
        if d >= len(fps):
            break
        i = np.flatnonzero(group[:-d] == group[d:])
        if not len(i):
            break
        for p in range(0, table.shape[1], 8):  # the maximum coordinate difference, a few pivots at a time
            i = i[(np.abs(table[i, p : p + 8] - table[i + d, p : p + 8]) <= max_distance).all(axis=1)]
        i = i[differing(fps[i], fps[i + d]) <= max_distance]
        if len(i):
            found.append(np.stack([i, i + d], axis=1))
    return found


def tree_roots(fps: np.ndarray, table: np.ndarray, max_distance: int) -> np.ndarray:
    """The place of each row's root in a spanning forest of a group's links. A row's partners lie in a window of the first pivot's distance, and a row that has been found leaves the search."""
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    first = table[:, 0].astype(np.int64)
    alive, root = np.ones(len(fps), bool), np.arange(len(fps))
    starts = np.searchsorted(first, np.arange(-max_distance, first[-1] + 2 * max_distance + 2))
    held = np.arange(len(fps))  # places that were alive when last looked at, in order
    left = len(fps)
    for top in range(len(fps)):
        if not alive[top]:
            continue
        alive[top], left, frontier = False, left - 1, [top]
        while frontier and left:
            if 2 * left <= len(held):  # what has left the search costs nothing more
                held = held[alive[held]]
                starts = np.searchsorted(first[held], np.arange(-max_distance, first[-1] + 2 * max_distance + 2))
            x = frontier.pop()
            near = held[starts[first[x]] : starts[first[x] + 2 * max_distance + 1]]
            near = near[alive[near]]
            for p in range(1, table.shape[1], 8):
                if not len(near):
                    break
                near = near[(np.abs(table[near, p : p + 8] - table[x, p : p + 8]) <= max_distance).all(axis=1)]
            near = near[differing(fps[near], fps[x]) <= max_distance]
            if len(near):
                alive[near], root[near], left = False, top, left - len(near)
                frontier.extend(near.tolist())
    out = np.empty(len(fps), np.int64)
    out[order] = order[root]
    return out


def references_of(fps: np.ndarray, max_distance: int) -> np.ndarray:
    """Pivots for a table. Distances to fixed ones vary by some 4 bits; where links reach further than that, members of the groups part them better."""
    if fps.shape[1] == 1 and max_distance <= 8:
        return pivots()
    return fps[np.linspace(0, len(fps) - 1, min(8, len(fps))).astype(np.int64)]


def _link_groups(max_distance: int, named: bool):
    """named: a column `node` says what a fingerprint already hangs together with; else its first word names it."""
    def links(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
        """Pairs of places; rows are sorted by key."""
        group = np.cumsum(np.r_[0, keys[1:] != keys[:-1]])
        size = np.bincount(group)
        found = []
        chosen = np.flatnonzero(np.isin(group, np.flatnonzero((size > 1) & (size <= SMALL_GROUP))))
        if len(chosen):
            table = distances(fps[chosen], references_of(fps[chosen], max_distance))
            found += [chosen[x] for x in _small_groups(fps[chosen], table, group[chosen], max_distance)]
        starts = np.r_[0, np.cumsum(size)]
        for g in np.flatnonzero(size > SMALL_GROUP):
            own = fps[starts[g] : starts[g + 1]]
            root = tree_roots(own, distances(own, references_of(own, max_distance)), max_distance)
            at = np.flatnonzero(root != np.arange(len(root)))
            found.append(starts[g] + np.stack([root[at], at], axis=1))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = [], []

        def flush(keys: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            out = links(keys, rows[:, 1:] if named else rows)
            out = np.sort(rows[out, 0].view(np.int64), axis=1)
            out = np.unique(out[out[:, 0] != out[:, 1]], axis=0)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["src", "dst"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            fps = np.stack([b.column(k).to_numpy() for k in range(1, b.num_columns)], axis=1).view(np.uint64)
            last = np.searchsorted(keys, keys[-1])
            if last == 0 and held_k and len(held_k[-1]) and held_k[-1][-1] == keys[0]:
                held_k.append(keys)
                held_f.append(fps)
                continue
            held_k.append(keys[:last])
            held_f.append(fps[:last])
            if sum(map(len, held_k)):
                yield from flush(np.concatenate(held_k), np.concatenate(held_f))
            held_k, held_f = [keys[last:]], [fps[last:]]
        if sum(map(len, held_k)):
            yield from flush(np.concatenate(held_k), np.concatenate(held_f))
        give_back()

    return run


def links_of_keys(distinct: DataFrame, keyed: Callable[[DataFrame], DataFrame], max_distance: int, most: int = LARGE_GROUP) -> DataFrame:
    """Links (src, dst) that connect, within each group of equal keys, what all its pairs at `max_distance` would.

    distinct: fingerprints in columns f0, f1, ..., each f0 once, which names them, unless a column `node` says
    what they already hang together with; links of a node to itself are left out. keyed gives one row for each
    key of a fingerprint, in a column `key`. A key of many rows is found by a sample of the fingerprints (one in
    SAMPLE; a key that it misses is only searched at once) and dealt to chunks.
    """
    parts = shuffle_partitions(distinct.sparkSession)
    named = "node" in distinct.columns
    words = [c for c in distinct.columns if c != "node"]
    columns = ["node", *words] if named else words
    rows, n = keyed(distinct), distinct.count()
    small, large = rows, None
    if n > most:
        drawn = distinct.where(F.pmod(F.xxhash64(F.lit("draw"), *words), F.lit(SAMPLE)) == 0)
        heavy = cut(keyed(drawn).groupBy("key").count().where(F.col("count") * SAMPLE > most).select(F.col("key").alias("g"), F.ceil(F.col("count") * (2 * SAMPLE) / most).cast("long").alias("n")))
        if heavy.count():
            small = rows.join(beside(heavy), rows["key"] == F.col("g"), "left_anti")
            own = rows.withColumnRenamed("key", "g").join(beside(heavy.select("g")), "g", "left_semi").select("g", F.col(words[0]).alias("item"), *words)

            def read(found: list[pa.Array]) -> list:
                return list(np.stack([c.to_numpy() for c in found], axis=1).view(np.uint64))

            def roots_of(kept: list) -> np.ndarray:
                fps = np.array(kept)
                return tree_roots(fps, distances(fps, references_of(fps, max_distance)), max_distance)

            large = groups.links(own, heavy, read, roots_of, most).distinct().toDF("src", "dst")
            if named:
                names = distinct.select(F.col(words[0]).alias("name"), "node")
                large = large.join(names, F.col("src") == F.col("name")).select(F.col("node").alias("src"), "dst")
                large = large.join(names, F.col("dst") == F.col("name")).select("src", F.col("node").alias("dst")).where("src != dst")
    dealt = small.select("key", *columns).repartition(parts, "key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_link_groups(max_distance, named), "src long, dst long")
    return found if large is None else found.unionByName(large)


def near_links(distinct: DataFrame, max_distance: int = MAX_DISTANCE, most: int = LARGE_GROUP) -> DataFrame:
    """Links (src, dst) that connect the fingerprints in column `fp` (each once) exactly as all pairs at `max_distance` would."""
    distinct = distinct.select(F.col("fp").alias("f0"))
    agree = agreeing_blocks(distinct.count(), max_distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(max_distance + agree, max_distance)]
    keys = F.explode(F.array(*(F.xxhash64(F.lit(k), F.col("f0").bitwiseAND(F.lit(m))) for k, m in enumerate(signed))))
    return links_of_keys(distinct, lambda df: df.select(keys.alias("key"), "f0"), max_distance, most=most)


def _components(prints: DataFrame, max_distance: int) -> tuple[DataFrame, DataFrame]:
    """(distinct fingerprints: fp, least doc_id, rows n; fp and root of those that have a link)."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    return distinct, cut(connected_components(near_links(distinct.select("fp"), max_distance)).toDF("fp", "root"))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row."""
    prints = cut(fingerprints(docs, shingle_words))
    distinct, linked = _components(prints, max_distance)
    grouped = linked.join(distinct, "fp")
    least = grouped.groupBy("root").agg(F.min("least").alias("root_least"))
    roots = grouped.join(least, "root").select("fp", "root_least")
    own = cut(distinct.join(roots, "fp", "left").select("fp", "n", F.coalesce("root_least", "least").alias("component_id")))
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    # Fingerprints of many rows: at most a thousand can have a thousandth of all rows each, so that side is bounded.
    heavy = F.broadcast(own.where(F.col("n") * 1000 >= prints.count()).select("fp", "component_id"))
    most = prints.join(heavy.select("fp"), "fp", "left_anti").join(own.select("fp", "component_id"), "fp")
    return prints.join(heavy, "fp").select("doc_id", shown, "component_id").unionByName(most.select("doc_id", shown, "component_id"))
