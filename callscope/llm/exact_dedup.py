"""Exact deduplication through counting quotient filters.

Every partition builds a counting quotient filter (CQF) over the 64-bit
fingerprints of its texts, cut into segments by the leading bits. The filters of a
segment merge without loss by their sorted remainders. Only fingerprints counted
more than once are routed to byte verification; all other rows are known to be
alone without their text ever being shuffled.

Defined results: a null text counts as the empty text; texts are compared byte for
byte with no normalisation; of equal texts the row with the largest doc_id stays
(a null doc_id is smaller than any other); of rows that also agree in doc_id
exactly one stays; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.runtime import beside, cut, shuffle_partitions

#: Bits of the quotient inside one segment.
QUOTIENT_BITS = 8
#: Fingerprints of a segment, where there are many.
SEGMENT_ROWS = 1 << 20


class CountingQuotientFilter:
    """The fingerprints of one segment: runs of sorted remainders per quotient, each with a count.

    `runs[q]` is the length of quotient q's run. Quotient and remainder together
    are the whole fingerprint below the segment's bits, so merging loses nothing.
    """

    def __init__(self, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.runs, self.remainders, self.counts = runs, remainders, counts

    @staticmethod
    def _build(low: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        order = np.argsort(low, kind="stable")
        low, counts = low[order], counts[order]
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]]) if len(low) else np.zeros(0, np.int64)
        low = low[first]
        counts = np.add.reduceat(counts, first) if len(first) else counts
        shift = np.uint64(bits - QUOTIENT_BITS)
        runs = np.bincount((low >> shift).astype(np.int64), minlength=1 << QUOTIENT_BITS).astype("<u4")
        return CountingQuotientFilter(runs, low & ((np.uint64(1) << shift) - np.uint64(1)), counts)

    @classmethod
    def from_fingerprints(cls, low: np.ndarray, bits: int) -> CountingQuotientFilter:
        return cls._build(low.astype(np.uint64), np.ones(len(low), np.int64), bits)

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter], bits: int) -> CountingQuotientFilter:
        return cls._build(np.concatenate([f.fingerprints(bits) for f in filters]), np.concatenate([f.counts for f in filters]), bits)

    def fingerprints(self, bits: int) -> np.ndarray:
        quotients = np.repeat(np.arange(1 << QUOTIENT_BITS, dtype=np.uint64), self.runs)
        return (quotients << np.uint64(bits - QUOTIENT_BITS)) | self.remainders

    def to_bytes(self) -> bytes:
        """Only the runs that are not empty and the counts that are not one are written."""
        used, many = np.flatnonzero(self.runs), np.flatnonzero(self.counts > 1)
        head = np.array([len(self.remainders), len(used), len(many)], "<u4")
        parts = (head, used.astype("u1"), self.runs[used].astype("<u4"), self.remainders.astype("<u8"), many.astype("<u4"), self.counts[many].astype("<i8"))
        return b"".join(x.tobytes() for x in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        n, used, many = (int(x) for x in np.frombuffer(data, "<u4", 3))
        at, found = 12, []
        for kind, size in (("u1", used), ("<u4", used), ("<u8", n), ("<u4", many), ("<i8", many)):
            found.append(np.frombuffer(data, kind, size, at))
            at += found[-1].nbytes
        runs, counts = np.zeros(1 << QUOTIENT_BITS, "<u4"), np.ones(n, np.int64)
        runs[found[0]] = found[1]
        counts[found[3]] = found[4]
        return cls(runs, found[2], counts)


def _build_filters(segment_bits: int):
    bits = 64 - segment_bits

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [b["fp"].to_numpy(np.int64).view(np.uint64) for b in batches]
        if not seen:
            return
        fps = np.sort(np.concatenate(seen))
        segments = fps >> np.uint64(bits)
        low = fps & ((np.uint64(1) << np.uint64(bits)) - np.uint64(1))
        ids, starts = np.unique(segments, return_index=True)
        ends = np.r_[starts[1:], len(fps)]
        for at in range(0, len(ids), 64):
            part = slice(at, at + 64)
            payload = [CountingQuotientFilter.from_fingerprints(low[a:b], bits).to_bytes() for a, b in zip(starts[part], ends[part])]
            yield pd.DataFrame({"segment": ids[part].astype(np.int64), "payload": payload})

    return build


def _merge_filters(segment_bits: int):
    bits = 64 - segment_bits

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((s, p) for b in batches for s, p in zip(b["segment"], b["payload"]))
        for segment, group in groupby(rows, key=lambda r: r[0]):
            whole = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(p) for _, p in group], bits)
            many = whole.counts > 1
            fps = whole.fingerprints(bits)[many] | (np.uint64(segment) << np.uint64(bits))
            if len(fps):
                yield pd.DataFrame({"fp": fps.view(np.int64), "n": whole.counts[many]})

    return merge


def segments(rows: int, parts: int) -> int:
    """Bits of the segment number: enough segments for the tasks at hand, or one for SEGMENT_ROWS fingerprints."""
    return max(1, math.ceil(math.log2(max(min(4 * parts, 256), rows / SEGMENT_ROWS))))


def repeated_fingerprints(fps: DataFrame) -> DataFrame:
    """(fp, n) of every fingerprint that the column `fp` holds more than once."""
    parts = shuffle_partitions(fps.sparkSession)
    bits = segments(fps.count(), parts)
    filters = fps.mapInPandas(_build_filters(bits), "segment long, payload binary")
    return filters.repartition(parts, "segment").sortWithinPartitions("segment").mapInPandas(_merge_filters(bits), "fp long, n long")


def _annotated(docs: DataFrame) -> DataFrame:
    """docs with _cs_keep_id, _cs_group_size, _cs_kept and _cs_text_sha256."""
    body = F.coalesce(F.col("text"), F.lit(""))
    base = docs.withColumn("_cs_fp", F.xxhash64(body))
    repeated = cut(repeated_fingerprints(base.select(F.col("_cs_fp").alias("fp"))))
    # Byte verification: equal fingerprints are parted by their texts.
    groups = cut(
        docs.select("doc_id", body.alias("_cs_body"), F.xxhash64(body).alias("_cs_fp")).join(beside(repeated.select(F.col("fp").alias("_cs_fp"))), "_cs_fp", "left_semi")
        .groupBy("_cs_fp", "_cs_body").agg(F.max("doc_id").alias("_cs_max"), F.count(F.lit(1)).alias("_cs_count"))
        .select("_cs_fp", F.sha2("_cs_body", 256).alias("_cs_text_sha256"), "_cs_max", "_cs_count")
    )
    joined = base.withColumn("_cs_text_sha256", F.sha2(body, 256)).join(beside(groups), ["_cs_fp", "_cs_text_sha256"], "left")
    joined = joined.withColumn("_cs_group_size", F.coalesce("_cs_count", F.lit(1).cast("long")))
    joined = joined.withColumn("_cs_keep_id", F.when(F.col("_cs_count").isNull(), F.col("doc_id")).otherwise(F.col("_cs_max")))
    wins = F.col("doc_id").eqNullSafe(F.col("_cs_keep_id"))
    columns = [*docs.columns, "_cs_keep_id", "_cs_group_size", "_cs_kept", "_cs_text_sha256"]
    # Rows that agree in doc_id and text compete; they are only looked for where there are any.
    rivals = cut(joined.where(wins & (F.col("_cs_group_size") > 1)).groupBy("_cs_fp", "_cs_text_sha256").agg(F.count(F.lit(1)).alias("_cs_n")).where("_cs_n > 1").select("_cs_fp", "_cs_text_sha256"))
    if not rivals.count():
        return joined.withColumn("_cs_kept", wins).select(columns)
    several = beside(rivals.withColumn("_cs_rival", F.lit(True)))
    joined = joined.join(several, ["_cs_fp", "_cs_text_sha256"], "left")
    alone = joined.where(F.col("_cs_rival").isNull() | ~wins).withColumn("_cs_kept", wins)
    # This window is as small as the repeats of one row.
    first = Window.partitionBy("_cs_fp", "_cs_text_sha256").orderBy(F.lit(1))
    again = joined.where(F.col("_cs_rival") & wins).withColumn("_cs_kept", F.row_number().over(first) == 1)
    return alone.select(columns).unionByName(again.select(columns))


def annotate(docs: DataFrame) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256 for every row (columns of these names are replaced)."""
    out = ("keep_id", "group_size", "kept", "text_sha256")
    found = _annotated(docs.drop(*out))
    return found.withColumnsRenamed({f"_cs_{c}": c for c in out})


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' own columns, whatever their names."""
    return _annotated(docs).where("_cs_kept").select(docs.columns)
