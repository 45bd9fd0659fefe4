"""Search of groups that may be too large for one task, exactly and with bounded tasks.

Rows (g, chunk, item, ...) say which group an item belongs to; a large group is dealt
to several chunks. Each chunk is searched by itself. One item of each chunk's largest
tree is searched against those of the group's other chunks (again in chunks, if they
are many), which joins the largest trees to the group's main tree. Whatever is outside
the main tree is sent to all chunks of its group. Two linked items of different chunks
are either both in the main tree, or one of them meets the other in its chunk, so no
link is lost, and a group of near copies, which is one tree, costs one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.memory import give_back
from callscope.operators.components import connected_components
from callscope.runtime import beside, cut, shuffle_partitions

#: From a batch's payload columns to what is kept of each row.
Read = Callable[[list[pa.Array]], list]
#: From what was kept of a chunk's items to the place of each item's root.
RootsOf = Callable[[list], np.ndarray]
#: Rows that are read at a time.
BATCH = 256


def labelled(rows: DataFrame, read: Read, roots_of: RootsOf) -> DataFrame:
    """(g, chunk, item, root) of every row; an item that a chunk holds twice counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, items, kept = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if items:
                own = np.array(items, np.int64)
                root = own[roots_of(kept)] if len(items) > 1 else own
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, at[0], np.int64)), pa.array(np.full(n, at[1], np.int64)), pa.array(own), pa.array(root)], names=["g", "chunk", "item", "root"])

        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                columns = [part.column(k) for k in range(part.num_columns)]
                for g, c, item, x in zip(*(column.to_pylist() for column in columns[:3]), read(columns[3:])):
                    if (g, c) != at:
                        yield from flush()
                        at, items, kept = (g, c), [], []
                    if not items or items[-1] != item:
                        items.append(item)
                        kept.append(x)
        yield from flush()
        give_back()

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "g", "chunk").sortWithinPartitions("g", "chunk", "item")
    return dealt.mapInArrow(run, "g long, chunk long, item long, root long")


def dealt_to_chunks(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """rows (g, item, ...) with a chunk; chunks (g, n) has the groups that need more than one."""
    n = F.coalesce("n", F.lit(1).cast("long"))
    own = rows.join(beside(chunks), "g", "left").withColumn("chunk", F.pmod(F.xxhash64("g", "item"), n))
    return own.select("g", "chunk", "item", *(c for c in rows.columns if c not in ("g", "item")))


def links(rows: DataFrame, chunks: DataFrame, read: Read, roots_of: RootsOf, most: int) -> DataFrame:
    """(item, root) links that connect the items of each group as all its pairs would.

    rows: g, item and the payload; chunks: g and n of the groups that need n > 1 chunks.
    most: representatives that are searched at once.
    """
    chunks = cut(chunks)
    dealt = dealt_to_chunks(rows, chunks)
    if not chunks.count():
        return labelled(dealt, read, roots_of).where("item != root").select("item", "root")
    local = cut(labelled(dealt, read, roots_of))
    large = local.join(beside(chunks.select("g")), "g", "left_semi")
    trees = cut(large.groupBy("g", "chunk", "root").count())
    main = cut(trees.groupBy("g", "chunk").agg(F.max(F.struct("count", "root")).alias("x")).select("g", "chunk", F.col("x.root").alias("item"), F.col("x.count").alias("size")))
    chosen = beside(main.select("g", "item").distinct())
    few = main.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias("n")).where("n > 1")
    few = cut(few)
    above = cut(links(rows.join(chosen, ["g", "item"], "left_semi"), few, read, roots_of, most))
    tops = cut(connected_components(above).toDF("item", "root")) if few.count() else above
    # The main tree of a group: the representatives that hang together and have most items below them.
    top = main.join(beside(tops), "item", "left").select("g", "chunk", "item", "size", F.coalesce("root", "item").alias("top"))
    best = top.groupBy("g", "top").agg(F.sum("size").alias("size")).groupBy("g").agg(F.max(F.struct("size", "top")).alias("x")).select("g", F.col("x.top").alias("top"))
    inside = cut(top.join(best, ["g", "top"]).select("g", "chunk", F.col("item").alias("root")))
    rest = cut(large.join(beside(inside), ["g", "chunk", "root"], "left_anti").select("g", "item").distinct())
    sent = rows.join(beside(rest), ["g", "item"]).join(beside(chunks), "g").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    held = dealt.join(beside(rest.select("g").distinct()), "g", "left_semi")
    met = labelled(held.unionByName(sent.select(held.columns)), read, roots_of)
    found = local.select("item", "root").unionByName(above.select("item", "root")).unionByName(met.select("item", "root"))
    return found.where("item != root")
