"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points are mapped through the sources' cumulative target shares, so
every stretch of the schedule holds each source close to its share. A source's slots
are ranked, and slot r takes the r-th equal-token block of the source's stream: its
documents, shuffled by a hash, end to end, again and again up to three times.

Ranks and stream positions come from two levels (counts of a chunk, then a window
inside it), so a source that holds a third of all rows is never one task. The only
broadcast side has one row per source, checked for size.

Defined results: a null text has size 0; the null source is a source and comes last;
a source without words has target 0; repeated rows take part as documents of their
own; a null doc_id is shuffled as the empty id; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.runtime import BROADCAST_ROWS, beside, cut

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in order. slots: length of the schedule; a block is so many words that the slots together hold the target."""

    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    slots: int = 1 << 18
    chunk: int = 1024
    cells: int = 1024
    seed: str = "mix"
    documents_per_bucket: int = 512


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """sid, source, source_size, target of each source, from rows (source, size). One row per source stands in each window."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("sid", rank)
    weight = F.array(*map(F.lit, mix.weights))[F.col("sid") % len(mix.weights)].cast("long")
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * mix.most)
    per = per.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    # A source is full if the level that fills what is left, once all that fill earlier are full, reaches its cap.
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.col("total") - before).cast("double") / onward.cast("double"))
    full = F.col("cap").cast("double") / F.col("weight") <= F.col("level")
    level = F.max(F.when(~full, F.col("level"))).over(Window.partitionBy())
    target = F.when(full, F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return per.select("sid", "source", "source_size", target.alias("target"))


def schedule(targets: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """slot, sid, rank and the words [low, high) of the source's repeated stream that the slot takes."""
    spark = targets.sparkSession
    share = Window.orderBy("sid")
    real = targets.where(F.col("target") >= 1)
    bounds = real.withColumn("upto", F.sum("target").over(share)).withColumn("whole", F.sum("target").over(Window.partitionBy()))
    bounds = bounds.select(
        "sid", "source_size", F.floor("target").alias("goal"),
        F.coalesce(F.lag("upto").over(share) / F.col("whole"), F.lit(0.0)).alias("from"),
        F.when(F.lead("sid").over(share).isNull(), F.lit(2.0)).otherwise(F.col("upto") / F.col("whole")).alias("to"),
    )
    # Range join through a grid over [0, 1): a point only meets the sources whose interval touches its cell.
    last = F.lit(mix.cells - 1)
    grid = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") * mix.cells).cast("int"), F.least(last, F.floor(F.col("to") * mix.cells).cast("int")))))
    points = spark.range(mix.slots).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN - F.floor(F.col("id") * GOLDEN)).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * mix.cells).cast("int"))
    small = targets.count() <= BROADCAST_ROWS
    side = F.broadcast(grid) if small else grid
    placed = points.join(side, "cell").where((F.col("point") >= F.col("from")) & (F.col("point") < F.col("to"))).select("slot", "sid")
    placed = cut(placed.withColumn("chunk", F.floor(F.col("slot") / mix.chunk)))
    # Rank within the source: slots of earlier chunks, then those of the own chunk.
    counts = placed.groupBy("sid", "chunk").count()
    earlier = Window.partitionBy("sid").orderBy("chunk")
    counts = counts.withColumn("earlier", F.coalesce(F.sum("count").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    ranked = placed.withColumn("own", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(counts, ["sid", "chunk"]).select("slot", "sid", (F.col("earlier") + F.col("own")).alias("rank"))
    totals = counts.groupBy("sid").agg(F.sum("count").alias("n"))
    # A source whose share is less than a slot's still gets one, behind the others.
    missed = bounds.join(totals, "sid", "left_anti").select((F.col("sid") + mix.slots).cast("long").alias("slot"), "sid", F.lit(0).cast("long").alias("rank"))
    known = bounds.join(totals, "sid", "left").select("sid", "source_size", "goal", F.coalesce("n", F.lit(1).cast("long")).alias("n"))
    known = F.broadcast(known) if small else known
    return (
        ranked.unionByName(missed).join(known, "sid")
        .select("slot", "sid", "rank", "source_size", "goal", "n", F.expr("rank * goal div n").alias("low"), F.expr("(rank + 1) * goal div n").alias("high"))
        .where(F.col("high") > F.col("low"))
    )


def _streams(sizes: DataFrame, targets: DataFrame, mix: Mix) -> DataFrame:
    """Every document with its place in its source's shuffled stream: doc_id, sid, size, bucket, rn, start."""
    side = beside(targets)
    placed = sizes.join(side, sizes["source"].eqNullSafe(side["source"])).select("doc_id", "size", "sid", "source_size", "target")
    buckets = max(1, sizes.count() // mix.documents_per_bucket)
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(mix.seed)))
    placed = placed.withColumn("digest", digest).withColumn("bucket", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)))
    inside = Window.partitionBy("sid", "bucket").orderBy("digest", "doc_id", "size")
    placed = placed.withColumn("rn", F.row_number().over(inside)).withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    sums = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0).cast("long")).alias("offset"))
    return placed.join(sums, ["sid", "bucket"]).withColumn("start", F.col("offset") + F.col("inside")).drop("offset", "inside", "digest")


def _in_cells(df: DataFrame, low: str, high: str) -> DataFrame:
    """One row for each cell of the stream that [low, high) touches, cut at its edges; an empty range keeps one row, in no cell."""
    cells = F.when(F.col(high) > F.col(low), F.sequence(F.expr(f"{low} div width"), F.expr(f"({high} - 1) div width"))).otherwise(F.array(F.lit(-1).cast("long")))
    df = df.withColumn("cell", F.explode(cells))
    return df.withColumn(low, F.greatest(low, F.col("cell") * F.col("width"))).withColumn(high, F.when(F.col("cell") < 0, F.col(low)).otherwise(F.least(high, (F.col("cell") + 1) * F.col("width"))))


def mixture(docs: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """(pieces, targets): for every document, and slot and pass over its source that takes words of it, how many (`taken`).

    Pieces carry doc_id, sid, size, bucket, rn (together a row's identity), slot, turn, taken; a document
    that nothing takes has one row without a slot.
    """
    sizes = cut(docs.select(F.col("doc_id"), F.col("source"), words(F.col("text")).alias("size")))
    targets = cut(source_targets(sizes, mix))
    slots = schedule(targets, mix)
    width = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("goal") / F.col("n"))).alias("width")
    widths = slots.groupBy("sid").agg(F.max(width).alias("width"))
    turns = slots.select("slot", "sid", "source_size", "low", "high", width).withColumn("turn", F.explode(F.expr("sequence(low div source_size, (high - 1) div source_size)")))
    turns = turns.withColumn("low", F.greatest(F.col("low") - F.col("turn") * F.col("source_size"), F.lit(0).cast("long"))).withColumn("high", F.least(F.col("high") - F.col("turn") * F.col("source_size"), F.col("source_size")))
    blocks = _in_cells(turns, "low", "high").select("slot", "turn", "sid", "cell", "low", "high")
    placed = _streams(sizes, targets, mix).join(beside(widths), "sid", "left")
    placed = placed.withColumn("width", F.coalesce("width", F.lit(1 << 40).cast("long"))).withColumn("stop", F.col("start") + F.col("size"))
    pieces = _in_cells(placed, "start", "stop").join(blocks, ["sid", "cell"], "left")
    none = F.lit(0).cast("long")
    taken = F.when(F.col("slot").isNull(), none).otherwise(F.greatest(F.least("stop", "high") - F.greatest("start", "low"), none))
    return pieces.select("doc_id", "sid", "size", "bucket", "rn", "source_size", "target", "slot", "turn", taken.alias("taken")), targets


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mixture takes, repeats counted) of every row."""
    pieces, _ = mixture(docs, mix)
    keys = ["sid", "bucket", "rn", "doc_id", "size", "source_size", "target"]
    return pieces.groupBy(*keys).agg(F.sum("taken").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_copies(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """docs' rows as the mixture takes them: once for each pass that takes at least half of a document's words.

    Rows without words stay once. Rows are told apart by doc_id and size, so repeated rows share what they are given.
    """
    pieces, _ = mixture(docs, mix)
    turns = pieces.groupBy("sid", "bucket", "rn", "doc_id", "size", "turn").agg(F.sum("taken").alias("taken"))
    copies = F.sum(F.when(F.col("taken") * 2 >= F.col("size"), 1).otherwise(0))
    rows = turns.groupBy("sid", "bucket", "rn", "doc_id", "size").agg(copies.alias("_cs_copies"))
    # Repeated rows (same doc_id and size) are dealt what their group got, row by row.
    given = rows.groupBy(F.col("doc_id").alias("_cs_id"), F.col("size").alias("_cs_size")).agg(F.sort_array(F.collect_list("_cs_copies")).alias("_cs_given"))
    given = beside(cut(given))
    many = docs.withColumn("_cs_size", words(F.col("text")))
    joined = many.join(given, many["doc_id"].eqNullSafe(given["_cs_id"]) & (many["_cs_size"] == given["_cs_size"]))
    alone = joined.where(F.size("_cs_given") == 1).withColumn("_cs_n", F.col("_cs_given")[0])
    again = joined.where(F.size("_cs_given") > 1).withColumn("_cs_k", F.row_number().over(Window.partitionBy("_cs_id", given["_cs_size"]).orderBy("source", "text")))
    again = again.withColumn("_cs_n", F.element_at("_cs_given", F.col("_cs_k")))
    out = [docs[c] for c in docs.columns]
    both = alone.select(*out, "_cs_n").unionByName(again.select(*out, "_cs_n"))
    return both.withColumn("_cs_n", F.explode(F.sequence(F.lit(1), F.when(F.col("_cs_n") > 0, F.col("_cs_n").cast("int"))))).select(docs.columns)


#: DuckDB SQL of mix_documents with the default parameters over the table documents.
ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source)),
capped AS (
  SELECT *, [1, 2, 3][(sid % 3 + 1)::INT] AS weight, source_size * 3 AS cap, sum(source_size) OVER () AS total FROM per),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM capped),
targets AS (
  SELECT sid, source, source_size,
         CASE WHEN cap::DOUBLE / weight <= level THEN cap::DOUBLE
              ELSE weight * max(CASE WHEN cap::DOUBLE / weight > level THEN level END) OVER () END AS target FROM levels),
shares AS (
  SELECT sid, source_size, floor(target)::BIGINT AS goal, sum(target) OVER (ORDER BY sid) AS upto, sum(target) OVER () AS whole
  FROM targets WHERE target >= 1),
bounds AS (
  SELECT sid, source_size, goal, coalesce(lag(upto) OVER (ORDER BY sid) / whole, 0.0) AS lo,
         CASE WHEN lead(sid) OVER (ORDER BY sid) IS NULL THEN 2.0 ELSE upto / whole END AS hi FROM shares),
points AS (
  SELECT range AS slot, range * 0.6180339887498949::DOUBLE - floor(range * 0.6180339887498949::DOUBLE) AS point FROM range(262144)),
placed AS (
  SELECT slot, b.sid, row_number() OVER (PARTITION BY b.sid ORDER BY slot) - 1 AS rnk, count(*) OVER (PARTITION BY b.sid) AS n, source_size, goal
  FROM points JOIN bounds b ON point >= lo AND point < hi
  UNION ALL
  SELECT 262144 + sid, sid, 0, 1, source_size, goal FROM bounds b
  WHERE NOT EXISTS (SELECT 1 FROM points WHERE point >= b.lo AND point < b.hi)),
slots AS (
  SELECT sid, source_size, (rnk::HUGEINT * goal // n)::BIGINT AS low, ((rnk + 1)::HUGEINT * goal // n)::BIGINT AS high FROM placed),
turns AS (
  SELECT sid, greatest(low - turn * source_size, 0) AS low, least(high - turn * source_size, source_size) AS high
  FROM (SELECT *, unnest(range(low // source_size, (high - 1) // source_size + 1)) AS turn FROM slots WHERE high > low)),
stream AS (
  SELECT s.doc_id, s.size, t.sid, t.source_size, t.target, row_number() OVER (ORDER BY 1) AS row_id,
         sum(s.size) OVER (PARTITION BY t.sid ORDER BY md5(coalesce(s.doc_id::VARCHAR, '') || 'mix'), s.doc_id NULLS FIRST, s.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
hits AS (
  SELECT row_id, sum(least(start + size, high) - greatest(start, low)) AS taken
  FROM stream JOIN turns USING (sid) WHERE start < high AND low < start + size GROUP BY row_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM stream LEFT JOIN hits USING (row_id)
"""
