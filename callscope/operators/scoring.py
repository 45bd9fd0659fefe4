"""Scores against known truth (purity, completeness, coverage) and without it (separation of pair scores)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.text import bucket, counted_ranks, rank_at


def truth_scores(assigned: DataFrame, truth: DataFrame, ambiguous: DataFrame | None = None, app: str = "app_id") -> DataFrame:
    """One row for each app. assigned: app_id, request_id, node_id (null: in none); truth: request_id, callsite; ambiguous requests don't count."""
    known = assigned.join(truth, "request_id")
    if ambiguous is not None:
        known = known.join(ambiguous.select("request_id"), "request_id", "left_anti")
    counts = known.groupBy(app, "node_id", "callsite").agg(F.count(F.lit(1)).alias("n"))
    inside = counts.where(F.col("node_id").isNotNull())
    nodes = inside.groupBy(app, "node_id").agg(F.max("n").alias("top"), F.count(F.lit(1)).alias("kinds"))
    sites = inside.groupBy(app, "callsite").agg(F.max("n").alias("top"), F.count(F.lit(1)).alias("pieces"))
    total = counts.groupBy(app).agg(F.sum("n").alias("scored"), F.sum(F.when(F.col("node_id").isNotNull(), F.col("n")).otherwise(0)).alias("assigned"), F.count_distinct("callsite").alias("true_callsites"))
    a = nodes.groupBy(app).agg(F.sum("top").alias("pure"), F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("kinds") > 1).alias("mixed_nodes"))
    b = sites.groupBy(app).agg(F.sum("top").alias("whole"), F.count_if(F.col("pieces") > 1).alias("split_callsites"))
    out = total.join(a, app, "left").join(b, app, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return out.select(
        app, "true_callsites", zero("nodes").alias("nodes"), "scored", "assigned", F.round(F.col("assigned") / F.col("scored"), 3).alias("coverage"),
        F.coalesce(F.round(F.try_divide(zero("pure"), F.col("assigned")), 3), F.lit(0.0)).alias("purity"), F.round(zero("whole") / F.col("scored"), 3).alias("completeness"),
        zero("mixed_nodes").alias("mixed_nodes"), zero("split_callsites").alias("split_callsites"),
    )


def separation(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gap, worst) of labelled pair scores (score, same): 10th percentile within against 90th across, and least within against greatest across."""
    within = counted_ranks(pairs.where(F.col("same")), keys, "score", {"low": rank_at(0.10), "least": lambda n: F.lit(0)})
    across = counted_ranks(pairs.where(~F.col("same")), keys, "score", {"high": rank_at(0.90), "most": lambda n: n - 1})
    out = pairs.select(*keys).distinct().join(within, keys, "left").join(across, keys, "left")
    return out.select(*keys, (F.col("low") - F.col("high")).alias("gap"), (F.col("least") - F.col("most")).alias("worst"))


def histogram(values: DataFrame, value: str, keys: list[str], bins: int = 20) -> DataFrame:
    """(keys, bin, n) of shares in [0, 1]."""
    return values.groupBy(*keys, bucket(F.col(value), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", place).where(F.col("_n") <= k).drop("_n")
