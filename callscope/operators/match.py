"""Lookup of requests among remembered callsites: inverted index on template lines, containment gate, margin on score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.text import USER_MARKER, jaccard
from callscope.runtime import BROADCAST_ROWS
from callscope.settings import Settings


#: Fixed value.
RUNNERS_UP = 3


def template_lines(known: DataFrame) -> DataFrame:
    """known (node_id, template, ...) with its distinct lines; the marker of the user part isn't one."""
    return known.withColumn("lines", F.array_distinct(F.filter("template", lambda x: (x != USER_MARKER) & (x != ""))))


def anchors(known: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(node_id, line, postings, place): the rarest lines of each callsite, of those that at most max(2, 2%) of all callsites hold."""
    own = template_lines(known)
    exploded = own.select("node_id", F.explode("lines").alias("line"))
    postings = exploded.groupBy("line").agg(F.count(F.lit(1)).alias("postings"))
    estate = own.agg(F.greatest(F.lit(2), F.ceil(F.count(F.lit(1)) * settings.common_fraction)).alias("limit"))
    place = F.row_number().over(Window.partitionBy("node_id").orderBy("postings", "line"))
    rare = exploded.join(postings, "line").crossJoin(F.broadcast(estate)).where(F.col("postings") <= F.col("limit"))  # one row
    return rare.withColumn("place", place).where(F.col("place") <= settings.anchors).select("node_id", "line", "postings", "place")


def candidate_score(contained: Column, known_tools: Column, tools: Column, known_shape: Column, shape: Column, settings: Settings = Settings()) -> tuple[Column, Column]:
    """(score, contained): containment counts three times beside tools and shape; disjoint tools cap both."""
    t = jaccard(known_tools, tools)
    any_tools = (F.size(known_tools) > 0) | (F.size(tools) > 0)
    has_shape = (F.coalesce(known_shape, F.lit("")) != "") & (F.coalesce(shape, F.lit("")) != "")
    parts = contained * 3 + F.when(any_tools, t).otherwise(0.0) + F.when(has_shape, F.when(known_shape == shape, 1.0).otherwise(0.5)).otherwise(0.0)
    score = parts / (F.lit(3) + F.when(any_tools, 1).otherwise(0) + F.when(has_shape, 1).otherwise(0))
    apart = (F.size(known_tools) > 0) & (F.size(tools) > 0) & (t == 0)
    cap = F.lit(settings.veto)
    return F.when(apart, F.least(score, cap)).otherwise(score), F.when(apart, F.least(contained, cap)).otherwise(contained)


def lookup(requests: DataFrame, known: DataFrame, settings: Settings = Settings(), scope_to_app: bool = False, prune: bool = False) -> DataFrame:
    """One row for each request (request_id, app_id, lines, tools, shape): status, node_id, score, contained, runner_up, runners_up (at most three).

    By default every callsite that shares a template line is scored, which finds what a full scan finds.
    prune: only callsites that share one of their anchor lines, as a bounded index for very large estates; a callsite
    whose rarest lines are all missing from a request is then not looked at.
    """
    own = template_lines(known)
    every = own.select("node_id", F.explode("lines").alias("line"))
    index = every
    if prune:  # a callsite with tools and no anchor is found by any of its lines
        index = anchors(known, settings).select("node_id", "line")
        index = index.unionByName(every.join(own.where(F.size("tools") > 0).select("node_id").join(index, "node_id", "left_anti"), "node_id", "left_semi"))
    small = known.count() <= BROADCAST_ROWS // 50
    index = F.broadcast(index) if small else index
    rows = requests.select("request_id", "app_id", F.explode(F.array_distinct("lines")).alias("line"))
    hits = rows.join(index, "line").select("request_id", "node_id").distinct()
    index_of = anchors(known, settings).select("node_id").distinct().withColumn("_anchored", F.lit(True))
    own = own.join(index_of, "node_id", "left").where(F.col("_anchored") | (F.size("tools") > 0))  # what can't be told apart is never an answer
    side = own.select("node_id", F.col("app_id").alias("k_app"), F.col("lines").alias("k_lines"), F.col("tools").alias("k_tools"), F.col("shape").alias("k_shape"))
    side = F.broadcast(side) if small else side
    scored = hits.join(side, "node_id").join(requests.select("request_id", "app_id", "lines", "tools", "shape"), "request_id")
    if scope_to_app:
        scored = scored.where("k_app = app_id")
    contained = F.size(F.array_intersect("k_lines", "lines")) / F.size("k_lines")
    score, held = candidate_score(contained, F.col("k_tools"), F.col("tools"), F.col("k_shape"), F.col("shape"), settings)
    scored = scored.withColumns({"score": score, "contained": held}).where(F.col("contained") > 0)
    best = scored.groupBy("request_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "contained", "node_id")), asc=False), 1, 1 + RUNNERS_UP).alias("c"))
    first, second = F.col("c")[0], F.try_element_at("c", F.lit(2))
    status = F.when(F.coalesce(first["contained"], F.lit(0.0)) < settings.containment, "unknown").when(first["score"] - F.coalesce(second["score"], F.lit(-1.0)) < settings.margin, "ambiguous").otherwise("matched")
    out = requests.select("request_id").join(best, "request_id", "left").withColumn("status", status)
    return out.select("request_id", "status", F.when(F.col("status") != "unknown", first["node_id"]).alias("node_id"), first["score"].alias("score"), first["contained"].alias("contained"), second["node_id"].alias("runner_up"),
                      F.coalesce(F.transform(F.slice("c", 2, RUNNERS_UP), lambda x: x["node_id"]), F.array().cast(f"array<{known.schema['node_id'].dataType.simpleString()}>")).alias("runners_up"))
