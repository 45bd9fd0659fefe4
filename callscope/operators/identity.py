"""Callsites: noise filter, distinct points, similarity, linkage, templates, ids and quality.

Everything is keyed by app. Lines travel as 64-bit hashes; text comes back only for
templates. Calls are reduced to distinct points before anything is compared.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.text import USER_MARKER, counted_ranks, jaccard
from callscope.operators.components import connected_components
from callscope.runtime import BROADCAST_ROWS, cut
from callscope.settings import Settings

LONGS = "array<bigint>"
#: Keys that one app's pairs are dealt to.
PAIR_TASKS = 16


def doc_frequency(keyed: DataFrame, lines: str = "lines", app: str = "app_id") -> DataFrame:
    """(app_id, line, df): calls of an app that hold a line. `lines` is an array column; repeats in a call count once."""
    return keyed.select(F.col(app).alias("app_id"), F.explode(F.array_distinct(lines)).alias("line")).groupBy("app_id", "line").agg(F.count(F.lit(1)).alias("df"))


def frequency_bands(frequency: DataFrame, sizes: DataFrame) -> DataFrame:
    """(app_id, band, lines) of document frequencies; sizes: app_id, n."""
    share = F.col("df") / F.col("n")
    band = F.when(F.col("df") == 1, "singleton").when(share < 0.1, "<10%").when(share < 0.4, "10-40%").when(share < 0.9, "40-90%").otherwise(">=90%")
    return frequency.join(sizes, "app_id").groupBy("app_id", band.alias("band")).agg(F.count(F.lit(1)).alias("lines"))


def _keep(fp: DataFrame, lines: str, least: Column, sizes: DataFrame) -> DataFrame:
    """(app_id, h) of the lines whose document frequency reaches `least`, which may use n."""
    hashed = fp.select("app_id", F.transform(lines, lambda x: F.xxhash64(x)).alias("hs"))
    return doc_frequency(hashed, "hs").join(sizes, "app_id").where(F.col("df") >= least).select("app_id", F.col("line").alias("h"))


def _filtered(fp: DataFrame, lines: str, kept: DataFrame, name: str) -> DataFrame:
    """(app_id, request_id, <name>): ascending hashes of a call's lines that were kept (a left semi join, line by line)."""
    side = F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept
    rows = fp.select("app_id", "request_id", F.explode(F.transform(lines, lambda x: F.xxhash64(x))).alias("h"))
    return rows.join(side, ["app_id", "h"], "left_semi").groupBy("app_id", "request_id").agg(F.array_sort(F.collect_set("h")).alias(name))


def noise_filter(fp: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """fp with prompt_key and user_key: the lines that more than chance share within the app."""
    sizes = fp.groupBy("app_id").agg(F.count(F.lit(1)).alias("n"))
    prompt = _filtered(fp, "prompt_lines", cut(_keep(fp, "prompt_lines", F.lit(settings.min_doc_freq), sizes)), "prompt_key")
    least = F.greatest(F.lit(2), F.ceil(F.lit(settings.user_fraction) * F.col("n")))
    user = _filtered(fp, "user_lines", cut(_keep(fp, "user_lines", least, sizes)), "user_key")
    out = fp.join(prompt, ["app_id", "request_id"], "left").join(user, ["app_id", "request_id"], "left")
    none = F.array().cast(LONGS)
    return out.withColumns({"prompt_key": F.coalesce("prompt_key", none), "user_key": F.coalesce("user_key", none)})


POINT = ["prompt_key", "user_key", "tools", "shape", "response_format"]


def distinct_points(filtered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, membership): calls with equal views are one point.

    A point is named app#rank, by calls descending and first position; membership
    is (app_id, request_id, point).
    """
    grouped = filtered.groupBy("app_id", *POINT).agg(F.count(F.lit(1)).alias("calls"), F.min(F.struct("pos", "request_id")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("app_id").orderBy(F.col("calls").desc(), "first")) - 1
    points = cut(grouped.withColumn("rank", rank).withColumn("point", F.concat("app_id", F.lit("#"), F.lpad(F.col("rank").cast("string"), 9, "0"))))
    right = points.select("point", *(F.col(c).alias(f"_{c}") for c in ["app_id", *POINT]))
    same = F.col("app_id") == F.col("_app_id")
    for c in POINT:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return points, filtered.select("app_id", "request_id", "pos", *POINT).join(right, same).select("app_id", "request_id", "pos", "point")


VIEWS = ("prompt", "user", "tools", "shape", "format")


def _views(a: str, b: str, settings: Settings) -> tuple[list[Column], list[Column]]:
    """(scores, weights) of VIEWS for two points given as struct columns; a view that neither side has weighs nothing."""
    x, y = F.col(a), F.col(b)
    prompt, user, tools = jaccard(x["prompt_key"], y["prompt_key"]), jaccard(x["user_key"], y["user_key"]), jaccard(x["tools"], y["tools"])
    shape = F.when(x["shape"] == y["shape"], 1.0).otherwise(0.0)
    form = F.when(x["response_format"].eqNullSafe(y["response_format"]), 1.0).otherwise(0.0)
    thin = (F.size(x["prompt_key"]) <= settings.thin_lines) | (F.size(y["prompt_key"]) <= settings.thin_lines)
    has_user = (F.size(x["user_key"]) > 0) | (F.size(y["user_key"]) > 0)
    has_tools = (F.size(x["tools"]) > 0) | (F.size(y["tools"]) > 0)

    counts = [F.lit(True), has_user, has_tools, F.lit(True), F.lit(True)]
    weights = [F.when(c, F.when(thin, s).otherwise(w)).otherwise(0.0) for c, w, s in zip(counts, settings.weights, settings.thin_weights)]
    return [prompt, user, tools, shape, form], weights


def explain(a: str, b: str, settings: Settings = Settings()) -> Column:
    """What a similarity is made of: each view that counts, its score and its share of the weight."""
    scores, weights = _views(a, b, settings)
    total = reduce(lambda m, n: m + n, weights)
    return F.concat_ws(" ", *(F.when(w > 0, F.format_string(f"{name} %.2f(w%.2f)", s, w / total)) for name, s, w in zip(VIEWS, scores, weights)))


def similarity(a: str, b: str, settings: Settings = Settings()) -> Column:
    """Weighted similarity of two points given as struct columns; disjoint tools or user lines cap it."""
    x, y = F.col(a), F.col(b)
    scores, weights = _views(a, b, settings)
    plain = reduce(lambda m, n: m + n, [w * s for w, s in zip(weights, scores)]) / reduce(lambda m, n: m + n, weights)
    user, tools = scores[1], scores[2]
    both = lambda c: (F.size(x[c]) > 0) & (F.size(y[c]) > 0)
    apart = (both("tools") & (tools == 0)) | (both("user_key") & (user == 0))
    return F.when(apart, F.least(plain, F.lit(settings.veto))).otherwise(plain)


def pair_scores(points: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(app_id, a, b, score) of all point pairs of an app, among its `linkage_points` largest.

    The pairs of an app grow with the square of its points; the bound is the same guard that linkage has.
    The left side is dealt to PAIR_TASKS keys an app and the right side copied to each, so one app's pairs are many tasks.
    """
    view = F.struct("point", *POINT)
    linked = points.where(F.col("rank") < settings.linkage_points).select("app_id", "rank", view.alias("view"))
    left = linked.select("app_id", (F.col("rank") % PAIR_TASKS).alias("part"), F.col("rank").alias("i"), F.col("view").alias("x"))
    right = linked.select("app_id", F.explode(F.array(*map(F.lit, range(PAIR_TASKS)))).alias("part"), F.col("rank").alias("j"), F.col("view").alias("y"))
    pairs = left.join(right, ["app_id", "part"]).where(F.col("i") < F.col("j"))
    return pairs.select("app_id", F.col("x.point").alias("a"), F.col("y.point").alias("b"), similarity("x", "y", settings).alias("score"))


def explained(pairs: DataFrame, points: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """pairs (a, b, ...) with `why`: what their score is made of."""
    view = F.struct("point", *POINT)
    left, right = points.select(F.col("point").alias("a"), view.alias("_x")), points.select(F.col("point").alias("b"), view.alias("_y"))
    return pairs.join(left, "a").join(right, "b").withColumn("why", explain("_x", "_y", settings)).drop("_x", "_y")


#: Distinct lines of a weak prompt, and shapes that a signature lists.
WEAK_LINES, SHAPES = 3, 6


def identity_signature(fp: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group of fingerprints: what identity had to work with. Of equally frequent shapes the first seen comes first."""
    n_lines = F.size("prompt_lines").cast("long")
    own = fp.select(*keys, "pos", "has_system", "tools", "shape", "response_format", n_lines.alias("n_lines"), (F.size("user_lines") > 0).alias("has_user"))
    sums = own.groupBy(*keys).agg(
        F.count_if("has_system").alias("with_system_prompt"), F.count_if("has_user").alias("with_user_template"), F.count_if(F.col("n_lines") <= WEAK_LINES).alias("weak_prompts"),
        F.count_distinct("tools").alias("distinct_tool_sets"), F.count_distinct(F.coalesce("response_format", F.lit("\x00"))).alias("distinct_formats"),
    )
    median = counted_ranks(own, keys, "n_lines", {"median_prompt_lines": lambda n: F.floor(n / 2)})
    counted = own.groupBy(*keys, "shape").agg(F.count(F.lit(1)).alias("calls"), F.min("pos").alias("_first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("calls")).alias("n"), "_first", "shape"))), lambda s: F.struct(s["shape"].alias("shape"), (-s["n"]).alias("calls")))
    shapes = counted.groupBy(*keys).agg(ordered.alias("_s"), F.count(F.lit(1)).alias("distinct_shapes"))
    out = sums.join(median, keys).join(shapes, keys)
    return out.withColumns({"shape": F.col("_s")[0]["shape"], "shapes": F.slice("_s", 1, SHAPES)}).drop("_s")


def unlinked_calls(points: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(app_id, points, calls) that are beyond the guard of linkage_points, each a group of its own."""
    return points.where(F.col("rank") >= settings.linkage_points).groupBy("app_id").agg(F.count(F.lit(1)).alias("points"), F.sum("size").alias("calls"))


def ambiguous_pairs(pairs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pairs that just miss linkage, best first."""
    high = min(settings.tau, settings.ambiguous_high)
    return pairs.where((F.col("score") >= settings.ambiguous_low) & (F.col("score") < high)).withColumn("score", F.round("score", 4)).orderBy(F.col("score").desc(), "a", "b")


def clusters(points: DataFrame, pairs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(point, cluster): single linkage at tau; a cluster is named by its first point."""
    linked = connected_components(pairs.where(F.col("score") >= settings.tau).select("a", "b"))
    return points.join(linked.withColumnRenamed("node", "point"), "point", "left").select("app_id", "point", F.coalesce("component", "point").alias("cluster"))


def quality(points: DataFrame, labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cluster, min_internal, mean_internal, max_external, margin)."""
    own = labels.select("point", "cluster")
    named = pairs.join(own.toDF("a", "ca"), "a").join(own.toDF("b", "cb"), "b")
    inside = named.where("ca = cb").groupBy(F.col("ca").alias("cluster")).agg(F.min("score").alias("min_internal"), F.avg("score").alias("mean_internal"))
    outside = named.where("ca <> cb").select(F.explode(F.array("ca", "cb")).alias("cluster"), "score").groupBy("cluster").agg(F.max("score").alias("max_external"))
    out = labels.select("app_id", "cluster").distinct().join(inside, "cluster", "left").join(outside, "cluster", "left")
    one, none = F.lit(1.0), F.lit(0.0)
    out = out.withColumns({"min_internal": F.coalesce("min_internal", one), "mean_internal": F.coalesce("mean_internal", one), "max_external": F.coalesce("max_external", none)})
    return out.withColumn("margin", F.col("min_internal") - F.col("max_external"))


def stable_lines(member_lines: DataFrame, key: str, lines: str, fraction: float) -> DataFrame:
    """(key, line, df, size, stable) of each group's lines, `lines` an array column of one row for each member."""
    sizes = member_lines.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    counted = member_lines.select(key, F.explode(F.array_distinct(lines)).alias("line")).groupBy(key, "line").agg(F.count(F.lit(1)).alias("df"))
    return counted.join(sizes, key).withColumn("stable", F.col("df") >= fraction * F.col("size"))


def templates(filtered: DataFrame, membership: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(app_id, cluster, size, template, tools, shape, medoid, dynamic_lines): stable lines in the order of the member with most lines."""
    calls = membership.join(filtered.drop("app_id", "pos", *POINT[:2]), "request_id").withColumnRenamed("cluster", "cluster")
    keyed = calls.join(filtered.select("request_id", "prompt_key", "user_key"), "request_id")
    own = lambda lines, key: F.filter(F.array_distinct(lines), lambda x: F.array_contains(key, F.xxhash64(x)))
    keyed = keyed.withColumns({"_p": own("ordered_lines", F.col("prompt_key")), "_u": own("ordered_user_lines", F.col("user_key"))})

    def stable(lines: str, name: str) -> DataFrame:
        found = stable_lines(keyed, "cluster", lines, settings.stable_fraction)
        return found.groupBy("cluster").agg(F.collect_list(F.when(F.col("stable"), F.col("line"))).alias(name), F.count_if(~F.col("stable")).alias(f"{name}_rest"))

    medoid = keyed.groupBy("app_id", "cluster").agg(
        F.count(F.lit(1)).alias("size"),
        F.max_by(F.struct("request_id", "_p", "_u", "tools", "shape"), F.struct(F.size("ordered_lines"), -F.col("pos"))).alias("m"),
        F.max(F.size("user_key") > 0).alias("any_user"), F.count_distinct("prompt_key", "user_key").alias("distinct_prompts"),
    )
    out = medoid.join(stable("_p", "sp"), "cluster", "left").join(stable("_u", "su"), "cluster", "left")
    none = F.array().cast("array<string>")
    ordered = lambda lines, kept: F.array_intersect(lines, F.coalesce(kept, none))
    system, user = ordered(F.col("m._p"), F.col("sp")), ordered(F.col("m._u"), F.col("su"))
    return out.select(
        "app_id", "cluster", "size", "distinct_prompts", system.alias("system_template"),
        F.when(F.col("any_user") & (F.size(user) > 0), F.concat(system, F.array(F.lit(USER_MARKER)), user)).otherwise(system).alias("template"),
        F.col("m.tools").alias("tools"), F.col("m.shape").alias("shape"), F.col("m.request_id").alias("medoid"),
        F.coalesce("sp_rest", F.lit(0).cast("long")).alias("dynamic_lines"),
    )


def node_ids(found: DataFrame) -> DataFrame:
    """found with node_id: app and a hash of the system template, tools and shape; equal ids of an app are numbered by size."""
    text = F.concat_ws(" ", F.array_join("system_template", "\n"), F.array_join("tools", ","), F.coalesce("shape", F.lit("")))
    base = F.concat("app_id", F.lit(":"), F.substring(F.md5(text), 1, 12))
    n = F.row_number().over(Window.partitionBy("_base").orderBy(F.col("size").desc(), "cluster"))
    return found.withColumn("_base", base).withColumn("_n", n).withColumn("node_id", F.when(F.col("_n") > 1, F.concat("_base", F.lit("#"), F.col("_n").cast("string"))).otherwise(F.col("_base"))).drop("_base", "_n")


def adaptive_floor(n: Column, settings: Settings = Settings()) -> Column:
    """Calls that make a node in an app of n calls."""
    return F.greatest(F.lit(settings.node_floor), F.least(F.ceil(F.lit(settings.node_fraction) * n), F.lit(settings.node_floor_cap))).cast("long")


def verdict(template_lines: Column, ratio: Column, margin: Column, min_internal: Column, size: Column) -> tuple[Column, Column]:
    """(verdict, reasons) of a node's quality."""
    say = lambda when, text: F.when(when, text)
    arbitrary = (template_lines <= 2) | ((ratio > 0.95) & (size > 5))
    reasons = F.array_compact(F.array(
        say(template_lines <= 2, F.lit("template of two lines or fewer: almost no shared identity")),
        say((ratio > 0.95) & (size > 5), F.lit("nearly every call has its own prompt: the group may be arbitrary")),
        say(margin < 0.05, F.format_string("only %.3f lies between this node and the next", margin)),
        say(min_internal < 0.35, F.format_string("weakest internal link is %.2f: held together by a chain", min_internal)),
        say(size < 5, F.format_string("only %d calls", size)),
    ))
    return F.when(arbitrary, "suspect").when(F.size(reasons) > 0, "weak").otherwise("ok"), reasons


@dataclass
class Grouping:
    """nodes: one row for each callsite; membership: (app_id, request_id, cluster, node_id or null); residual clusters are nodes with is_node false.

    points: the distinct calls compared, each with its cluster and its first request.
    """

    nodes: DataFrame
    membership: DataFrame
    pairs: DataFrame
    ambiguous: DataFrame
    filtered: DataFrame
    points: DataFrame


def group(fp: DataFrame, settings: Settings = Settings()) -> Grouping:
    """Callsites of all apps from the calls' fingerprints."""
    filtered = cut(noise_filter(fp, settings))
    points, member = distinct_points(filtered)
    pairs = cut(pair_scores(points, settings))
    labels = cut(clusters(points, pairs, settings))
    membership = cut(member.join(labels.select("point", "cluster"), "point").select("app_id", "request_id", "pos", "cluster"))
    found = templates(filtered, membership, settings)
    apps = fp.groupBy("app_id").agg(F.count(F.lit(1)).alias("n"))
    found = node_ids(found).join(quality(points, labels, pairs).drop("app_id"), "cluster").join(apps, "app_id")
    ratio = F.col("distinct_prompts") / F.col("size")
    lines = F.size("template")
    judged, reasons = verdict(lines, ratio, F.col("margin"), F.col("min_internal"), F.col("size"))
    unlinked = F.split("cluster", "#")[F.size(F.split("cluster", "#")) - 1].cast("long") >= settings.linkage_points
    coherent = (lines >= 3) & (ratio <= 0.95) & (F.col("size") >= 3)
    large = F.col("size") >= adaptive_floor(F.col("n"), settings)
    found = found.withColumns({"distinct_ratio": ratio, "quality": F.when(unlinked, "suspect").otherwise(judged), "reasons": reasons, "is_node": large | coherent})
    confidence = F.when(~large, "small").when((F.col("size") >= 30) & (F.col("quality") == "ok"), "established").when(F.col("size") >= 8, "provisional").otherwise("weak")
    nodes = cut(found.withColumn("confidence", confidence))
    named = nodes.select("cluster", F.when(F.col("is_node"), F.col("node_id")).alias("node_id"))
    return Grouping(nodes, membership.join(named, "cluster", "left"), pairs, ambiguous_pairs(pairs, settings), filtered, points.withColumn("request_id", F.col("first.request_id")).join(labels.select("point", "cluster"), "point"))


def merge_nodes(membership: DataFrame, merges: DataFrame) -> DataFrame:
    """membership with the node ids of merges (keep, gone) rewritten; templates stay those of the kept node."""
    return membership.join(merges.select(F.col("gone").alias("node_id"), "keep"), "node_id", "left").withColumn("node_id", F.coalesce("keep", "node_id")).drop("keep")


def settle_merges(pairs: list[tuple[str, str]], sizes: dict[str, int]) -> dict[str, str]:
    """{gone: kept} of pairs judged to be one, in order: the larger stays (the left of equals) and grows; a pair with a node that is gone is passed over."""
    sizes, kept = dict(sizes), {}
    for left, right in pairs:
        if left not in sizes or right not in sizes or left == right:
            continue
        keep, gone = (left, right) if sizes[left] >= sizes[right] else (right, left)
        sizes[keep] += sizes.pop(gone)
        kept = {g: keep if k == gone else k for g, k in kept.items()} | {gone: keep}
    return kept


def merge_counts(nodes: DataFrame, merges: DataFrame) -> DataFrame:
    """nodes without those that merges (keep, gone) give up; calls and distinct prompts go to the kept node, whose template and quality stay as they are."""
    given = nodes.where("is_node").join(merges.select(F.col("gone").alias("node_id"), "keep"), "node_id").groupBy(F.col("keep").alias("node_id")).agg(F.sum("size").alias("_size"), F.sum("distinct_prompts").alias("_prompts"))
    out = nodes.join(merges.select(F.col("gone").alias("node_id")), "node_id", "left_anti").join(given, "node_id", "left")
    more = lambda c, by: F.col(c) + F.coalesce(by, F.lit(0).cast("long"))
    return out.withColumns({"size": more("size", "_size"), "distinct_prompts": more("distinct_prompts", "_prompts")}).drop("_size", "_prompts")


def promote(nodes: DataFrame, clusters_kept: DataFrame) -> DataFrame:
    """nodes with the named residual clusters made nodes of weak confidence."""
    named = clusters_kept.select("cluster", F.lit(True).alias("_up"))
    out = nodes.join(named, "cluster", "left").withColumn("confidence", F.when(F.col("_up"), "weak").otherwise(F.col("confidence")))
    return out.withColumn("is_node", F.col("is_node") | F.coalesce("_up", F.lit(False))).drop("_up")
