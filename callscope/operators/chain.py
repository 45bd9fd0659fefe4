"""Agent runs from replayed message history: prefix and retry links, forest roots, run rollups, verdicts.

A call's key is the hash of its messages; a prefix of a call's messages that is an
earlier call's whole key makes that call its parent. Keys are running hashes, so a
history of n messages costs n rows and no repeated text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.text import SYSTEM_ROLES
from callscope.runtime import cut
from callscope.settings import Settings


def message_hash(m: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(m["role"], F.lit("")), F.coalesce(m["content"], F.lit("")), F.array_join(F.coalesce(m["tool_calls"], F.array().cast("array<string>")), ",")))


#: What a provider counts for a call.
COUNTED = ("prompt_tokens", "completion_tokens", "cached_tokens")


def requests(calls: DataFrame, relaxed: bool = False) -> DataFrame:
    """(app_id, request_id, ts, pos, n_messages, COUNTED, prefixes, key): running keys of a call's messages, the last one its own.

    relaxed: without a leading system message. pos orders an app's calls by time; it is the row's own, so no app is ranked in one task.
    """
    hashes = F.transform("messages", message_hash)
    if relaxed:
        lead = F.try_element_at("messages", F.lit(1))["role"].isin(*SYSTEM_ROLES)
        hashes = F.when(lead, F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0)))).otherwise(hashes)
    start = F.struct(F.lit("").alias("key"), F.array().cast("array<string>").alias("all"))
    step = lambda acc, h: F.struct(F.md5(F.concat(acc["key"], h)).alias("key"), F.concat(acc["all"], F.array(F.md5(F.concat(acc["key"], h)))).alias("all"))
    counted = (F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNTED)
    return calls.select("app_id", "request_id", "ts", F.struct("ts", "request_id").alias("pos"), F.size("messages").alias("n_messages"), *counted, F.aggregate(hashes, start, step, lambda acc: acc["all"]).alias("prefixes")).withColumn("key", F.try_element_at("prefixes", F.lit(-1)))


def seconds(later: str, earlier: str) -> Column:
    return (F.unix_micros(F.col(later).cast("timestamp")) - F.unix_micros(F.col(earlier).cast("timestamp"))) / 1e6


def retry_links(reqs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(app_id, request_id, parent): the latest earlier call with the same key, at most retry_seconds ago."""
    order = Window.partitionBy("app_id", "key").orderBy("pos")
    found = reqs.where(F.col("key").isNotNull()).select("app_id", "request_id", "ts", F.lag("request_id").over(order).alias("parent"), F.lag("ts").over(order).alias("before"))
    return found.where(F.col("parent").isNotNull() & (seconds("ts", "before") <= settings.retry_seconds)).select("app_id", "request_id", "parent")


def prefix_links(reqs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(app_id, request_id, parent): of the earlier calls whose whole key is a proper prefix of this one, at most link_seconds ago, the latest."""
    own = F.explode(F.slice("prefixes", 1, F.greatest(F.size("prefixes") - 1, F.lit(0))))
    none, ts, pos = F.lit(None), reqs.schema["ts"].dataType, reqs.schema["pos"].dataType
    child = reqs.select("app_id", "request_id", "ts", "pos", own.alias("key"), none.cast("string").alias("parent"), none.cast(ts).alias("before"), none.cast(pos).alias("parent_pos"))
    parent = reqs.where(F.col("key").isNotNull()).select("app_id", none.cast("string").alias("request_id"), "ts", "pos", "key", F.col("request_id").alias("parent"), F.col("ts").alias("before"), F.col("pos").alias("parent_pos"))
    # Times never fall along `pos`, so of a key's earlier calls the last is in time if any is: one pass along the key, no join of all with all.
    held = Window.partitionBy("app_id", "key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    both = child.unionByName(parent).withColumns({c: F.last(c, ignorenulls=True).over(held) for c in ("parent", "before", "parent_pos")})
    found = both.where(F.col("request_id").isNotNull() & F.col("parent").isNotNull() & (F.col("parent_pos") < F.col("pos")) & (seconds("ts", "before") <= settings.link_seconds))
    return found.groupBy("app_id", "request_id").agg(F.max_by("parent", "parent_pos").alias("parent"))


def links(reqs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(app_id, request_id, parent, retry) of the linked calls; a retry takes precedence."""
    retry = retry_links(reqs, settings).withColumn("retry", F.lit(True))
    prefix = prefix_links(reqs, settings).join(retry, ["app_id", "request_id"], "left_anti").withColumn("retry", F.lit(False))
    return retry.unionByName(prefix)


def forest(reqs: DataFrame, linked: DataFrame) -> DataFrame:
    """(app_id, request_id, root, step, retry): each call's run and its depth, by pointer doubling (rounds: log2 of the longest run)."""
    state = reqs.select("app_id", "request_id").join(linked, ["app_id", "request_id"], "left")
    state = state.select("app_id", "request_id", F.coalesce("parent", "request_id").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("step"), F.coalesce("retry", F.lit(False)).alias("retry"))
    state = cut(state)
    while True:
        up = state.select("app_id", F.col("request_id").alias("root"), F.col("root").alias("_root"), F.col("step").alias("_step"))
        moved = state.join(up, ["app_id", "root"]).select("app_id", "request_id", F.col("_root").alias("root"), (F.col("step") + F.col("_step")).alias("step"), "retry", (F.col("_step") > 0).alias("_moved"))
        moved = cut(moved)
        state = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return state


def runs(reqs: DataFrame, walked: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row for each run: its steps in order, retries, tokens, duration and path of node ids (`?` where a call has none)."""
    own = walked.join(reqs.select("app_id", "request_id", "ts", "pos", *COUNTED), ["app_id", "request_id"])
    own = own.join(labels.select("app_id", "request_id", "node_id"), ["app_id", "request_id"], "left") if labels is not None else own.withColumn("node_id", F.lit(None).cast("string"))
    row = F.struct("step", "pos", "request_id", F.coalesce("node_id", F.lit("?")).alias("node"), "ts")
    out = own.groupBy("app_id", F.col("root").alias("run_id")).agg(F.sort_array(F.collect_list(row)).alias("s"), F.count_if("retry").alias("retries"), *(F.sum(c).alias(c) for c in COUNTED))
    last = F.element_at("s", -1)["ts"]
    return out.select(
        "app_id", "run_id", F.size("s").cast("long").alias("steps"), "retries", *COUNTED, F.transform("s", lambda x: x["node"]).alias("path"), F.transform("s", lambda x: x["request_id"]).alias("requests"),
        ((F.unix_micros(last.cast("timestamp")) - F.unix_micros(F.element_at("s", 1)["ts"].cast("timestamp"))) / 1e6).alias("duration_s"),
    )


def chain_report(reqs: DataFrame, linked: DataFrame, run_rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each app: linked share, orphans among continuations, run lengths, and whether the runs can be trusted."""
    joined = reqs.join(linked.select("app_id", "request_id", F.lit(True).alias("_linked")), ["app_id", "request_id"], "left")
    longer = F.col("n_messages") >= settings.continuation
    per = joined.groupBy("app_id").agg(F.count(F.lit(1)).alias("requests"), F.count_if("_linked").alias("linked"), F.count_if(longer).alias("continuations"), F.count_if(longer & F.col("_linked").isNull()).alias("orphans"))
    lengths = run_rows.groupBy("app_id").agg(F.count(F.lit(1)).alias("runs"), F.avg("steps").alias("mean_steps"), F.max("steps").alias("max_steps"), F.sum("retries").alias("retries"), F.floor(F.avg(F.col("prompt_tokens") + F.col("completion_tokens"))).cast("long").alias("mean_run_tokens"))
    rate = F.coalesce(F.try_divide(F.col("orphans"), F.col("continuations")), F.lit(0.0))
    verdict = F.when(F.col("continuations") == 0, "single_step").when(rate > settings.orphan_alarm, "unusable").when(rate > settings.orphan_partial, "partial").otherwise("reliable")
    return per.join(lengths, "app_id").withColumns({"orphan_rate": F.round(rate, 4), "verdict": verdict})


def top_paths(run_rows: DataFrame, k: int = 5, hops: int = 6) -> DataFrame:
    """(app_id, path, runs): the k most frequent beginnings of runs with several steps."""
    counted = run_rows.where("steps > 1").groupBy("app_id", F.array_join(F.slice("path", 1, hops), " > ").alias("path")).agg(F.count(F.lit(1)).alias("runs"))
    place = F.row_number().over(Window.partitionBy("app_id").orderBy(F.col("runs").desc(), "path"))
    return counted.withColumn("_n", place).where(F.col("_n") <= k).drop("_n")


def longest_runs(run_rows: DataFrame, k: int = 3) -> DataFrame:
    """run_rows of each app's k longest runs; of equally long ones the least run_id."""
    place = F.row_number().over(Window.partitionBy("app_id").orderBy(F.col("steps").desc(), "run_id"))
    return run_rows.withColumn("_n", place).where(F.col("_n") <= k).drop("_n")


def reconstruct(calls: DataFrame, labels: DataFrame | None = None, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, runs, walked) of all apps. Each app uses strict keys, or relaxed ones if those link strictly more calls."""
    strict, loose = cut(requests(calls)), cut(requests(calls, relaxed=True))
    a, b = cut(links(strict, settings)), cut(links(loose, settings))
    more = b.groupBy("app_id").count().withColumnRenamed("count", "nb").join(a.groupBy("app_id").count().withColumnRenamed("count", "na"), "app_id", "left").where(F.col("nb") > F.coalesce("na", F.lit(0))).select("app_id")
    linked = cut(a.join(more, "app_id", "left_anti").unionByName(b.join(more, "app_id", "left_semi")))
    walked = cut(forest(strict, linked))
    run_rows = cut(runs(strict, walked, labels))
    mode = more.withColumn("mode", F.lit("relaxed"))
    report = chain_report(strict, linked, run_rows, settings).join(mode, "app_id", "left").withColumn("mode", F.coalesce("mode", F.lit("strict")))
    return report, run_rows, walked
