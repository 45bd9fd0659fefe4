"""Cache, tool and region metrics of callsites, and the findings drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.text import SYSTEM_ROLES, common_prefix_length, counted_ranks, of_roles, rank_at, spaced_json, tokens
from callscope.operators.segment import line_split, segmentation
from callscope.settings import Settings

REGIONS = ("instructions", "the user turn", "conversation history", "tool schemas")


def request_document(messages: Column, tools: Column) -> Column:
    """A whole request as one text: its tools, then every message, in wire order."""
    # Of a tool's JSON only its parameters, whose names a variant keeps sorted.
    given = lambda t: F.try_variant_get(F.try_parse_json(t["schema_json"]), "$.function.parameters", "variant")
    parameters = lambda t: F.when(~F.to_json(given(t)).isin("null", "{}", "[]", '""', "0", "false"), spaced_json(F.to_json(given(t))))
    tool = F.transform(tools, lambda t: F.concat_ws("\n", F.concat(F.lit("TOOL "), F.coalesce(t["name"], F.lit("")), F.lit(": "), F.coalesce(t["description"], F.lit(""))), parameters(t)))
    turn = F.transform(messages, lambda m: F.concat(F.lit("["), F.coalesce(m["role"], F.lit("")), F.lit("] "), F.coalesce(m["content"], F.lit(""))))
    return F.array_join(F.concat(tool, turn), "\n")


def prose_document(messages: Column) -> Column:
    return F.array_join(of_roles(messages, *SYSTEM_ROLES, "user"), "\n")


def region_texts(calls: DataFrame, *keep: str) -> DataFrame:
    """(keep, region, text): the four regions of every call, long form; empty ones too."""
    messages = F.col("messages")
    texts = [
        F.array_join(of_roles(messages, *SYSTEM_ROLES), "\n"), F.array_join(of_roles(messages, "user"), "\n"), F.array_join(of_roles(messages, "assistant", "tool"), "\n"),
        F.array_join(F.transform("tools", lambda t: F.coalesce(t["schema_json"], F.lit(""))), "\n"),
    ]
    return calls.select(*keep, F.explode(F.array(*(F.struct(F.lit(n).alias("region"), t.alias("text")) for n, t in zip(REGIONS, texts)))).alias("r")).select(*keep, "r.*")


def cache_prefix(documents: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, calls, prefix_chars, cacheable_now, avg_request_tokens): what all documents of a group begin with.

    The least and the greatest document bound the set, so this is a partial aggregate however large a group is.
    """
    out = documents.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.min(text).alias("_low"), F.max(text).alias("_high"), F.sum(F.length(text)).alias("_chars"))
    prefix = common_prefix_length(F.col("_low"), F.col("_high"))
    return out.withColumn("prefix_chars", prefix).select(*keys, "calls", "prefix_chars", tokens(F.col("prefix_chars")).alias("cacheable_now"), tokens(F.floor(F.col("_chars") / F.col("calls"))).alias("avg_request_tokens"))


def node_metrics(calls: DataFrame, key: str = "node_id", settings: Settings = Settings()) -> DataFrame:
    """One row for each node: cache prefix, what reordering would recover, tools declared and never called, reported cache."""
    whole = calls.select(key, "request_id", "ts", request_document(F.col("messages"), F.col("tools")).alias("text"))
    prefix = cache_prefix(whole, [key])
    prose = calls.select(key, F.struct("ts", "request_id").alias("pos"), prose_document(F.col("messages")).alias("text"))
    seg = segmentation(prose.withColumn("pos", F.unix_micros(F.col("pos.ts").cast("timestamp"))), [key])
    names = F.array_sort(F.array_distinct(F.transform("tools", lambda t: F.coalesce(t["name"], F.lit("")))))
    schema = F.aggregate("tools", F.lit(0).cast("long"), lambda n, t: n + F.length(F.coalesce(t["schema_json"], F.lit(""))))
    facts = calls.select(key, names.alias("names"), schema.alias("schema"), "response_tool_calls", "cached_tokens", F.size("messages").alias("n_messages"), "model", "finish_reason")
    sums = facts.groupBy(key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("declared"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("response_tool_calls")))).alias("called"),
        F.count_distinct("names").alias("distinct_tool_sets"), tokens(F.floor(F.avg("schema"))).alias("tool_schema_tokens"), F.round(F.avg("cached_tokens"), 1).alias("reported_cached_mean"),
        F.avg("n_messages").alias("avg_messages"), F.count_if(F.col("finish_reason") == "length").alias("truncated"), F.array_sort(F.collect_set("model")).alias("models"),
    )
    out = prefix.join(sums, key).join(seg, key)
    joined = F.length(F.array_join("static_lines", "\n"))
    possible = tokens(joined) + F.when(F.col("distinct_tool_sets") == 1, F.col("tool_schema_tokens")).otherwise(0)
    out = out.withColumns({
        "recoverable": F.greatest(F.lit(0).cast("long"), possible - F.col("cacheable_now")),
        "tools_never_called": F.array_except("declared", "called"), "tools_declared": F.size("declared"),
        "static_share": F.round(F.try_divide(F.col("static_chars"), F.col("static_chars") + F.col("dynamic_chars")), 4),
    })
    return out.withColumn("wasted_tokens", F.col("recoverable") * F.col("calls")).withColumn("findings", findings(settings))


def findings(settings: Settings = Settings()) -> Column:
    """The statements that a node's metrics support, in a fixed order."""
    c = F.col
    per_call = c("dynamic_chars") / F.greatest(c("calls"), F.lit(1))
    least = F.lit(settings.cache_minimum)
    say = lambda when, text, *values: F.when(when, F.format_string(text, *values) if values else F.lit(text))
    return F.array_compact(F.array(
        say((c("recoverable") > 50) & (c("cacheable_now") < c("avg_request_tokens") * 0.25), "cache: varying text precedes stable text; %d more tokens a call could be cached, %d in all", c("recoverable"), c("wasted_tokens")),
        say(c("cacheable_now") >= least, "cache: the stable prefix of %d tokens reaches the minimum", c("cacheable_now")),
        say((c("cacheable_now") < least) & (c("cacheable_now") + c("recoverable") >= least), "cache: reordering would lift the prefix of %d tokens to the minimum", c("cacheable_now")),
        say((c("reported_cached_mean") == 0) & (c("cacheable_now") >= least), "cache: the provider reports no cached token for a prefix long enough"),
        say(F.size("tools_never_called") > 0, "tools: %d of %d are never called (%s)", F.size("tools_never_called"), c("tools_declared"), F.array_join(F.slice("tools_never_called", 1, 5), ", ")),
        say(c("distinct_tool_sets") > 1, "tools: %d different lists, each breaks the prefix", c("distinct_tool_sets")),
        say(c("truncated") > 0, "responses: %d of %d stop at the token limit", c("truncated"), c("calls")),
        say(F.size("models") > 1, "models: %d different ones (%s)", F.size("models"), F.array_join(F.slice("models", 1, 4), ", ")),
        say(c("avg_messages") > 20, "history: %.0f messages a call", c("avg_messages")),
        say((c("static_chars") > 0) & (per_call > 1.5 * c("static_chars")), "payload: varying text outweighs the template in each call"),
    ))


def region_anatomy(calls: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, region, mean_tokens, share, p10, p90, static_share, varies) of the regions that hold anything."""
    regions = region_texts(calls, *keys).withColumn("t", tokens(F.length("text")))
    sizes = regions.groupBy(*keys, "region").agg(F.floor(F.avg("t")).cast("long").alias("mean_tokens")).where(F.col("mean_tokens") >= 1)
    sizes = sizes.join(counted_ranks(regions, [*keys, "region"], "t", {"p10": rank_at(0.10), "p90": rank_at(0.90)}), [*keys, "region"])
    total = sizes.groupBy(*keys).agg(F.sum("mean_tokens").alias("_total"))
    split = line_split(regions, [*keys, "region"])
    chars = split.groupBy(*keys, "region").agg(
        F.sum(F.when(F.col("kind") == "static", F.length("line")).otherwise(0)).alias("_s"),
        F.sum(F.when(F.col("kind") == "dynamic", F.length("line") * F.col("doc_frequency")).otherwise(0)).alias("_d"), F.max("calls").alias("_n"),
    )
    out = sizes.join(total, keys).join(chars, [*keys, "region"], "left")
    share = F.round(F.coalesce(F.try_divide(F.col("_s"), F.col("_s") + F.col("_d") / F.col("_n")), F.lit(0.0)), 4)
    out = out.withColumns({"share": F.round(F.col("mean_tokens") / F.col("_total"), 4), "static_share": share})
    varies = (F.col("static_share") < 0.9) | (F.col("p90") > F.greatest(1.15 * F.col("p10"), F.col("p10") + 20))
    return out.withColumn("varies", varies).select(*keys, "region", "mean_tokens", "share", "p10", "p90", "static_share", "varies")


def payload_spread(splits: DataFrame, keys: list[str]) -> DataFrame:
    """Least, upper median and greatest dynamic tokens of a group, flagged if they differ tenfold."""
    places = {"least": lambda n: F.lit(0), "median": lambda n: F.floor(n / 2), "most": lambda n: n - 1}
    out = counted_ranks(splits, keys, "dynamic_tokens", places)
    return out.withColumn("wide", F.col("most") >= 10 * F.greatest(F.col("least"), F.lit(1)))


def _counts(calls: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """(keys, name): a group's values with their counts, the most frequent first."""
    counted = calls.groupBy(*keys, value.alias("value")).agg(F.count(F.lit(1)).alias("calls"))
    rows = F.sort_array(F.collect_list(F.struct((-F.col("calls")).alias("n"), "value")))
    return counted.groupBy(*keys).agg(F.transform(rows, lambda x: F.struct(x["value"].alias("value"), (-x["n"]).alias("calls"))).alias(name))


def response_anatomy(calls: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, calls, completion_p50, completion_p95, models, finish_reasons, truncated, tool_call_rate): what a group's calls come back with.

    Percentiles are of the known completion sizes, 0 if none is known. A call without a finish reason counts as `unknown`.
    """
    sums = calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("finish_reason") == "length").alias("truncated"),
        F.round(F.avg((F.size("response_tool_calls") > 0).cast("int")), 3).alias("tool_call_rate"),
    )
    sizes = counted_ranks(calls, keys, "completion_tokens", {"completion_p50": rank_at(0.50), "completion_p95": rank_at(0.95)})
    reason = F.coalesce(F.when(F.col("finish_reason") != "", F.col("finish_reason")), F.lit("unknown"))
    out = sums.join(sizes, keys, "left").join(_counts(calls, keys, F.col("model"), "models"), keys).join(_counts(calls, keys, reason, "finish_reasons"), keys)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select(*keys, "calls", zero("completion_p50"), zero("completion_p95"), "models", "finish_reasons", "truncated", "tool_call_rate")


#: Fixed value: regions with fewer tokens are left out of a description.
DESCRIBED_TOKENS = 5


def describe(regions: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, description): one sentence from region_anatomy and response_anatomy; at most four regions a group."""
    told = regions.where(F.col("mean_tokens") >= DESCRIBED_TOKENS)
    amount = F.format_string("%,d tokens of %s", "mean_tokens", "region")
    new = F.when(F.col("static_share") < 1, F.format_string(" (%.0f%% new each time)", 100 * (1 - F.col("static_share")))).otherwise("")
    # In the order a request is written, and the same in every run.
    part = F.struct(F.array_position(F.array(*map(F.lit, REGIONS)), F.col("region")).alias("n"), F.when(F.col("varies"), F.concat(amount, new)).otherwise(amount).alias("text"))
    pick = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, part))), lambda x: x["text"]), ", ")
    sent = told.groupBy(*keys).agg(pick(~F.col("varies")).alias("held"), pick(F.col("varies")).alias("moves"))
    out = responses.join(sent, keys, "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("held", "moves")})
    held, moves = F.col("held") != "", F.col("moves") != ""
    p50, p95 = F.col("completion_p50"), F.col("completion_p95")
    words = F.array_compact(F.array(
        F.when(held, F.format_string("sends %s, the same in every call", "held")),
        F.when(moves, F.concat(F.when(held, "plus ").otherwise("sends "), F.format_string("%s, which change", "moves"))),
        F.when(~held & ~moves, F.lit("sends a small request that is always alike")),
        F.concat(F.format_string("is answered in about %,d tokens", p50), F.when(p95 > 2 * p50, F.format_string(" (p95 %,d)", p95)).otherwise("")),
        F.when(F.col("tool_call_rate") > 0, F.format_string("calls a tool in %.0f%% of its calls", 100 * F.col("tool_call_rate"))),
        F.when(F.col("truncated") > 0, F.format_string("%d of %d answers stop at the token limit", "truncated", "calls")),
        F.when(F.size("models") > 1, F.format_string("is spread over %d models", F.size("models"))),
    ))
    return out.select(*keys, F.concat(F.lit("This callsite "), F.array_join(words, "; "), F.lit(".")).alias("description"))
