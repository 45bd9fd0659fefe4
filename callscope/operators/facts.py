"""Facts of single calls: size split, flags, and the rollup of an app."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.text import SYSTEM_ROLES, dumped_length, first_user_text, has_system, lines, of_roles, prompt_text, role_sequence, role_shape, tokens, user_template_text

#: Rules of the flags.
CACHE_MINIMUM = 1024
MANY_TOOLS = 15
SCHEMA_RATIO = 1.5
HISTORY_RATIO = 4
REPEATED_TOKENS = 50
#: The flags' texts, in order.
FLAGS = (
    "no cache hit on a prompt large enough to cache",
    "tool schemas outweigh the system prompt",
    "15 or more tools declared in one call",
    "duplicated lines within a single prompt",
    "history dominates the payload",
    "response truncated by max_tokens",
)
#: Fixed value: a line that is structure: bullet, number, heading, tag or table.
STRUCTURE = r"^\s*(?:[-*+]|\d+[.)]|#{1,6}\s|<[a-zA-Z_/]+>|\|)"


def _chars(texts: Column) -> Column:
    return F.aggregate(texts, F.lit(0).cast("long"), lambda n, t: n + F.length(t))


def call_facts(calls: DataFrame) -> DataFrame:
    """One flat row for each call: sizes by part in estimated tokens, counts, shares and flags."""
    messages = F.col("messages")
    system = _chars(of_roles(messages, *SYSTEM_ROLES))
    user = _chars(of_roles(messages, "user"))
    other = F.filter(messages, lambda m: ~m["role"].isin(*SYSTEM_ROLES, "user"))
    # A message's tool calls count as their whole JSON, arguments included; none, or an empty list, has two characters.
    whole = "calls_json" in calls.schema["messages"].dataType.elementType.fieldNames()
    called = lambda m: dumped_length(F.when(m["calls_json"].isin("null", "false", "0", '""', "{}"), None).otherwise(m["calls_json"]) if whole else F.to_json(m["tool_calls"]))
    history = F.aggregate(other, F.lit(0).cast("long"), lambda n, m: n + F.length(F.coalesce(m["content"], F.lit(""))) + F.coalesce(F.greatest(F.lit(2), called(m)), F.lit(2)))
    schema = F.aggregate("tools", F.lit(0).cast("long"), lambda n, t: n + F.length(F.coalesce(t["schema_json"], F.lit(""))))
    prose = F.concat(lines(F.array_join(of_roles(messages, *SYSTEM_ROLES), "\n")), lines(F.array_join(of_roles(messages, "user"), "\n")))
    df = calls.withColumns({
        "n_messages": F.size(messages), "n_tools": F.size("tools"), "role_shape": role_shape(role_sequence(messages)),
        "system_tokens": tokens(system), "user_tokens": tokens(user), "history_tokens": tokens(history), "schema_tokens": tokens(schema),
        "history_depth": F.size(other),
        "tool_names": F.array_sort(F.transform("tools", lambda t: F.coalesce(t["name"], F.lit("")))),
        "tools_called": F.size("response_tool_calls"),
        "cache_hit_ratio": F.when(F.col("prompt_tokens") > 0, F.round(F.col("cached_tokens") / F.col("prompt_tokens"), 4)),
        "_lines": prose,
    })
    n = F.size("_lines")
    repeated = _chars(F.col("_lines")) - _chars(F.array_distinct("_lines"))
    df = df.withColumns({
        "n_lines": n,
        "longest_line": F.coalesce(F.array_max(F.transform("_lines", F.length)), F.lit(0)),
        "prose_share": F.when(n > 0, F.round(1 - F.size(F.filter("_lines", lambda x: x.rlike(STRUCTURE))) / n, 3)).otherwise(F.lit(0.0)),
        "repeated_tokens": tokens(repeated),
        "prompt_tokens_used": F.coalesce(F.when(F.col("prompt_tokens") != 0, F.col("prompt_tokens")), tokens(system + user + history + schema)),
    })
    flag = lambda when, name: F.when(when, F.lit(name))
    one = F.lit(1).cast("long")
    flags = F.array_compact(F.array(
        flag((F.col("cached_tokens") == 0) & (F.col("prompt_tokens") >= CACHE_MINIMUM), FLAGS[0]),
        flag((F.col("n_tools") > 0) & (F.col("schema_tokens") > SCHEMA_RATIO * F.greatest("system_tokens", one)), FLAGS[1]),
        flag(F.col("n_tools") >= MANY_TOOLS, FLAGS[2]),
        flag(F.col("repeated_tokens") > REPEATED_TOKENS, FLAGS[3]),
        flag(F.col("history_tokens") > HISTORY_RATIO * F.greatest(F.col("system_tokens") + F.col("user_tokens"), one), FLAGS[4]),
        flag(F.col("finish_reason") == "length", FLAGS[5]),
    ))
    return df.withColumn("flags", flags).drop("_lines", "messages", "tools")


def app_rollup(facts: DataFrame) -> DataFrame:
    """One row for each app: call and token sums, means, and the flags with their counts, most frequent first."""
    counted = facts.select("app_id", F.explode("flags").alias("flag")).groupBy("app_id", "flag").count()
    flags = counted.groupBy("app_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "flag"))), lambda x: F.concat(x["flag"], F.lit(": "), (-x["n"]).cast("string"))).alias("flags"))
    sums = facts.groupBy("app_id").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens_used").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cached_tokens").alias("cached_tokens"),
        F.avg("cache_hit_ratio").alias("mean_hit_ratio"), F.count_if(F.col("cached_tokens") == 0).alias("zero_cache_calls"),
        F.avg("n_tools").alias("mean_tools"), F.avg("history_depth").alias("mean_history"),
        F.sum("system_tokens").alias("system_tokens"), F.sum("user_tokens").alias("user_tokens"), F.sum("history_tokens").alias("history_tokens"), F.sum("schema_tokens").alias("schema_tokens"),
    )
    return sums.join(flags, "app_id", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))


def fingerprints(calls: DataFrame) -> DataFrame:
    """The identity views of every call, with its position in the app's log."""
    messages = F.col("messages")
    names = F.array_sort(F.array_distinct(F.filter(F.transform("tools", lambda t: t["name"]), lambda n: n.isNotNull() & (n != ""))))
    position = F.row_number().over(Window.partitionBy("app_id").orderBy("ts", "request_id")) - 1
    return calls.select(
        "app_id", "request_id", "ts", position.alias("pos"),
        lines(prompt_text(messages)).alias("ordered_lines"), lines(user_template_text(messages)).alias("ordered_user_lines"),
        names.alias("tools"), role_shape(role_sequence(messages)).alias("shape"), "response_format",
        has_system(messages).alias("has_system"), first_user_text(messages).alias("first_user_text"),
    ).withColumns({"prompt_lines": F.array_distinct("ordered_lines"), "user_lines": F.array_distinct("ordered_user_lines")})
