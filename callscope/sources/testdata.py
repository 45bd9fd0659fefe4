"""Calls and prompts from the driver's tables, for running the operators without a gateway export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call for each user turn of `conversations`; its messages are all turns up to it, so history is replayed.

    Columns as sources.gateway gives them, as far as the table has them.
    """
    turns = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    history = F.collect_list(F.struct("role", F.col("text").alias("content"), F.array().cast("array<string>").alias("tool_calls"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    reply = F.when(F.lead("role").over(order) == "assistant", F.lead("text").over(order))
    turns = turns.withColumns({"messages": history, "response_text": reply}).where(F.col("role") == "user")
    seconds = (F.col("conv_id") * 3600 + F.col("turn") * 10).cast("long")
    return turns.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("request_id"),
        F.concat(F.lit("app_"), (F.col("conv_id") % 5).cast("string")).alias("app_id"),
        F.timestamp_seconds(F.lit(1704067200) + seconds).cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("model_"), (F.col("conv_id") % 3).cast("string")).alias("model"),
        "messages",
        F.array().cast("array<struct<name:string,description:string,schema_json:string>>").alias("tools"),
        "response_text",
        F.array().cast("array<string>").alias("response_tool_calls"),
        F.lit("stop").alias("finish_reason"),
        F.lit(None).cast("long").alias("prompt_tokens"),
        F.lit(None).cast("long").alias("completion_tokens"),
        F.lit(None).cast("long").alias("cached_tokens"),
        F.lit(None).cast("string").alias("response_format"),
    )


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call for each row of `events`, with tools, a template for each type, a line of its own, and known sizes."""
    kind, text = F.col("event_type"), lambda c: F.col(c).cast("string")
    system = F.array(*map(F.lit, ("Answer with one JSON object.", "Stay brief.", "Never guess.")), F.concat(F.lit("You handle "), kind, F.lit(" events.")), *(F.concat(F.lit(f"Rule {k} of "), kind, F.lit(".")) for k in (1, 2, 3)), F.concat(F.lit("Trace "), text("event_id")))
    user = F.array(F.concat(F.lit("Kind: "), kind), F.concat(F.lit("Locale: "), (F.col("user_id") % 3).cast("string")), F.col("props"))
    message = lambda role, lines: F.struct(F.lit(role).alias("role"), F.array_join(lines, "\n").alias("content"), F.array().cast("array<string>").alias("tool_calls"))
    names = F.array_compact(F.array(F.concat(F.lit("find_"), kind), F.concat(F.lit("read_"), kind), F.when(F.col("user_id") % 2 == 0, "audit")))
    tool = lambda n: F.struct(n.alias("name"), F.lit("").alias("description"), F.concat(F.lit('{"function":{"name":"'), n, F.lit('"}}')).alias("schema_json"))
    never = F.lit(None).cast("string")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), text("event_id")).alias("request_id"), F.concat(F.lit("svc_"), (F.col("user_id") % 4).cast("string")).alias("app_id"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("model_"), (F.col("event_id") % 2).cast("string")).alias("model"), F.array(message("system", system), message("user", user)).alias("messages"), F.transform(names, tool).alias("tools"),
        F.lit("done").alias("response_text"), F.when(F.col("event_id") % 3 == 0, F.array(F.concat(F.lit("find_"), kind))).otherwise(F.array().cast("array<string>")).alias("response_tool_calls"),
        F.when(F.col("event_id") % 10 == 0, "length").when(F.col("event_id") % 7 != 0, "stop").alias("finish_reason"),
        (1000 + F.col("event_id") % 200).alias("prompt_tokens"), F.floor("value").cast("long").alias("completion_tokens"), (F.col("event_id") % 5 * 100).alias("cached_tokens"),
        F.when(F.col("user_id") % 5 == 0, "json_object").otherwise(never).alias("response_format"),
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app_id, request_id, text) of documents: one prompt each, its source as the app."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("app_id"), F.col("doc_id").alias("request_id"), "text")
