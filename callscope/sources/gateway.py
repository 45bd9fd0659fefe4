"""Gateway exports: CSV or Parquet rows of request and response JSON, validated into calls.

Counters go to the first test that fails, in this order: call type, request JSON,
app id, messages. The order is one CASE, so a row is parsed once and dropped once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.functions.text import strip
from callscope.settings import Mapping, Settings

CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "mode": "DROPMALFORMED"}


def read_export(spark: SparkSession, path: str, mapping: Mapping = Mapping(), form: str = "csv") -> tuple[DataFrame, list[str]]:
    """(rows, missing columns) of an export, all columns as strings. Without a request or response column there is nothing to read.

    A multi-line CSV file is one task; rows are dealt anew behind it. Parquet needs no such step and suits large exports.
    """
    raw = spark.read.options(**CSV_OPTIONS).csv(path) if form == "csv" else spark.read.parquet(path)
    for column in (mapping.request, mapping.response):
        if column not in raw.columns:
            raise ValueError(f"the export has no column {column}")
    needed = mapping.needed()
    missing = [c for c in needed if c not in raw.columns]
    rows = raw.select(*(F.col(c).cast("string").alias(c) for c in needed if c in raw.columns), *(F.lit(None).cast("string").alias(c) for c in missing))
    return (rows.repartition(spark.sparkContext.defaultParallelism) if form == "csv" else rows), missing


def _is(kind: str, v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def json_object(text: Column) -> Column:
    """Variant of a JSON object, or null for anything else."""
    parsed = F.try_parse_json(text)
    return F.when(_is("OBJECT", parsed), parsed)


def _string(v: Column, path: str) -> Column:
    """A non-blank string at a path, stripped; numbers and objects do not count."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.nullif(strip(F.try_variant_get(v, path, "string")), F.lit("")))


def app_ids(mapping: Mapping) -> Column:
    """The app id at each of the mapping's paths."""

    def one(path: str) -> Column:
        head, *keys = path.split(".")
        if not keys:
            return F.nullif(strip(F.col(head)), F.lit(""))
        return _string(json_object(F.col(head)), "$" + "".join(f"['{k}']" for k in keys))

    return F.array(*(one(p) for p in mapping.app_id_paths))


def validate(rows: DataFrame, mapping: Mapping = Mapping()) -> DataFrame:
    """rows with status (`loaded`, or why not), the parsed request and response, and the app ids."""
    kind = F.trim(F.coalesce(F.col(mapping.call_type), F.lit("")))
    chat = (kind == "") | kind.isin(*mapping.chat_types) if mapping.chat_types else F.lit(True)  # no types: nothing is filtered
    df = rows.withColumn("_request", F.when(chat, json_object(F.col(mapping.request)))).withColumn("_response", json_object(F.col(mapping.response)))
    df = df.withColumn("_ids", app_ids(mapping)).withColumn("_id_values", F.array_distinct(F.array_compact("_ids")))
    messages = F.try_variant_get("_request", "$.messages", "array<variant>")
    df = df.withColumn("_messages", messages)
    status = (
        F.when(~chat, "non_chat").when(F.col("_request").isNull(), "unparseable").when(F.size("_id_values") == 0, "no_app_id")
        .when(F.coalesce(F.size("_messages"), F.lit(0)) <= 0, "no_messages").otherwise("loaded")
    )
    return df.withColumn("status", status)


def load_report(checked: DataFrame, mapping: Mapping = Mapping()) -> DataFrame:
    """One row of counters. Disagreement and source counters include rows that are dropped for having no messages."""
    has_id = F.col("status").isin("loaded", "no_messages")
    parsed = has_id | (F.col("status") == "no_app_id")
    first = reduce(lambda out, k: F.when(F.col("_ids")[k].isNotNull(), mapping.app_id_paths[k]).otherwise(out), reversed(range(len(mapping.app_id_paths))), F.lit(None).cast("string"))
    usage = F.try_variant_get("_response", "$.usage", "variant")
    return checked.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("status") == "loaded").alias("loaded"),
        *(F.count_if(F.col("status") == s).alias(f"skipped_{s}") for s in ("non_chat", "unparseable", "no_app_id", "no_messages")),
        F.count_if(parsed & (F.size("_id_values") > 1)).alias("app_id_disagreements"),
        *(F.count_if(has_id & (first == p)).alias(f"from_{k}") for k, p in enumerate(mapping.app_id_paths)),
        F.count_if((F.col("status") == "loaded") & (F.coalesce(F.trim(F.col(mapping.request_id)), F.lit("")) == "")).alias("synthesised_ids"),
        F.count_if((F.col("status") == "loaded") & (usage.isNull() | ~_is("OBJECT", usage) | (F.to_json(usage) == "{}"))).alias("missing_usage"),
    )


def calls(checked: DataFrame, mapping: Mapping = Mapping(), settings: Settings = Settings()) -> DataFrame:
    """Valid rows as calls, at most rows_per_app of the earliest of an app; repeated request ids keep their first row."""
    own = checked.where("status = 'loaded'")
    objects = lambda v: F.filter(v, lambda x: _is("OBJECT", x))
    get = lambda v, path, t="string": F.try_variant_get(v, path, t)
    content = lambda m: F.when(F.schema_of_variant(get(m, "$.content", "variant")) == "STRING", get(m, "$.content")).when(get(m, "$.content", "variant").isNull() | F.is_variant_null(get(m, "$.content", "variant")), "").otherwise(F.to_json(get(m, "$.content", "variant")))
    called = lambda m: F.transform(F.coalesce(objects(get(m, "$.tool_calls", "array<variant>")), F.array().cast("array<variant>")), lambda t: F.coalesce(get(t, "$.function.name"), F.lit("")))
    message = lambda m: F.struct(F.coalesce(get(m, "$.role"), F.lit("")).alias("role"), content(m).alias("content"), called(m).alias("tool_calls"), F.to_json(get(m, "$.tool_calls", "variant")).alias("calls_json"))
    tool = lambda t: F.struct(F.coalesce(get(t, "$.function.name"), F.lit("")).alias("name"), F.coalesce(get(t, "$.function.description"), F.lit("")).alias("description"), F.to_json(t).alias("schema_json"))
    reply = get("_response", "$.choices[0].message", "variant")
    ts = F.coalesce(F.expr(f"try_cast(`{mapping.timestamp}` AS timestamp_ntz)"), F.expr("TIMESTAMP_NTZ'0001-01-01 00:00:00'"))
    app = F.element_at(F.array_compact("_ids"), 1)
    made = F.concat(F.lit("synth-"), F.substring(F.md5(F.concat_ws("|", app, F.col(mapping.timestamp), F.col(mapping.request))), 1, 16))
    nothing = F.array().cast("array<variant>")
    out = own.select(
        F.coalesce(F.nullif(F.trim(F.col(mapping.request_id)), F.lit("")), made).alias("request_id"), app.alias("app_id"), ts.alias("ts"),
        F.coalesce(F.nullif(F.trim(F.col(mapping.model)), F.lit("")), get("_request", "$.model"), F.lit("unknown")).alias("model"),
        F.transform(objects(F.col("_messages")), message).alias("messages"),
        F.transform(objects(F.coalesce(get("_request", "$.tools", "array<variant>"), nothing)), tool).alias("tools"),
        content_of(reply).alias("response_text"), called(reply).alias("response_tool_calls"), get("_response", "$.choices[0].finish_reason").alias("finish_reason"),
        get("_response", "$.usage.prompt_tokens", "long").alias("prompt_tokens"), get("_response", "$.usage.completion_tokens", "long").alias("completion_tokens"),
        get("_response", "$.usage.prompt_tokens_details.cached_tokens", "long").alias("cached_tokens"), get("_request", "$.response_format.type").alias("response_format"),
        F.col(mapping.request).alias("request_json"), F.col(mapping.response).alias("response_json"),
    )
    once = F.row_number().over(Window.partitionBy("app_id", "request_id").orderBy("ts", "request_json"))
    out = out.withColumn("_n", once).where("_n = 1").drop("_n")
    return cap(out, ["app_id"], ["ts", "request_id"], settings.rows_per_app)


def content_of(message: Column) -> Column:
    return F.try_variant_get(message, "$.content", "string")


def cap(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key (the loader's own limit, or a stratified sample)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def systematic_sample(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """k rows of each key, spread evenly: every step-th, step = max(1, n // k)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    step = F.greatest(F.lit(1), F.floor(F.col("_size") / k))
    out = df.withColumn("_n", place).join(sizes, keys).where((F.col("_n") % step == 0) & (F.floor(F.col("_n") / step) < k))
    return out.drop("_n", "_size")


def capped_apps(checked: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(app_id, rows) of the apps that have more valid rows than are kept."""
    return checked.where("status = 'loaded'").groupBy(F.element_at(F.array_compact("_ids"), 1).alias("app_id")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > settings.rows_per_app)
