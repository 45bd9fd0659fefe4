"""Known callsites of requests, for scoring a profile against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(truth, ambiguous) as scoring.truth_scores takes them: (request_id, callsite) and (request_id).

    .json: one object with `callsite_of` (request id to callsite) and perhaps `ambiguous` (request ids).
    .csv: the columns request_id and gt_callsite; nothing is ambiguous. Rows without an id or a callsite are left out;
    of a repeated id the least callsite counts.
    """
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "callsite_of map<string,string>, ambiguous array<string>").alias("t"))
        rows = whole.select(F.explode("t.callsite_of").alias("request_id", "callsite"))
        unsure = whole.select(F.explode(F.array_distinct("t.ambiguous")).alias("request_id"))
    else:
        table = spark.read.csv(path, header=True, multiLine=True, escape='"')
        rows = table.select("request_id", F.col("gt_callsite").alias("callsite"))
        unsure = rows.select("request_id").limit(0)
    kept = rows.where(F.col("request_id").isNotNull() & F.col("callsite").isNotNull()).groupBy("request_id").agg(F.min("callsite").alias("callsite"))
    return kept, unsure.where(F.col("request_id").isNotNull())
