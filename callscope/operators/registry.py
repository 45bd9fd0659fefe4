"""Memory of callsites across exports: reconcile, versions, observations.

Pure functions from tables to tables. All exact matches come first, then fuzzy ones
on the rest, so that an edited callsite never claims an ancestor another one equals.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions.text import jaccard, line_delta
from callscope.runtime import cut
from callscope.settings import Settings

CALLSITES_DDL = "node_id string, app_id string, name string, purpose string, template array<string>, tools array<string>, shape string, first_seen string, last_seen string, runs_seen int, version int, calls_total long, last_verdict string"
OBSERVATIONS_DDL = "node_id string, run_id string, seen_at string, calls long, avg_tokens long, cacheable_now long, recoverable long, cached_mean double, verdict string"
VERSIONS_DDL = "node_id string, version int, changed_at string, prior_node_id string, similarity double, lines_added long, lines_removed long"


def template_similarity(a: Column, b: Column, tools_a: Column, tools_b: Column, shape_a: Column, shape_b: Column, settings: Settings = Settings()) -> Column:
    """Prompt .60, shape .15, tools .25 if either side has any; disjoint tools are capped."""
    any_tools = (F.size(tools_a) > 0) | (F.size(tools_b) > 0)
    t, w = jaccard(tools_a, tools_b), F.when(any_tools, 0.25).otherwise(0.0)
    score = (0.60 * jaccard(F.array_distinct(a), F.array_distinct(b)) + 0.15 * F.when(shape_a == shape_b, 1.0).otherwise(0.0) + w * t) / (0.75 + w)
    return F.when((F.size(tools_a) > 0) & (F.size(tools_b) > 0) & (t == 0), F.least(score, F.lit(settings.veto))).otherwise(score)


def _claim(rows: pd.DataFrame) -> pd.DataFrame:
    """Greedy, in node order: each ancestor is claimed once."""
    taken, out = set(), []
    for node, own in rows.sort_values("node_id").groupby("node_id", sort=True):
        for r in own.sort_values(["similarity", "prior_node_id"], ascending=[False, True]).itertuples():
            if r.prior_node_id not in taken:
                taken.add(r.prior_node_id)
                out.append((r.app_id, node, r.prior_node_id, r.similarity))
                break
    return pd.DataFrame(out, columns=["app_id", "node_id", "prior_node_id", "similarity"])


@dataclass
class Reconciled:
    callsites: DataFrame
    observations: DataFrame
    versions: DataFrame
    history: DataFrame


def reconcile(known: DataFrame, observed: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(app_id, node_id, status, prior_node_id, similarity, lines_added, lines_removed): new, seen, changed, or retired (node_id null).

    observed: node_id, app_id, template, tools, shape. Candidates of a fuzzy match are pairs of unmatched callsites of one app that reach the bound.
    """
    seen = observed.join(known.select("node_id", "app_id"), ["node_id", "app_id"], "left_semi")
    left = observed.join(seen, ["node_id", "app_id"], "left_anti")
    free = known.join(seen, ["node_id", "app_id"], "left_anti").select("app_id", F.col("node_id").alias("prior_node_id"), F.col("template").alias("pt"), F.col("tools").alias("po"), F.col("shape").alias("ps"))
    score = template_similarity(F.col("template"), F.col("pt"), F.col("tools"), F.col("po"), F.col("shape"), F.col("ps"), settings)
    near = left.join(free, "app_id").withColumn("similarity", score).where(F.col("similarity") >= settings.reidentify)
    claimed = cut(near.select("app_id", "node_id", "prior_node_id", "similarity").groupBy("app_id").applyInPandas(_claim, "app_id string, node_id string, prior_node_id string, similarity double"))
    added, removed = line_delta(F.col("pt"), F.col("template"))
    changed = claimed.join(left.select("app_id", "node_id", "template"), ["app_id", "node_id"]).join(free.select("app_id", "prior_node_id", "pt"), ["app_id", "prior_node_id"])
    changed = changed.select("app_id", "node_id", F.lit("changed").alias("status"), "prior_node_id", "similarity", added.alias("lines_added"), removed.alias("lines_removed"))
    blank = [F.lit(None).cast("string").alias("prior_node_id"), F.lit(None).cast("double").alias("similarity"), F.lit(0).cast("long").alias("lines_added"), F.lit(0).cast("long").alias("lines_removed")]
    new = left.join(claimed, ["app_id", "node_id"], "left_anti").select("app_id", "node_id", F.lit("new").alias("status"), *blank)
    same = seen.select("app_id", "node_id", F.lit("seen").alias("status"), *blank)
    gone = free.join(claimed, ["app_id", "prior_node_id"], "left_anti").select("app_id", F.lit(None).cast("string").alias("node_id"), F.lit("retired").alias("status"), "prior_node_id", *blank[1:])
    return same.unionByName(changed).unionByName(new).unionByName(gone)


def update(known: DataFrame, observations: DataFrame, versions: DataFrame, observed: DataFrame, run_id: str, now: str, settings: Settings = Settings()) -> Reconciled:
    """The three tables after a run; observed also has calls, avg_tokens, cacheable_now, recoverable, cached_mean, verdict, name, purpose. Retired callsites stay."""
    history = cut(reconcile(known, observed, settings))
    live = history.where(F.col("status") != "retired")
    rows = observed.join(live.select("app_id", "node_id", "status", "prior_node_id"), ["app_id", "node_id"])
    prior = known.select("app_id", F.col("node_id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in ("name", "purpose", "first_seen", "runs_seen", "version", "calls_total")))
    rows = rows.withColumn("_from", F.when(F.col("status") == "seen", F.col("node_id")).otherwise(F.col("prior_node_id")))
    rows = rows.join(prior, (rows["app_id"] == prior["app_id"]) & (F.col("_from") == F.col("_id")), "left").drop(prior["app_id"])
    zero = F.lit(0)
    current = rows.select(
        "node_id", "app_id", F.coalesce("name", "_name").alias("name"), F.coalesce("purpose", "_purpose").alias("purpose"), "template", "tools", "shape",
        F.coalesce("_first_seen", F.lit(now)).alias("first_seen"), F.lit(now).alias("last_seen"), (F.coalesce("_runs_seen", zero) + 1).cast("int").alias("runs_seen"),
        (F.coalesce("_version", zero) + F.when(F.col("status") == "seen", 0).otherwise(1)).cast("int").alias("version"), (F.coalesce("_calls_total", zero) + F.col("calls")).cast("long").alias("calls_total"), F.col("verdict").alias("last_verdict"),
    )
    replaced = live.select(F.coalesce(F.when(F.col("status") == "changed", F.col("prior_node_id")), F.col("node_id")).alias("node_id"), "app_id")
    callsites = known.join(replaced, ["node_id", "app_id"], "left_anti").select(current.columns).unionByName(current)
    moved = history.where(F.col("status") == "changed").select(F.col("prior_node_id").alias("node_id"), F.col("node_id").alias("_new"))
    keyed = observations.join(moved, "node_id", "left").withColumn("node_id", F.coalesce("_new", "node_id")).drop("_new")
    fresh = observed.select("node_id", F.lit(run_id).alias("run_id"), F.lit(now).alias("seen_at"), *(F.col(c) for c in ("calls", "avg_tokens", "cacheable_now", "recoverable", "cached_mean", "verdict")))
    observations = keyed.join(fresh.select("node_id", "run_id"), ["node_id", "run_id"], "left_anti").select(fresh.columns).unionByName(fresh)
    bumped = history.where(F.col("status") == "changed").join(callsites.select("app_id", "node_id", "version"), ["app_id", "node_id"]).select("node_id", "version", F.lit(now).alias("changed_at"), "prior_node_id", "similarity", "lines_added", "lines_removed")
    return Reconciled(callsites, observations, versions.unionByName(bumped), history)


def observations_of(observations: DataFrame, node_id: str, n: int = 20) -> DataFrame:
    """The last n observations of a callsite, newest first."""
    return observations.where(F.col("node_id") == node_id).orderBy(F.col("seen_at").desc()).limit(n)


class Store:
    """The three tables as Parquet. A save writes a new version folder; the version table's newest row is the one that counts."""

    TABLES = {"callsites": CALLSITES_DDL, "observations": OBSERVATIONS_DDL, "versions": VERSIONS_DDL}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _current(self) -> str | None:
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/current")
        if not fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs):
            return None
        found = self.spark.read.schema("saved long, folder string").json(f"{self.path}/current").orderBy(F.col("saved").desc()).first()
        return found["folder"] if found else None

    def load(self) -> dict[str, DataFrame]:
        folder = self._current()
        return {t: self.spark.read.schema(ddl).parquet(f"{self.path}/{folder}/{t}") if folder else self.spark.createDataFrame([], ddl) for t, ddl in self.TABLES.items()}

    def save(self, tables: Reconciled) -> None:
        import time

        folder = uuid.uuid4().hex
        for t in self.TABLES:
            getattr(tables, t).write.parquet(f"{self.path}/{folder}/{t}")
        self.spark.createDataFrame([(time.time_ns(), folder)], "saved long, folder string").coalesce(1).write.mode("append").json(f"{self.path}/current")
