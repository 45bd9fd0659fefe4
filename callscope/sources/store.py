"""The store of a run: five Parquet tables, and the views that read them."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("runs", "nodes", "calls", "regions", "region_lines")
LINE_CHARS, LINES_KEPT = 4000, 400


def write(path: str, tables: dict[str, DataFrame]) -> None:
    """Replace the store at path. Calls and lines are laid out by app, so a view of one app reads one folder."""
    for name in TABLES:
        writer = tables[name].write.mode("overwrite")
        (writer.partitionBy("app_id") if name in ("calls", "region_lines") else writer).parquet(f"{path.rstrip('/')}/{name}")


def latest(folder: str) -> str | None:
    """The newest run-* store below a local folder, or the folder if it is one."""
    top = Path(folder)
    if (top / "nodes").exists():
        return str(top)
    found = sorted((p for p in top.glob("run-*") if (p / "nodes").exists()), key=lambda p: (p.stat().st_mtime, p.name))
    return str(found[-1]) if found else None


class Views:
    """Read-only views of a store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        for name in TABLES:
            df = spark.read.parquet(f"{path.rstrip('/')}/{name}")
            setattr(self, name, df)
            df.createOrReplaceTempView(f"store_{name}")

    def sql(self, text: str) -> DataFrame:
        """Any query over store_runs, store_nodes, store_calls, store_regions, store_region_lines."""
        return self.spark.sql(text)

    def apps(self) -> DataFrame:
        return self.nodes.groupBy("app_id").agg(F.count(F.lit(1)).alias("nodes"), F.sum("calls").alias("calls"), F.sum(F.col("recoverable") * F.col("calls")).alias("recoverable")).orderBy(F.col("recoverable").desc(), "app_id")

    def unassigned(self) -> DataFrame:
        return self.calls.where(F.col("node_id").isNull()).groupBy("app_id").agg(F.count(F.lit(1)).alias("calls"))

    def node(self, prefix: str) -> DataFrame:
        """The one node whose id begins with prefix."""
        found = self.nodes.where(F.col("node_id").startswith(prefix))
        n = found.limit(2).count()
        if n != 1:
            raise LookupError(f"{'no' if n == 0 else 'more than one'} callsite begins with {prefix}")
        return found

    def node_regions(self, node_id: str) -> DataFrame:
        return self.regions.where(F.col("node_id") == node_id)

    def members(self, node_id: str) -> DataFrame:
        return self.calls.where(F.col("node_id") == node_id).orderBy("ts", "request_id")

    def member(self, node_id: str, index: int) -> DataFrame:
        """One call of a node by its place; a place beyond either end is the end."""
        n = self.members(node_id).count()
        return self.members(node_id).offset(max(0, min(index, n - 1))).limit(1)

    def lines_of(self, call: DataFrame, regions: DataFrame) -> DataFrame:
        """(region, line, mark) of a call's lines (regions: request_id, region, line): `=` static, `~` dynamic, `?` not known."""
        rows = call.select("request_id", "node_id").join(regions, "request_id").withColumn("line", F.substring("line", 1, LINE_CHARS))
        known = self.region_lines.select("node_id", "region", "line", "kind")
        mark = F.when(F.col("kind") == "static", "=").when(F.col("kind") == "dynamic", "~").otherwise("?")
        return rows.join(known, ["node_id", "region", "line"], "left").select("region", "line", mark.alias("mark"))


def export_requests(spark: SparkSession, views: Views, node_id: str, folder: str) -> int:
    """One text file for each member request, named by its place; for a person to read, so it stays on the driver's disk."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    n = 0
    for n, row in enumerate(views.members(node_id).select("request_id", "request_json").toLocalIterator(), 1):
        (out / f"{n:04d}-{row['request_id']}.txt").write_text(row["request_json"] or "")
    return n


def now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
