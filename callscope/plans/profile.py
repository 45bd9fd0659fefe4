"""Profile of an export: calls -> callsites -> metrics, runs, registry, store and reports."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions.text import lines, tokens
from callscope.operators import chain, facts, identity, metrics, registry, segment
from callscope.plans import judge as judging
from callscope.plans.audit import Audit
from callscope.runtime import cut
from callscope.settings import Settings
from callscope.sources import store


@dataclass
class Profile:
    """Everything that is known of a run, as DataFrames; gate is decided on the driver."""

    tables: dict[str, DataFrame]
    apps: DataFrame
    grouping: identity.Grouping
    node_metrics: DataFrame
    chains: DataFrame
    runs: DataFrame
    verdicts: DataFrame
    signatures: DataFrame
    history: DataFrame | None
    gate_passed: bool
    gate_reason: str


def profile(spark: SparkSession, calls: DataFrame, run_id: str, source: str = "", settings: Settings = Settings(), judge: judging.Judge | None = None, remember: registry.Store | None = None, audit: Audit | None = None) -> Profile:
    """Profile calls (sources.gateway.calls or an adapter). Deterministic; a judge only adds verdicts."""
    audit = audit or Audit()
    has_json = {"request_json", "response_json"} <= set(calls.columns)
    found = facts.call_facts(calls)
    prints = facts.fingerprints(calls)
    grouping = identity.group(prints, settings)
    audit.event("grouped", nodes=grouping.nodes.where("is_node").count())
    if judge is not None:
        grouping = _settle(spark, calls, grouping, judge, audit)
    member = grouping.membership.select("app_id", "request_id", "node_id")
    assigned = calls.join(member.where(F.col("node_id").isNotNull()), ["app_id", "request_id"])
    measured = cut(metrics.node_metrics(assigned, settings=settings).drop("static_lines", "dynamic_lines"))
    regions = cut(metrics.region_anatomy(assigned, ["node_id", "app_id"]))
    responses = cut(metrics.response_anatomy(assigned, ["node_id", "app_id"]))
    told = metrics.describe(regions, responses, ["node_id", "app_id"]).drop("app_id")
    signatures = identity.identity_signature(prints.join(member.where(F.col("node_id").isNotNull()), ["app_id", "request_id"]), ["app_id", "node_id"])
    texts = metrics.region_texts(assigned, "node_id", "app_id", "request_id")
    split = segment.line_split(texts, ["node_id", "app_id", "region"])
    sizes = segment.call_split(texts.withColumn("_r", F.concat("node_id", F.lit("|"), "region")), ["_r"], split.withColumn("_r", F.concat("node_id", F.lit("|"), "region")))
    chains, run_rows, walked = chain.reconstruct(calls, member, settings)
    verdicts = _verify(spark, grouping, assigned, judge)
    labels = _labels(spark, calls, grouping, measured, judge)
    passed, reason = judging.gate(judging.judge_summary(verdicts).first().asDict(), settings.gate)
    nodes = grouping.nodes.where("is_node").join(measured, "node_id").join(verdicts.select("node_id", F.col("verdict").alias("judge_verdict")), "node_id", "left").join(labels, "node_id", "left").join(told, "node_id", "left").join(responses.drop("app_id", "calls", "truncated", "models"), "node_id", "left")
    n = calls.agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("app_id").alias("apps")).first()
    text = lambda c: F.to_json(F.col(c))
    tables = {
        "runs": spark.createDataFrame([(run_id, store.now(), source, n["calls"], n["apps"], nodes.count(), passed, reason)], "run_id string, created_at string, csv_path string, calls long, apps long, callsites long, gate_passed boolean, gate_reason string").withColumn("created_at", F.to_timestamp("created_at")),
        "nodes": nodes.select(
            "node_id", "app_id", "name", "purpose", F.col("size").alias("calls"), "avg_request_tokens", "cacheable_now", "recoverable", "reported_cached_mean",
            "distinct_prompts", "confidence", "quality", F.col("margin").alias("quality_margin"), "judge_verdict", "tools_declared", text("tools_never_called").alias("tools_never_called"),
            "description", "completion_p50", "completion_p95", "tool_call_rate", text("finish_reasons").alias("finish_reasons"), text("template").alias("template"), text("findings").alias("findings"),
            F.to_json(F.struct("tools", "shape", "distinct_ratio", "reasons")).alias("fingerprint"),
        ),
        "calls": found.join(member, ["app_id", "request_id"], "left").join(sizes, "request_id", "left").join(walked.select("app_id", "request_id", F.col("root").alias("run_id_chain"), "step"), ["app_id", "request_id"], "left").select(
            "request_id", "app_id", "node_id", "ts", "model", "prompt_tokens", "completion_tokens", "cached_tokens", "finish_reason", "n_messages", "n_tools", "role_shape", "static_tokens", "dynamic_tokens", "dynamic_share", "run_id_chain", "step",
            *((F.col(c) if has_json else F.lit(None).cast("string").alias(c)) for c in ("request_json", "response_json")),
        ),
        "regions": regions.select("node_id", "app_id", "region", "mean_tokens", "share", "p10", "p90", "static_share", "varies"),
        "region_lines": _kept_lines(split),
    }
    history = None
    if remember is not None:
        known = remember.load()
        seen = nodes.select("node_id", "app_id", "name", "purpose", "template", "tools", "shape", F.col("size").alias("calls"), F.col("avg_request_tokens").alias("avg_tokens"), "cacheable_now", "recoverable", F.col("reported_cached_mean").alias("cached_mean"), F.col("judge_verdict").alias("verdict"))
        updated = registry.update(known["callsites"], known["observations"], known["versions"], cut(seen), run_id, store.now(), settings)
        remember.save(updated)
        history = updated.history
    audit.event("profiled", gate=passed)
    return Profile(tables, facts.app_rollup(found), grouping, measured, chains, run_rows, verdicts, signatures, history, passed, reason)


def _kept_lines(split: DataFrame) -> DataFrame:
    """The lines of the store: all static ones, the most frequent dynamic ones of a region."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("node_id", "region", "kind").orderBy(F.col("doc_frequency").desc(), "line"))
    kept = split.withColumn("_n", place).where((F.col("kind") == "static") | (F.col("_n") <= store.LINES_KEPT))
    return kept.select("node_id", "app_id", "region", "kind", "doc_frequency", "calls", F.substring("line", 1, store.LINE_CHARS).alias("line"))


def _excerpts(calls: DataFrame, wanted: DataFrame) -> dict[tuple[str, str], str]:
    """Excerpts of the wanted requests (app_id, request_id); the caller bounds them."""
    text = judging.excerpt_column(metrics.request_document(F.col("messages"), F.col("tools")))
    rows = calls.join(wanted.distinct(), ["app_id", "request_id"]).select("app_id", "request_id", text.alias("text")).collect()
    return {(r["app_id"], r["request_id"]): r["text"] for r in rows}


def _settle(spark: SparkSession, calls: DataFrame, grouping: identity.Grouping, judge: judging.Judge, audit: Audit) -> identity.Grouping:
    """grouping with ambiguous pairs of nodes merged and clusters promoted as the judge says. It is asked about a bounded number for each app."""
    nodes = grouping.nodes
    named = grouping.points.join(nodes.where("is_node").select("cluster", "node_id"), "cluster").select("point", "request_id", "node_id")
    side = lambda c: named.select(F.col("point").alias(c), F.col("request_id").alias(f"r{c}"), F.col("node_id").alias(f"n{c}"))
    asked = identity.explained(judging.best_pairs(grouping.ambiguous), grouping.points).join(side("a"), "a").join(side("b"), "b").where("na <> nb")
    best = F.max_by(F.struct("app_id", "a", "b", "ra", "rb", "na", "nb", "score", "why"), F.struct("score", "a", "b"))
    asked = cut(asked.groupBy(F.least("na", "nb"), F.greatest("na", "nb")).agg(best.alias("s")).select("s.*"))
    rescued = cut(judging.rescuable(nodes).select("app_id", "cluster", "size", "medoid"))
    wanted = asked.select("app_id", F.col("ra").alias("request_id")).union(asked.select("app_id", "rb")).union(rescued.select("app_id", "medoid"))
    texts = _excerpts(calls, wanted)
    pairs = asked.orderBy(F.col("score").desc(), "a", "b").collect()
    shown = {r[c]: texts.get((r["app_id"], r[f"r{c}"]), "") for r in pairs for c in ("a", "b")}
    ones = set(judging.adjudicate(judge, asked.select("a", "b", "score", "why").orderBy(F.col("score").desc(), "a", "b"), shown, audit))
    merged = [(r["na"], r["nb"]) for r in pairs if (r["a"], r["b"]) in ones]
    involved = spark.createDataFrame([(n,) for pair in merged for n in pair], "node_id string").distinct()
    kept = identity.settle_merges(merged, {r["node_id"]: r["size"] for r in nodes.join(involved, "node_id").select("node_id", "size").collect()})
    merges = spark.createDataFrame([(keep, gone) for gone, keep in kept.items()], "keep string, gone string")
    promoted = judging.rescue(judge, rescued, {r["cluster"]: texts.get((r["app_id"], r["medoid"]), "") for r in rescued.collect()}, audit)
    audit.event("settled", merged=len(kept), promoted=len(promoted))
    if not kept and not promoted:
        return grouping
    nodes = identity.promote(nodes, spark.createDataFrame([(c,) for c in promoted], "cluster string"))
    # Merged clusters keep their rows in the membership, so ids come from the nodes before they are merged.
    owner = nodes.select("cluster", F.when(F.col("is_node"), F.col("node_id")).alias("node_id"))
    membership = identity.merge_nodes(grouping.membership.drop("node_id").join(owner, "cluster", "left"), merges)
    return replace(grouping, nodes=cut(identity.merge_counts(nodes, merges)), membership=cut(membership))


def _labels(spark: SparkSession, calls: DataFrame, grouping: identity.Grouping, measured: DataFrame, judge: judging.Judge | None) -> DataFrame:
    """(node_id, name, purpose, agent_role) as the judge names each node by its template, its tools and a request; nulls without a judge."""
    nodes = grouping.nodes.where("is_node")
    ddl = "node_id string, name string, purpose string, agent_role string"
    if judge is None:
        return spark.createDataFrame([], ddl)
    texts = _excerpts(calls, nodes.select("app_id", F.col("medoid").alias("request_id")))
    template = judging.excerpt_column(F.array_join("template", "\n"))
    rows = nodes.join(measured.select("node_id", "called"), "node_id", "left").select("node_id", "app_id", "medoid", template.alias("template"), F.array_join(F.slice("called", 1, judging.LABEL_TOOLS), ", ").alias("called")).collect()
    asked = {r["node_id"]: f"Tools: {r['called'] or ''}\n=====\n{r['template']}\n=====\n{texts.get((r['app_id'], r['medoid']), '')}" for r in rows}
    found = judging.label(judge, asked)
    return spark.createDataFrame([(n, *(judging.clipped(a, c) for c in judging.LABEL_CHARS)) for n, a in found.items()], ddl)


def _verify(spark: SparkSession, grouping: identity.Grouping, assigned: DataFrame, judge: judging.Judge | None) -> DataFrame:
    """(node_id, pure, claims, boundary, verdict) of each node; three samples a node, spread over its calls."""
    nodes = grouping.nodes.where("is_node").select("node_id")
    ddl = "node_id string, pure boolean, claims boolean, boundary boolean"
    if judge is None:
        rows = nodes.select("node_id", *(F.lit(None).cast("boolean").alias(c) for c in ("pure", "claims", "boundary")))
    else:
        from callscope.sources.gateway import systematic_sample

        sampled = systematic_sample(assigned, ["node_id"], ["ts", "request_id"], judging.SAMPLES).select("node_id", "app_id", metrics.request_document(F.col("messages"), F.col("tools")).alias("text")).collect()
        texts: dict[str, list[str]] = {}
        app_of: dict[str, str] = {}
        for r in sampled:
            texts.setdefault(r["node_id"], []).append(r["text"])
            app_of[r["node_id"]] = r["app_id"]
        size = {r["node_id"]: r["size"] for r in grouping.nodes.where("is_node").select("node_id", "size").collect()}
        names = sorted(texts, key=lambda n: (-size[n], n))
        out = []
        for name in names:
            pure, claims = judging.audit_profile(judge, [f"{len(texts[name])} samples share one template"], texts[name])
            # The intruder comes from another node of the same app, the largest.
            other = next((o for o in names if o != name and app_of[o] == app_of[name]), None)
            boundary = judging.intruder(judge, (texts[name] * 2)[:2], texts[other][0], name) if other is not None else None
            out.append((name, pure, claims, boundary))
        rows = spark.createDataFrame(out, ddl)
    return rows.withColumn("verdict", judging.conclude(F.col("pure"), F.col("claims"), F.col("boundary")))


def document_lines(prompts: DataFrame) -> DataFrame:
    """(app_id, request_id, lines, tokens) of plain prompts."""
    return prompts.select("app_id", "request_id", lines(F.col("text")).alias("lines"), tokens(F.length("text")).alias("tokens"))
