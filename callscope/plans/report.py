"""Reports of a profile: JSON, Markdown and a small HTML site. Rows are one for each app or node; call texts are sampled."""

from __future__ import annotations

import html
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators import chain
from callscope.plans.profile import Profile
from callscope.settings import Settings
from callscope.sources.gateway import systematic_sample

#: Characters of a page line and of a page, samples of a node at least and at most.
LINE, PAGE, FEWEST, MOST = 240, 600_000, 3, 20
SAMPLE_CHARS = 9600
#: Hops of a run that a report shows.
HOPS = 6


def samples_per_node(nodes: int, page: int = PAGE) -> int:
    return max(FEWEST, min(MOST, page // max(1, nodes) // SAMPLE_CHARS))


def as_rows(df: DataFrame) -> list[dict]:
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]


def _by_rows(rows: list[dict], key: str) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def _by(df: DataFrame, key: str) -> dict[str, list[dict]]:
    return _by_rows(as_rows(df), key)


def cache_state(node: dict, minimum: int = Settings.cache_minimum) -> str:
    """What a provider's cache holds of a node's requests, in a few words."""
    now, more = node["cacheable_now"] or 0, node["recoverable"] or 0
    if now >= minimum:
        return "unused" if node["reported_cached_mean"] == 0 else "cached"
    return "within reach" if now + more >= minimum else "too short"


def shape_note(signature: dict | None) -> str:
    """How uniform a node's calls are."""
    if not signature:
        return ""
    shapes = ", ".join(f"{s['shape']} ({s['calls']})" for s in signature["shapes"])
    weak = f"; {signature['weak_prompts']} with hardly a prompt" if signature["weak_prompts"] else ""
    return f"{signature['distinct_shapes']} message shape{'s' * (signature['distinct_shapes'] != 1)}: {shapes}; {signature['distinct_tool_sets']} tool lists; median prompt of {signature['median_prompt_lines']} lines{weak}"


def to_json(p: Profile) -> dict:
    """The nested result: apps with their nodes, runs and what is left over."""
    nodes, chains = as_rows(p.tables["nodes"].orderBy("app_id", F.col("calls").desc(), "node_id")), {r["app_id"]: r for r in as_rows(p.chains)}
    left = {r["app_id"]: r["n"] for r in as_rows(p.tables["calls"].where("node_id IS NULL").groupBy("app_id").agg(F.count(F.lit(1)).alias("n")))}
    history = as_rows(p.history) if p.history is not None else []
    regions, signatures = _by(p.tables["regions"].orderBy("node_id", F.col("mean_tokens").desc(), "region"), "node_id"), {r["node_id"]: r for r in as_rows(p.signatures)}
    nodes = [n | {"regions": regions.get(n["node_id"], []), "signature": signatures.get(n["node_id"])} for n in nodes]
    # At most five paths and three runs an app; a run's path is shown by its first hops.
    paths = _by(chain.top_paths(p.runs).orderBy("app_id", F.col("runs").desc(), "path"), "app_id")
    longest = _by(chain.longest_runs(p.runs).drop("requests").withColumn("path", F.slice("path", 1, HOPS)).orderBy("app_id", F.col("steps").desc(), "run_id"), "app_id")
    own = _by_rows(nodes, "app_id")
    apps = []
    for a in as_rows(p.apps.orderBy("app_id")):
        name = a["app_id"]
        chained = chains.get(name) and chains[name] | {"top_paths": paths.get(name, []), "longest": longest.get(name, [])}
        apps.append(a | {"nodes": own.get(name, []), "chain": chained, "residual_calls": left.get(name, 0)})
    return {"gate": {"passed": p.gate_passed, "reason": p.gate_reason}, "apps": apps, "history": history}


def markdown(result: dict) -> str:
    out = ["# Profile", "", f"Gate: {'passed' if result['gate']['passed'] else 'not passed'} ({result['gate']['reason']})", "", "| app | calls | callsites | in none | runs |", "|-|-|-|-|-|"]
    for a in result["apps"]:
        out.append(f"| {a['app_id']} | {a['calls']} | {len(a['nodes'])} | {a['residual_calls']} | {(a['chain'] or {}).get('verdict', '-')} |")
    for a in result["apps"]:
        out += ["", f"## {a['app_id']}"]
        c = a["chain"]
        if c and c["verdict"] != "single_step":
            out += ["", f"{c['runs']} runs ({c['mode']} links), {c['mean_steps']:.1f} steps and {c['mean_run_tokens']} tokens on average, {c['max_steps']} steps at most; {c['orphans']} of {c['continuations']} continuations without a parent."]
            out += [f"- {r['runs']} runs: {r['path']}" for r in c["top_paths"]]
            out += [f"- longest: {r['run_id']}, {r['steps']} steps in {r['duration_s']:.0f} s" for r in c["longest"]]
        for n in a["nodes"]:
            template = json.loads(n["template"] or "[]")
            out += ["", f"### {n['name'] or n['node_id']}", "", f"`{n['node_id']}` {n['purpose'] or ''}".rstrip(), "", n["description"], "", f"Cache: {cache_state(n)}. {shape_note(n.get('signature'))}", "", f"{n['calls']} calls, {n['avg_request_tokens']} tokens a call, {n['cacheable_now']} cacheable, {n['recoverable']} recoverable; {n['confidence']}, {n['quality']}, {n['judge_verdict']}", ""]
            out += [f"- {f}" for f in json.loads(n["findings"] or "[]")]
            if n.get("regions"):
                out += ["", "| region | tokens | share | p10 | p90 | same | varies |", "|-|-|-|-|-|-|-|"]
                out += [f"| {r['region']} | {r['mean_tokens']} | {r['share']:.0%} | {r['p10']} | {r['p90']} | {r['static_share']:.0%} | {'yes' if r['varies'] else 'no'} |" for r in n["regions"]]
            out += ["", "```", *(line[:LINE] for line in template[:80]), "```"]
    out += ["", "## Limits", "", "Token counts are estimated at four characters each. Runs need replayed history."]
    return "\n".join(out) + "\n"


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-") or "app"


def bar(share: float, width: int = 200) -> str:
    return f'<span style="display:inline-block;background:#357;height:8px;width:{round(width * max(0.0, min(1.0, share)))}px"></span>'


def page(title: str, body: str) -> str:
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><body style='font:14px sans-serif;max-width:960px;margin:2em auto'><h1>{html.escape(title)}</h1>{body}"


def html_site(p: Profile, result: dict, folder: str) -> list[str]:
    """index.html and a page for each app; a page stays within its budget however many calls a node has."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    written = []
    total = sum(n["calls"] * n["avg_request_tokens"] for a in result["apps"] for n in a["nodes"]) or 1
    rows = "".join(f"<tr><td><a href='{slug(a['app_id'])}.html'>{html.escape(a['app_id'])}</a><td>{a['calls']}<td>{len(a['nodes'])}<td>{bar(sum(n['calls'] * n['avg_request_tokens'] for n in a['nodes']) / total)}" for a in result["apps"])
    (out / "index.html").write_text(page("Agents", f"<p>{html.escape(result['gate']['reason'])}<table><tr><th>app<th>calls<th>callsites<th>tokens{rows}</table>"))
    written.append("index.html")
    count = max((len(a["nodes"]) for a in result["apps"]), default=0)
    picked = systematic_sample(p.tables["calls"].where("node_id IS NOT NULL"), ["node_id"], ["ts", "request_id"], samples_per_node(count))
    texts: dict[str, list[str]] = {}
    for r in picked.select("node_id", F.substring("request_json", 1, SAMPLE_CHARS // 2).alias("t")).collect():
        texts.setdefault(r["node_id"], []).append(r["t"] or "")
    for a in result["apps"]:
        parts, left = [], PAGE // 2
        for n in a["nodes"]:
            template = "\n".join(line[:LINE] for line in json.loads(n["template"] or "[]")[:80])
            found = "".join(f"<li>{html.escape(f)}" for f in json.loads(n["findings"] or "[]"))
            share = n["cacheable_now"] / max(1, n["avg_request_tokens"])
            block = f"<h2>{html.escape(n['name'] or n['node_id'])}</h2><p>{html.escape(n['description'])}<p>{n['calls']} calls; cache {cache_state(n)} {bar(share)}<ul>{found}</ul><pre>{html.escape(template)}</pre>"
            for t in texts.get(n["node_id"], []):
                block += f"<details><summary>request</summary><pre>{html.escape(t[: max(0, left // 20)])}</pre></details>"
            block = block if len(block) <= left else block[:left]
            left -= len(block)
            parts.append(block)
        name = f"{slug(a['app_id'])}.html"
        (out / name).write_text(page(a["app_id"], "".join(parts)))
        written.append(name)
    return written
