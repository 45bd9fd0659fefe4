"""A whole profile: store, views, reports, judge, and the streaming lookup."""

import ast
import json
from pathlib import Path

import pytest

from callscope.operators import facts, registry, scoring
from callscope.operators.segment import TemplateMiner, mine_fields, wildcard_values
from callscope.plans import judge as judging
from callscope.plans import report
from callscope.plans.audit import Audit, estimate_cost
from callscope.plans.profile import profile
from callscope.sources import store
from callscope.streaming.lookup import lookup_stream, repeated_requests, windowed_counts
from tests.helpers import BILLING, SUPPORT, call, frame

REPO = Path(__file__).resolve().parent.parent


class Agreeing:
    """A judge that agrees with everything it is asked."""

    def ask(self, system, user, purpose):
        return {"audit": {"pure": True, "claims": True}, "intruder": {"intruder": next((k for k in range(3) if f"{k}: " in user and "invoice" in user.split(f"{k}: ")[1].split("=====")[0]), 0)}, "pair": {"same": True}, "rescue": {"task": True}, "label": {"name": "n", "purpose": "p"}}[purpose]


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    rows = [call(k, [("system", SUPPORT), ("user", f"question {k} " + "word " * (k % 9))], cached_tokens=0, prompt_tokens=2000, tools=["search", "pay"], response_tool_calls=["search"], finish_reason="length" if k == 3 else "stop") for k in range(20)]
    rows += [call(100 + k, [("system", f"Tenant {k}\n{BILLING}\n" + "L" * 100_000), ("user", f"invoice {k}")], app="bills", model=f"m{k % 2}") for k in range(12)]
    rows.append(call(300, [("user", "alone")], app="bills"))
    path = str(tmp_path_factory.mktemp("out"))
    memory = registry.Store(spark, f"file://{path}/registry")
    p = profile(spark, frame(spark, rows), "run-1", judge=Agreeing(), remember=memory)
    store.write(f"{path}/run-1", p.tables)
    return p, path


def test_store_and_views(spark, found):
    p, path = found
    assert store.latest(path) == f"{path}/run-1"
    views = store.Views(spark, f"{path}/run-1")
    assert views.calls.count() == 33 and views.nodes.count() == 2 and views.runs.first().callsites == 2
    assert {r.app_id: r.calls for r in views.unassigned().collect()} == {"bills": 1}
    assert views.sql("SELECT count(*) AS n FROM store_calls WHERE run_id_chain IS NULL").first().n == 0
    node = views.nodes.where("app_id = 'app'").first()
    assert views.node(node.node_id[:9]).first().calls == 20 and views.member(node.node_id, -5).first().request_id == "r0000" and views.member(node.node_id, 99).first().request_id == "r0019"
    with pytest.raises(LookupError):
        views.node("nothing")
    static = views.region_lines.where("app_id = 'app' AND kind = 'static'")
    assert {r.line for r in static.where("region = 'instructions'").collect()} == set(SUPPORT.split("\n")) and static.where("doc_frequency <> 20").count() == 0
    own = views.member(node.node_id, 0)
    regions = own.selectExpr("request_id", "'instructions' AS region", "explode(array('Be brief.', 'never seen')) AS line")
    assert {(r.line, r.mark) for r in views.lines_of(own, regions).collect()} == {("Be brief.", "="), ("never seen", "?")}
    assert store.export_requests(spark, views, node.node_id, f"{path}/texts") == 20


def test_metrics_and_findings(found):
    p, _ = found
    rows = {r.node_id.split(":")[0]: r for r in p.node_metrics.collect()}
    assert rows["app"].tools_never_called == ["pay"] and rows["app"].truncated == 1 and rows["app"].reported_cached_mean == 0.0
    assert rows["bills"].cacheable_now < 10 and rows["bills"].recoverable > 20_000
    assert any(f.startswith("cache: varying") for f in rows["bills"].findings) and any(f.startswith("models: 2") for f in rows["bills"].findings)
    assert {r.node_id.split(":")[0]: r.verdict for r in p.verdicts.collect()} == {"app": "confirmed", "bills": "confirmed"}  # each app has one callsite, so there is no neighbour to tell apart
    assert p.gate_passed and p.history.where("status = 'new'").count() == 2


def test_reports_keep_their_size(found, tmp_path):
    p, _ = found
    result = json.loads(json.dumps(report.to_json(p)))
    assert [a["app_id"] for a in result["apps"]] == ["app", "bills"] and "cache:" in report.markdown(result)
    written = report.html_site(p, result, str(tmp_path))
    assert written == ["index.html", "app.html", "bills.html"] and all((tmp_path / f).stat().st_size < 400_000 for f in written)
    app = result["apps"][0]
    assert app["chain"]["mode"] == "strict" and {r["region"] for r in app["nodes"][0]["regions"]} == {"instructions", "the user turn", "tool schemas"} and app["nodes"][0]["signature"]["with_system_prompt"] == 20
    assert report.cache_state(result["apps"][1]["nodes"][0]) == "within reach" and app["nodes"][0]["description"] in report.markdown(result) and "1 message shape: SU (20)" in report.markdown(result)
    assert report.samples_per_node(1) == 20 and report.samples_per_node(500) == 3


def test_facts_and_flags(spark):
    rows = [
        call(0, [("system", "- a\n1. b\nplain\nplain"), ("user", "hi")], prompt_tokens=2000, cached_tokens=0, finish_reason="length"),
        call(1, [("system", "s" * 40), ("user", "u" * 8), ("assistant", "x" * 4000), ("tool", "y" * 10, ["t"])], tools=[f"t{k}" for k in range(15)]),
    ]
    a, b = facts.call_facts(frame(spark, rows)).orderBy("request_id").collect()
    assert a.flags == ["no cache hit on a prompt large enough to cache", "response truncated by max_tokens"] and a.prose_share == 0.6 and a.cache_hit_ratio == 0.0 and a.repeated_tokens == 1
    assert b.flags == ["tool schemas outweigh the system prompt", "15 or more tools declared in one call", "history dominates the payload"] and b.role_shape == "SU(AT)" and b.system_tokens == 10


def test_scores(spark):
    rows = [("a", f"r{k}", "n1" if k < 6 else "n2" if k < 9 else None) for k in range(10)]
    truth = [(f"r{k}", "x" if k < 5 else "y") for k in range(10)]
    r = scoring.truth_scores(spark.createDataFrame(rows, "app_id string, request_id string, node_id string"), spark.createDataFrame(truth, "request_id string, callsite string"), spark.createDataFrame([("r9",)], "request_id string")).first()
    assert (r.purity, r.completeness, r.coverage, r.mixed_nodes, r.split_callsites) == (0.889, 0.889, 1.0, 1, 1)


def test_miner(spark):
    miner = TemplateMiner()
    lines = ["order 17 shipped to Bonn", "order 18 shipped to Rome", "nothing else here now"]
    for line in lines:
        miner.add(line)
    assert miner.match(lines[0]) == "order <*> shipped to <*>" and wildcard_values("order <*> shipped to <*>", lines[1]) == ["18", "Rome"]
    rows = mine_fields(spark.createDataFrame([("k", n, x) for n, x in enumerate(lines)], "key string, pos long, line string")).collect()
    assert (rows[0].occurrences, rows[0].examples) == (2, ["17", "Bonn", "18"])


def test_judge_and_gate(spark, tmp_path):
    answers = iter([RuntimeError("429"), "not json", '{"same": true}'])

    def answer(system, user):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    audit, slept = Audit(), []
    judge = judging.CachedJudge(answer, "m", str(tmp_path), audit, sleep=slept.append)
    assert judge.ask("s", "u", "pair") == {"same": True} == judge.ask("s", "u", "pair")
    assert 20.0 <= slept[0] <= 23.0 and 2.0 <= slept[1] <= 3.0 and len(slept) == 2  # a limit counts by the minute; other failures double
    assert audit.usage()["cached"] == 1 and "judge_failed" in audit.markdown() and estimate_cost("gpt-4o-mini", 10**6, 0) == 0.15 and estimate_cost("another", 10**6, 10**6) == 5.0
    ambiguous = spark.createDataFrame([("a", "b", 0.5)], "a string, b string, score double")
    assert judging.adjudicate(Agreeing(), ambiguous, {}) == [("a", "b")] and judging.NoJudge().ask("", "", "") is None
    assert judging.gate({"confirmed_rate": None})[0] and not judging.gate({"confirmed_rate": 0.5})[0]
    clock = [0.0]
    pace = judging.Pace(100, lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
    assert pace.take(90) == 0 and pace.take(20) == 60


def test_streams(spark, tmp_path):
    schema = "request_id string, app_id string, lines array<string>, tools array<string>, shape string"
    spark.createDataFrame([("q1", "app", SUPPORT.split("\n"), [], "SU"), ("q2", "app", ["unknown"], [], "SU")], schema).write.parquet(f"{tmp_path}/in")
    known = spark.createDataFrame([("support", "app", SUPPORT.split("\n"), [], "SU")], "node_id string, app_id string, template array<string>, tools array<string>, shape string")
    lookup_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), known, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    assert {r.request_id: r.status for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"q1": "matched", "q2": "unknown"}
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 'k' AS key, 'r' AS request_id").write.parquet(f"{tmp_path}/events")
    events = spark.readStream.schema("ts timestamp, event_type string, key string, request_id string").parquet(f"{tmp_path}/events")
    for name, df in (("w", windowed_counts(events)), ("d", repeated_requests(events))):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("d").count() == 1 and windowed_counts(spark.read.parquet(f"{tmp_path}/events")).first().n == 1


def test_the_library_does_not_know_the_training_data_operators():
    for path in (REPO / "callscope").rglob("*.py"):
        if "llm" in path.relative_to(REPO / "callscope").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("callscope.llm") for n in names), path


def test_entry_works_without_them(tmp_path):
    import shutil
    import subprocess
    import sys

    for name in ("callscope", "__spark_entry__.py"):
        (shutil.copytree if (REPO / name).is_dir() else shutil.copy)(REPO / name, tmp_path / name)
    shutil.rmtree(tmp_path / "callscope/llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op') or q == 'pipeline'], set(e.oracle_sql()) <= set(e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.stdout.strip().endswith("[] True"), said.stderr
