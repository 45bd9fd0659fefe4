"""The judged stages within a profile, a judge over HTTP, and what reports say of nodes and runs."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from callscope.functions.text import counted_ranks, nearest_rank, rank_at, upper_median
from callscope.operators import chain, facts, identity, metrics, scoring
from callscope.plans import judge as judging
from callscope.plans.audit import Audit
from callscope.plans.profile import profile
from callscope.sources.truth import read_truth
from tests.helpers import BILLING, call, frame


class Scripted:
    """Answers by purpose, and remembers what it was asked."""

    def __init__(self, **answers):
        self.answers, self.asked = answers, []

    def ask(self, system, user, purpose):
        self.asked.append((purpose, user))
        return self.answers.get(purpose)


def two_versions():
    shared = [f"shared rule {k}" for k in range(5)]
    one, two = ("\n".join(shared + [f"{name} own {k}" for k in range(5)]) for name in ("first", "second"))
    return [call(k, [("system", one if k % 3 else two), ("user", f"q{k}")]) for k in range(40)]


def test_pairs_are_merged_and_clusters_promoted(spark):
    rows = two_versions() + [call(200 + k, [("user", f"lone {BILLING.splitlines()[k]}")], app="small") for k in range(5)]
    rows += [call(300 + k, [("system", "Only this."), ("user", f"hello {k}")], app="small") for k in range(2)]
    plain = profile(spark, frame(spark, rows), "plain")
    sizes = sorted(r["size"] for r in plain.grouping.nodes.where("is_node AND app_id = 'app'").collect())
    assert sizes == [14, 26]
    audit, judge = Audit(), Scripted(pair={"same": True}, rescue={"task": True}, label={"name": "Answer " + "x" * 100, "purpose": "p"})
    p = profile(spark, frame(spark, rows), "run", judge=judge, audit=audit)
    nodes = p.tables["nodes"].where("app_id = 'app'").collect()
    assert [(r.calls, r.name[:6], len(r.name), r.purpose) for r in nodes] == [(40, "Answer", 80, "p")]
    assert p.tables["calls"].where(F.col("node_id") == nodes[0].node_id).count() == 40
    shown = next(u for purpose, u in judge.asked if purpose == "pair")
    assert "prompt 0." in shown and "first own 0" in shown and "second own 0" in shown
    promoted = p.grouping.nodes.where("app_id = 'small' AND is_node").collect()
    assert [r["size"] for r in plain.grouping.nodes.where("app_id = 'small' AND is_node").collect()] == [5]  # of 7 calls, 3 make a node
    assert sorted((r["size"], r.confidence) for r in promoted) == [(2, "weak"), (5, "weak")] and p.grouping.membership.where("app_id = 'small' AND node_id IS NULL").count() == 0
    assert {e["outcome"] for e in audit.events if e["kind"] == "decision"} == {"one", "promoted"}


def test_a_judge_that_disagrees_or_is_silent_changes_nothing(spark):
    calls = frame(spark, two_versions())
    for judge in (Scripted(pair={"same": False}, rescue={"task": False}), judging.NoJudge()):
        p = profile(spark, calls, "run", judge=judge)
        assert sorted(r.calls for r in p.tables["nodes"].collect()) == [14, 26] and p.tables["nodes"].where("name IS NOT NULL").count() == 0


def test_merges_follow_each_other():
    assert identity.settle_merges([("a", "b"), ("b", "c"), ("c", "a")], {"a": 5, "b": 5, "c": 20}) == {"b": "c", "a": "c"}
    assert identity.settle_merges([("a", "a"), ("a", "x")], {"a": 1}) == {}


def test_a_judge_over_http(tmp_path):
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            code, body = (429, {"error": "please try again in 4s"}) if len(seen) == 1 else (200, {"choices": [{"message": {"content": '{"same": true}'}}]})
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        slept = []
        judge = judging.CachedJudge(judging.chat_call(f"http://127.0.0.1:{server.server_port}/v1/", "m", "k"), "m", str(tmp_path), sleep=slept.append)
        assert judge.ask("s", "u", "pair") == {"same": True} and slept == [5.0]  # the wait the server names, and a margin
    finally:
        server.shutdown()
    assert seen[0][0] == "/v1/chat/completions" and seen[0][1] == "Bearer k" and seen[0][2]["messages"][1] == {"role": "user", "content": "u"}


def test_excerpts_are_alike_in_both_places(spark):
    texts = ["", "short", "x" * judging.EXCERPT_CHARS, "".join(chr(97 + k % 26) for k in range(5000))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", judging.excerpt_column(F.col("t")).alias("e")).collect()
    assert all(r.e == judging.excerpt(r.t) for r in rows)


def test_answers_and_descriptions(spark):
    rows = [call(k, [("system", BILLING), ("user", f"invoice {k} " + "w " * 40 * (k % 3))], completion_tokens=None if k == 4 else 10 * k, finish_reason=(None, "length", "stop")[k % 3], response_tool_calls=["pay"] if k < 2 else [], model=f"m{k % 2}") for k in range(5)]
    calls = frame(spark, rows)
    found = metrics.response_anatomy(calls, ["app_id"])
    r = found.first()
    assert (r.calls, r.completion_p50, r.completion_p95, r.truncated, r.tool_call_rate) == (5, 20, 30, 2, 0.4)
    assert [tuple(x) for x in r.models] == [("m0", 3), ("m1", 2)] and [tuple(x) for x in r.finish_reasons] == [("length", 2), ("unknown", 2), ("stop", 1)]
    said = metrics.describe(metrics.region_anatomy(calls, ["app_id"]), found, ["app_id"]).first().description
    assert said.startswith("This callsite sends ") and "instructions, the same in every call" in said and "of the user turn" in said and "2 of 5 answers" in said and said.endswith("is spread over 2 models.")
    none = calls.limit(0)
    assert metrics.response_anatomy(none, ["app_id"]).count() == 0
    unknown = metrics.response_anatomy(calls.withColumn("completion_tokens", F.lit(None).cast("long")), ["app_id"]).first()
    assert (unknown.completion_p50, unknown.completion_p95) == (0, 0)


def test_signature_and_explanation(spark):
    rows = [call(k, [("system", BILLING), ("user", f"u{k}")], tools=["pay"] if k else []) for k in range(3)] + [call(9, [("user", "a\nb")])]
    fp = facts.fingerprints(frame(spark, rows))
    r = identity.identity_signature(fp, ["app_id"]).first()
    assert (r.with_system_prompt, r.with_user_template, r.weak_prompts, r.median_prompt_lines, r.distinct_tool_sets, r.shape, r.distinct_shapes, r.distinct_formats) == (3, 3, 1, 7, 2, "SU", 2, 1)
    assert [tuple(s) for s in r.shapes] == [("SU", 3), ("U", 1)]
    points, _ = identity.distinct_points(identity.noise_filter(fp))
    why = [x.why for x in identity.explained(identity.pair_scores(points), points).where("score > 0.5").collect()]
    assert why == ["prompt 1.00(w0.60) tools 0.00(w0.25) shape 1.00(w0.10) format 1.00(w0.05)"]


def test_tokens_and_longest_runs(spark):
    def loop(first, steps):
        messages, out = [("system", "s"), ("user", f"task {first}")], []
        for s in range(steps):
            out.append(call(first + s, list(messages), seconds=first + 10 * s, prompt_tokens=100, completion_tokens=None if s else 7, cached_tokens=s))
            messages += [("assistant", f"step {first}.{s}"), ("tool", "r")]
        return out

    report, runs, _ = chain.reconstruct(frame(spark, sum((loop(1000 * k, k) for k in range(1, 6)), [])))
    r = report.first()
    assert r["mode"] == "strict" and r.mean_run_tokens == (1500 + 35) // 5
    assert [(x.steps, x.prompt_tokens, x.completion_tokens, x.cached_tokens) for x in chain.longest_runs(runs).orderBy(F.desc("steps")).collect()] == [(5, 500, 7, 10), (4, 400, 7, 6), (3, 300, 7, 3)]


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_counted_ranks_are_those_of_the_array(spark, n):
    rows = spark.createDataFrame([("k", (j * 7) % 11) for j in range(n)] + [("k", None), ("empty", None)], "key string, v long")
    of = lambda q: nearest_rank(F.collect_list("v"), q)
    want = rows.where("key = 'k'").groupBy("key").agg(of(0.1).alias("low"), of(0.95).alias("high"), upper_median(F.collect_list("v")).alias("median")).first()
    got = counted_ranks(rows, ["key"], "v", {"low": rank_at(0.1), "high": rank_at(0.95), "median": lambda n: F.floor(n / 2)}).collect()
    assert [g.asDict() for g in got] == [want.asDict()]


def test_truth_from_files(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"callsite_of": {"r1": "a", "r2": "b"}, "ambiguous": ["r2"]}))
    (tmp_path / "t.csv").write_text("request_id,gt_callsite\nr1,a\nr1,\nr2,b\n")
    truth, unsure = read_truth(spark, f"{tmp_path}/t.json")
    assert {tuple(r) for r in truth.collect()} == {("r1", "a"), ("r2", "b")} and [r.request_id for r in unsure.collect()] == ["r2"]
    again, none = read_truth(spark, f"{tmp_path}/t.csv")
    assert {tuple(r) for r in again.collect()} == {("r1", "a"), ("r2", "b")} and none.count() == 0
    assigned = spark.createDataFrame([("app", "r1", "n"), ("app", "r2", None)], "app_id string, request_id string, node_id string")
    assert scoring.truth_scores(assigned, truth, unsure).first().coverage == 1.0
