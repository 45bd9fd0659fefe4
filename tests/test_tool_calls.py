"""Tool calls, tool schemas and usage as the export writes them, against plain code."""

import json

from pyspark.sql import functions as F

from callscope.functions.text import dumped_length, spaced_json
from callscope.operators.facts import call_facts
from callscope.operators.metrics import request_document
from callscope.plans.judge import hinted_wait, wait_before
from callscope.settings import Mapping
from callscope.sources.gateway import calls, load_report, validate

VALUES = [{}, [], {"a": 1, "b": [1, 2, {"c": "x, y: z"}]}, {"q": 'say "hi": , \\ done', "é": "naïve 漢字 😀"}, [{"k": None}, True, -1.5], "a,b:c", {"": {"": ""}}]


def test_spaced_json(spark):
    compact = [json.dumps(v, separators=(",", ":"), ensure_ascii=False) for v in VALUES]
    df = spark.createDataFrame(list(enumerate(compact)), "k int, j string")
    got = {r.k: (r.s, r.n) for r in df.select("k", spaced_json(F.col("j")).alias("s"), dumped_length(F.col("j")).alias("n")).collect()}
    assert got == {k: (json.dumps(v, ensure_ascii=False), len(json.dumps(v))) for k, v in enumerate(VALUES)}


def export(spark, mapping, rows):
    """rows: (id, call type, request, response)."""
    wide = [{c: None for c in mapping.needed()} | {mapping.request_id: i, mapping.call_type: t, mapping.request: json.dumps(q), mapping.response: json.dumps(a)} for i, t, q, a in rows]
    top = mapping.app_id_paths[-1].split(".")[0]
    wide = [w | {top: json.dumps({mapping.app_id_paths[-1].split(".")[1]: "shop"})} if "." in mapping.app_id_paths[-1] else w for w in wide]
    return spark.createDataFrame(wide, ", ".join(f"`{c}` string" for c in mapping.needed()))


REQUEST = {
    "messages": [
        {"role": "system", "content": "be kind"}, {"role": "user", "content": "pay it"},
        {"role": "assistant", "content": None, "tool_calls": [{"id": "t1", "type": "function", "function": {"name": "pay", "arguments": json.dumps({"to": "Zoë", "sum": 12, "notes": ["x"] * 30})}}]},
        {"role": "tool", "content": "paid"},
    ],
    "tools": [{"type": "function", "function": {"name": "pay", "description": "pays", "parameters": {"type": "object", "properties": {"to": {"type": "string"}, "sum": {"type": "number"}}}}}, {"type": "function", "function": {"name": "list", "description": "lists", "parameters": {}}}],
}


def test_whole_tool_calls_and_sorted_parameters(spark):
    mapping = Mapping()
    checked = validate(export(spark, mapping, [("r1", "completion", REQUEST, {"usage": {}})]), mapping)
    one = calls(checked, mapping)
    history = sum(len(m["content"] or "") + len(json.dumps(m.get("tool_calls") or [])) for m in REQUEST["messages"][2:])
    assert call_facts(one).collect()[0].history_tokens == history // 4
    want = []
    for t in REQUEST["tools"]:
        f = t["function"]
        want += [f"TOOL {f['name']}: {f['description']}"] + ([json.dumps(f["parameters"], sort_keys=True)] if f["parameters"] else [])
    want += [f"[{m['role']}] {m['content'] or ''}" for m in REQUEST["messages"]]
    assert one.select(request_document(F.col("messages"), F.col("tools")).alias("d")).first().d == "\n".join(want)


def test_empty_usage_and_no_types(spark):
    rows = [("a", "completion", REQUEST, {"usage": {}}), ("b", "completion", REQUEST, {"usage": {"prompt_tokens": 3}}), ("c", "embedding", REQUEST, {})]
    mapping = Mapping()
    report = load_report(validate(export(spark, mapping, rows), mapping), mapping).first()
    assert (report.loaded, report.skipped_non_chat, report.missing_usage) == (2, 1, 1)
    open_mapping = Mapping(chat_types=())
    report = load_report(validate(export(spark, open_mapping, rows), open_mapping), open_mapping).first()
    assert (report.loaded, report.skipped_non_chat) == (3, 0)


def test_waits():
    still = lambda: 0.0
    assert [wait_before(k, True, jitter=still) for k in range(4)] == [20.0, 40.0, 60.0, 70.0]
    assert [wait_before(k, False, jitter=still) for k in range(5)] == [1, 2, 4, 8, 8]
    assert wait_before(0, True, hinted_wait("429: try again in 6.5s")) == 7.5
    assert wait_before(3, True, hinted_wait("429: Try again in 200ms")) == 2.0
    assert hinted_wait("no words of it") is None and 20.0 <= wait_before(0, True) <= 23.0


def test_prefix_links_equal_plain_code(spark):
    """The latest earlier call whose history is a proper prefix, in time; one opening turn is common to all."""
    import random

    from callscope.operators.chain import prefix_links
    from callscope.settings import Settings

    rng = random.Random(9)
    rows, log = [], []
    for k in range(120):
        base = rng.choice(log)[1] if log and rng.random() < 0.7 else ["open"]
        keys = base + [f"k{rng.randrange(6)}.{len(base)}"] if rng.random() < 0.8 else ["open"]
        keys = ["/".join(keys[: i + 1]) if "/" not in keys[i] else keys[i] for i in range(len(keys))]
        log.append((k, keys))
        rows.append((f"r{k:03}", k, keys))
    df = spark.createDataFrame([("app", r, k, ks, ks[-1]) for r, k, ks in rows], "app_id string, request_id string, pos int, prefixes array<string>, key string")
    df = df.withColumn("ts", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("pos") * 40)).cast("timestamp_ntz"))
    settings = Settings()
    want = {}
    for r, k, ks in rows:
        before = [(j, p) for p, j, keys in rows if j < k and keys[-1] in ks[:-1] and (k - j) * 40 <= settings.link_seconds]
        if before:
            want[r] = max(before)[1]
    assert {x.request_id: x.parent for x in prefix_links(df, settings).collect()} == want and len(want) > 40


def test_every_line_is_matched(spark):
    """Lines beyond those that templates are learned from are matched too, in several tasks; what fits none is counted."""
    from callscope.operators import segment

    rows = [("a", k, f"order {k} shipped to town{k % 7}") for k in range(900)] + [("a", 900 + k, f"odd line {'x ' * (k + 3)}") for k in range(5)] + [(None, 1, "alone"), ("a", 2000, ""), ("a", 2001, None)]
    df = spark.createDataFrame(rows, "key string, pos long, line string").repartition(3)
    got = {(r.key, r.template): r.occurrences for r in segment.mine_fields(df, train_lines=50).collect()}
    assert got == {("a", "order <*> shipped to <*>"): 900, ("a", None): 5, (None, "alone"): 1}
    segment.MATCHED_LINES, before = 100, segment.MATCHED_LINES
    try:
        assert {(r.key, r.template): r.occurrences for r in segment.mine_fields(df, train_lines=50).collect()} == got
    finally:
        segment.MATCHED_LINES = before


def test_pruned_lookup_keeps_callsites_without_anchors(spark):
    from callscope.operators.match import lookup

    common = [f"common line {k}" for k in range(6)]
    known = [(f"n{k}", "app", common, [f"tool{k}"], "su") for k in range(200)]
    known_df = spark.createDataFrame(known, "node_id string, app_id string, template array<string>, tools array<string>, shape string")
    requests = spark.createDataFrame([("r", "app", common, ["tool17"], "su")], "request_id string, app_id string, lines array<string>, tools array<string>, shape string")
    full, pruned = (lookup(requests, known_df, prune=p).collect()[0] for p in (False, True))
    assert full == pruned and full.node_id == "n17"
