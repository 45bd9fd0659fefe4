import csv
import json

import pytest

from callscope.settings import Mapping, Settings, load_mapping, resolve
from callscope.sources import gateway

COLUMNS = ["request_id", "startTime", "model", "request_payload", "response_payload", "client_metadata", "call_type"]


def row(k, app="one", **more):
    request = {"messages": [{"role": "system", "content": 'He said "go",\nthen left'}, {"role": "user", "content": f"q{k}"}], "labels": {"vz_key_name": app}}
    response = {"choices": [{"message": {"role": "assistant", "content": "fine"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 100, "completion_tokens": 5, "prompt_tokens_details": {"cached_tokens": 40}}}
    base = {"request_id": f"r{k}", "startTime": f"2024-05-01T00:00:{k:02}+02:00", "model": "m", "request_payload": json.dumps(request), "response_payload": json.dumps(response), "client_metadata": "", "call_type": "acompletion"}
    return base | more


def load(spark, tmp_path, rows, columns=COLUMNS, settings=Settings()):
    path = tmp_path / "export.csv"
    with path.open("w", newline="") as f:
        writer = csv.DictWriter(f, columns, extrasaction="ignore")
        writer.writeheader()
        writer.writerows(rows)
    found, missing = gateway.read_export(spark, str(path))
    checked = gateway.validate(found).cache()
    return gateway.calls(checked, settings=settings).orderBy("ts").collect(), gateway.load_report(checked).first().asDict(), missing


def test_dirt(spark, tmp_path):
    two = json.loads(row(0)["request_payload"])
    rows = [
        row(1), row(2, request_payload='{"messages": [{"role"'), row(3, call_type="aembedding"), row(4, response_payload=json.dumps({"choices": []})),
        row(5, request_payload=json.dumps(two | {"labels": {}}), client_metadata=json.dumps({"headers": {"x-subject": "two"}})),
        row(6, client_metadata=json.dumps({"headers": {"x-subject": "two"}})), row(7, request_payload=json.dumps(two | {"labels": {}})),
        row(8, request_payload=json.dumps(two | {"messages": []})), row(9, request_id=""), row(10, call_type="", model=""), row(11, startTime="never"),
        row(12, request_payload=json.dumps(two | {"messages": ["junk", {"role": "user", "content": [{"type": "text", "text": "a"}]}, {"role": "user", "content": None}]})), row(13, response_payload="not json"),
    ]
    calls, report, missing = load(spark, tmp_path, rows)
    assert missing == []
    assert {k: report[k] for k in ("total_rows", "skipped_unparseable", "skipped_non_chat", "skipped_no_app_id", "skipped_no_messages", "app_id_disagreements", "from_1", "missing_usage")} == {
        "total_rows": 13, "skipped_unparseable": 1, "skipped_non_chat": 1, "skipped_no_app_id": 1, "skipped_no_messages": 1, "app_id_disagreements": 1, "from_1": 1, "missing_usage": 2,
    }
    by_id = {c.request_id: c for c in calls}
    assert report["loaded"] == len(calls) == 9 and report["synthesised_ids"] == 1
    assert by_id["r1"].cached_tokens == 40 and by_id["r4"].cached_tokens is None and by_id["r5"].app_id == "two" and by_id["r6"].app_id == "one"
    assert by_id["r1"].messages[0].content == 'He said "go",\nthen left' and str(by_id["r1"].ts) == "2024-05-01 00:00:01"
    assert any(i.startswith("synth-") for i in by_id) and by_id["r10"].model == "unknown" and by_id["r11"].ts.year == 1
    assert [m.content for m in by_id["r12"].messages] == ['[{"text":"a","type":"text"}]', ""]


def test_cap_missing_columns_and_required_ones(spark, tmp_path):
    calls, _, missing = load(spark, tmp_path, [row(k) for k in range(10)], [c for c in COLUMNS if c != "client_metadata"], Settings(rows_per_app=3))
    assert [c.request_id for c in calls] == ["r0", "r1", "r2"] and missing == ["client_metadata"]
    with pytest.raises(ValueError):
        load(spark, tmp_path, [row(1)], [c for c in COLUMNS if c != "response_payload"])


def test_settings(tmp_path):
    assert resolve(tau=None, nothing=3, node_floor=5) == Settings(node_floor=5)
    (tmp_path / "m.yaml").write_text("columns: {request: req}\napp_id_paths: [req.user]\n")
    mapping = load_mapping(tmp_path / "m.yaml")
    assert mapping.request == "req" and "req" in mapping.needed() and mapping.response == Mapping().response
