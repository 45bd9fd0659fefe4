"""Small calls in the shape the operators take."""

import json
from datetime import datetime, timedelta

DDL = """request_id string, app_id string, ts timestamp_ntz, model string, messages array<struct<role:string,content:string,tool_calls:array<string>>>,
tools array<struct<name:string,description:string,schema_json:string>>, response_text string, response_tool_calls array<string>, finish_reason string,
prompt_tokens long, completion_tokens long, cached_tokens long, response_format string, request_json string, response_json string"""
START = datetime(2024, 5, 1)


def call(k, messages, app="app", tools=(), seconds=None, **more):
    rows = [(m[0], m[1], list(m[2]) if len(m) > 2 else []) for m in messages]
    own = [(t, f"does {t}", json.dumps({"name": t, "fields": ["x"] * 20})) for t in tools]
    base = {
        "request_id": f"r{k:04}", "app_id": app, "ts": START + timedelta(seconds=k if seconds is None else seconds), "model": "m1", "messages": rows, "tools": own, "response_text": "ok",
        "response_tool_calls": [], "finish_reason": "stop", "prompt_tokens": None, "completion_tokens": 10, "cached_tokens": None, "response_format": None,
        "request_json": json.dumps({"messages": rows}), "response_json": "{}",
    }
    base |= more
    return tuple(base.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL)


SUPPORT = "\n".join(["You answer support questions.", "Be brief.", "Cite the manual.", "Never promise refunds.", "Use plain words.", "Close politely.", "Ask if unsure."])
BILLING = "\n".join(["You sort invoices by vendor.", "Return one JSON object.", "Amounts are in cents.", "Dates are ISO.", "Skip drafts.", "Keep the order.", "No comments."])
