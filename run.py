"""Profile an export: python run.py --csv FILE [--mapping YAML] [--out DIR] [--tau X] [--max-rows-per-app N] [--no-registry] [--judge-url URL --judge-model NAME]."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--csv", required=True)
    parser.add_argument("--format", default="csv", choices=["csv", "parquet"])
    parser.add_argument("--mapping")
    parser.add_argument("--out", default="out")
    parser.add_argument("--tau", type=float)
    parser.add_argument("--max-rows-per-app", type=int)
    parser.add_argument("--no-registry", action="store_true")
    parser.add_argument("--judge-url", help="chat-completions address of a judge; without it nothing is judged")
    parser.add_argument("--judge-model")
    parser.add_argument("--judge-tokens-per-minute", type=int)
    parser.add_argument("--judge-cache", help="folder of answers, by default within --out")
    args = parser.parse_args(argv)
    if args.judge_url and not args.judge_model:
        parser.error("--judge-url needs --judge-model")

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from callscope.operators.registry import Store
    from callscope.plans import judge as judging
    from callscope.plans import report
    from callscope.plans.audit import Audit
    from callscope.plans.profile import profile
    from callscope.settings import Mapping, load_mapping, resolve, secret
    from callscope.sources import gateway, store

    spark = SparkSession.builder.getOrCreate()
    mapping = load_mapping(args.mapping) if args.mapping else Mapping()
    rows_per_app = args.max_rows_per_app if args.max_rows_per_app is not None else mapping.options.get("max_rows_per_app")
    settings = resolve(tau=args.tau, rows_per_app=rows_per_app)
    out = Path(args.out, time.strftime("run-%Y%m%d-%H%M%S"))
    out.mkdir(parents=True, exist_ok=True)
    audit = Audit(str(out / "audit.jsonl"))
    rows, missing = gateway.read_export(spark, args.csv, mapping, args.format)
    audit.event("missing_columns", columns=missing)
    checked = gateway.validate(rows, mapping)
    audit.event("loaded", **gateway.load_report(checked, mapping).first().asDict())
    left_out = gateway.capped_apps(checked, settings).agg(F.count(F.lit(1)).alias("apps"), (F.sum("rows") - F.count(F.lit(1)) * settings.rows_per_app).alias("rows")).first()
    audit.event("capped_apps", rows_per_app=settings.rows_per_app, apps=left_out["apps"], rows_left_out=left_out["rows"] or 0)
    if left_out["apps"]:
        print(f"{left_out['rows']} rows of {left_out['apps']} apps are beyond {settings.rows_per_app} rows an app and are left out (--max-rows-per-app)", file=sys.stderr)
    judge = None
    if args.judge_url:
        pace = judging.Pace(args.judge_tokens_per_minute) if args.judge_tokens_per_minute else None
        judge = judging.CachedJudge(judging.chat_call(args.judge_url, args.judge_model, secret()), args.judge_model, args.judge_cache or str(Path(args.out, "judge-cache")), audit, pace)
    found = profile(spark, gateway.calls(checked, mapping, settings), out.name, args.csv, settings, judge, remember=None if args.no_registry else Store(spark, str(Path(args.out, "registry").resolve())), audit=audit)
    store.write(str(out.resolve()), found.tables)
    result = report.to_json(found)
    (out / "report.json").write_text(json.dumps(result, indent=1, default=str))
    (out / "report.md").write_text(report.markdown(result))
    report.html_site(found, result, str(out / "site"))
    audit.save_markdown(str(out / "audit.md"))
    return 0 if found.gate_passed else 2


if __name__ == "__main__":
    sys.exit(main())
