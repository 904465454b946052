"""Command line: scan, doctor, config, version."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from .operators import exploitability, findings, rules
from .plans import scan as plans
from .sinks import reports
from .sources import corpus

FORMATS = tuple(reports.KINDS)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sastra")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("path")
    s.add_argument("--severity", nargs="*", choices=list(findings.ENVIRONMENTS["dev"]))
    s.add_argument("--format", choices=FORMATS, default="text")
    s.add_argument("--output")
    s.add_argument("--fail-on", choices=list(findings.ENVIRONMENTS["dev"]))
    s.add_argument("--quiet", action="store_true")
    s.add_argument("--custom-rules")
    s.add_argument("--config")
    s.add_argument("--env", choices=list(findings.ENVIRONMENTS))
    s.add_argument("--exploitability", action="store_true")
    s.add_argument("--plugin", action="append", default=[], help="Python file with analyze(path, text)")
    s.add_argument("--parts", help="folder for the report as parts that executors write")
    s.add_argument("--drift", help="folder of the last scan's state")
    for name in ("doctor", "config", "version"):
        sub.add_parser(name)
    return p


def run_scan(spark: SparkSession, args: argparse.Namespace) -> int:
    out = sys.stdout
    custom = corpus.load_rules(spark, args.custom_rules, "customPatterns") if args.custom_rules else ()
    config = corpus.load_config(spark, args.config) if args.config else None
    chosen = findings.gate(args.env, args.severity) if args.env or args.severity else None
    plugins = plans.Plugins()
    for path in args.plugin:
        plugins.load(path)
    found = plans.scan(corpus.scan_directory(spark, args.path), chosen, custom, config=config, plugins=plugins).persist()
    if args.drift:
        try:
            before = corpus.load_state(spark, args.drift)
            print(f"new {findings.drift_new(found, before).count()}, resolved {findings.drift_resolved(found, before).count()}", file=out)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            print("first scan", file=out)
    if args.exploitability:
        s = exploitability.summary(exploitability.score(found)).first()
        print(f"exploitability: average {s['average']}, max {s['max']}, critical {s['critical_count']} of {s['total']}", file=out)
    now = datetime.now(UTC).isoformat()
    if args.parts:
        reports.write_report(args.format, found, args.parts, args.path, now)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.writelines(f"{x}\n" for x in reports.report_pieces(args.format, found, args.path, now))
    elif not args.quiet and not args.parts:
        print(reports.report_text(args.format, found, args.path, now), file=out)
    code = int(bool(args.fail_on) and findings.fails(found, args.fail_on))
    if args.drift:
        found_state = found.select("rule_id", "file_path", "line", "severity", "cwe", "message")
        corpus.save_state(found_state, args.drift)
    return code


def doctor(spark: SparkSession) -> list[str]:
    stats = findings.catalog_stats(rules.rules_frame(spark)).first()
    return [f"Spark {spark.version}", plans.describe(), f"languages: {', '.join(stats['languages'])}"]


def main(argv=None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(reports.VERSION)
        return 0
    if args.command == "config":
        print({k: ", ".join(v) for k, v in findings.ENVIRONMENTS.items()})
        return 0
    spark = SparkSession.builder.appName("sastra").getOrCreate()
    if args.command == "doctor":
        print("\n".join(doctor(spark)))
        return 0
    return run_scan(spark, args)


if __name__ == "__main__":
    sys.exit(main())
