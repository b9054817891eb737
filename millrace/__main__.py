"""Command line: ``python -m millrace run|detect|explain|list-formats|version``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .operators.detection import BUILTIN, REGISTERED, list_formats
from .plans.options import Config, SiftOptions, apply_config, dedupe_window, discover, merge, parse_config

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace")
    top.add_argument("--config", type=Path)
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("run", "detect", "explain"):
        p = sub.add_parser(name)
        p.add_argument("files", nargs="*", help="[FORMAT] [FILE...]; several files are read as one log, none or - is standard input")
        p.add_argument("--auto", action="store_true")
        p.add_argument("--strip-envelope", dest="envelope")
        p.add_argument("--severity")
        p.add_argument("--keep-warnings", action="store_true", default=None)
        p.add_argument("--keep-vendor", action="store_true", default=None)
        p.add_argument("--context", type=int)
        p.add_argument("--max-events", type=int)
        p.add_argument("--budget", type=int)
        p.add_argument("--tokenizer")
        p.add_argument("--vocabulary", help="file of ranks for the exact tokenizer")
        p.add_argument("--dedupe", action="store_true")
        p.add_argument("--no-dedupe", action="store_true")
        p.add_argument("--dedupe-window", dest="window", type=int, default=-1)
        p.add_argument("--output", choices=["text", "markdown", "json"])
        p.add_argument("--output-streaming", action="store_true")
        p.add_argument("--no-footer", dest="footer", action="store_false", default=None)
        p.add_argument("--strict", action="store_true", default=None)
        p.add_argument("--passthrough", action="store_true", default=None)
        p.add_argument("--explain", action="store_true")
        p.add_argument("--print-config", action="store_true")
        p.add_argument("--list-formats", action="store_true")
        p.add_argument("--verbose", "-v", action="store_true")
    sub.add_parser("list-formats")
    sub.add_parser("version")
    return top


def options_of(args: argparse.Namespace, config: Config) -> tuple[SiftOptions, list[str]]:
    names = ("envelope", "severity", "keep_warnings", "keep_vendor", "context", "max_events", "budget", "tokenizer", "vocabulary", "output", "footer", "strict", "passthrough")
    given = {n: getattr(args, n) for n in names if getattr(args, n) is not None}
    files = list(args.files)
    known = {"auto", *BUILTIN, *REGISTERED, *(f.id for f in config.custom)}
    fmt = files.pop(0) if files and files[0] in known and not args.auto else "auto"
    if args.dedupe or args.no_dedupe or args.window >= 0:
        given["dedupe_window"] = dedupe_window(args.dedupe, args.no_dedupe, args.window)
    if args.output_streaming and given.get("output") == "json":
        given["output"] = "ndjson"
    return apply_config(SiftOptions(format=fmt, **given), config, set(given)), files


def main(argv: list[str]) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    paths = [args.config] if args.config else discover(Path.cwd(), Path.home())
    config = Config({}, {}, ())
    for path in paths:
        config = merge(config, parse_config(path.read_text()))
    if args.command == "list-formats" or args.list_formats:
        print("\n".join(list_formats(config.custom)))
        return 0
    options, files = options_of(args, config)
    if args.print_config:
        print(options)
        return 0
    from pyspark.sql import SparkSession

    from .plans.engine import detect_report, report_lines, sift_logs
    from .sources.logs import lines_of, read_concatenated, read_logs, read_stdin

    spark = SparkSession.builder.appName("millrace").getOrCreate()
    if files in ([], ["-"]):
        logs = read_stdin(spark, sys.stdin.buffer)
    else:
        logs = read_logs(spark, *files) if len(files) == 1 else read_concatenated(spark, *files)
    if args.command == "detect":
        code = 0
        for row in detect_report(lines_of(logs), options).toLocalIterator():
            code = max(code, row.exit_code)
            print("\n".join(report_lines(row)))
        return code
    result = sift_logs(logs, options)
    if args.verbose:
        for row in result.logs.toLocalIterator():
            print(f"envelope: {row.envelope}\nformat: {row.format}\ntokenizer: {options.tokenizer}", file=sys.stderr)
    if args.command == "explain" or args.explain:
        for row in result.explain().orderBy("log_id", "part", "seq").toLocalIterator():
            print(row.line)
        return 0
    sys.stdout.flush()
    for row in result.render().selectExpr("cast(text as binary) as text").toLocalIterator():
        sys.stdout.buffer.write(row.text)
    sys.stdout.buffer.flush()
    return max((row.exit_code for row in result.summary.select("exit_code").toLocalIterator()), default=1)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
