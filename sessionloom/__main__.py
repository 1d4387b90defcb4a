"""Command line: mine (or a bare path), validate, stats. Exit codes: 0 fine, 1 leaks, 2 wrong usage."""

from __future__ import annotations

import argparse
import os
import platform
import sys

COMMANDS = ("mine", "validate", "stats")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sessionloom", description="Mine session logs; a bare path means mine.")
    out.add_argument("command", choices=COMMANDS)
    out.add_argument("path", nargs="?", default="")
    out.add_argument("-o", "--output", help="folder of the entries")
    out.add_argument("--content-root", help="folder of state and registry")
    for stage, model in (("extractor", "claude-code/sonnet"), ("tokeniser", "claude-code/haiku")):
        names = [f"--{stage}-model", *(["--tokenizer-model"] if stage == "tokeniser" else [])]
        out.add_argument(*names, default=model, dest=f"{stage}_model", help="provider/model")
        out.add_argument(*[n.replace("-model", "-effort") for n in names], dest=f"{stage}_effort", help="min, medium or high")
    out.add_argument("--concurrency", type=int, default=2, help="model calls at a time")
    out.add_argument("--dry-run", action="store_true", help="list what would be mined, write nothing")
    return out


def main(argv: list[str] | None = None, spark=None, say=print) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if not argv:
        say("usage: sessionloom <path> | mine <path> | validate [folder] | stats <path>")
        return 2
    if not any(a in COMMANDS for a in argv):
        argv.insert(0, "mine")
    try:
        args = parser().parse_args(argv)
        if args.command != "validate" and not args.path:
            say(f"usage: sessionloom {args.command} <path>")
            return 2
    except SystemExit as stop:
        return int(stop.code or 0)

    from pyspark.sql import SparkSession

    from sessionloom.config import EngineConfig, Stage, data_root
    from sessionloom.frames import stash
    from sessionloom.operators import backends, registry, tables
    from sessionloom.plans import pipeline

    spark = spark or SparkSession.builder.getOrCreate()
    root = data_root(platform.system(), os.path.expanduser("~"), os.environ.get("XDG_DATA_HOME"))
    config = EngineConfig(args.content_root or root, output=args.output or os.path.join(root, "entries"), udf_partitions=args.concurrency)
    if args.command == "stats":
        row = pipeline.stats(spark, args.path).first()
        say(f"{row.files} files, {row.bytes} bytes")
        return 0
    if args.command == "validate":
        known = tables.load(spark, config.registry, registry.SCHEMA)
        if known.isEmpty():
            say("the registry is empty: nothing to check against")
            return 0
        report = stash(pipeline.validate(spark, args.path or config.entries, known))
        for row in report.where("leaked").orderBy("path").toLocalIterator():
            say(f"LEAK {row.path}: {row.hit_count} hit(s), not changed")
        counts = {r.leaked: r.n for r in pipeline.validate_counts(report).collect()}
        say(f"{counts.get(False, 0)} clean, {counts.get(True, 0)} leaked")
        return 1 if counts.get(True) else 0
    try:
        config.extractor, config.tokeniser = (backends.Program(Stage.parse(getattr(args, f"{s}_model"), getattr(args, f"{s}_effort"))) for s in ("extractor", "tokeniser"))
    except ValueError as why:
        say(str(why))
        return 2
    if args.dry_run:
        for row in pipeline.plan(spark, args.path, config).select("session_key", "size_bytes").toLocalIterator():
            say(f"{row.session_key} ({row.size_bytes} bytes)")
        return 0
    result = pipeline.mine(spark, args.path, config)
    for row in result.paths.toLocalIterator():
        say(row.path)
    say(", ".join(f"{n} {name}" for name, n in result.counters.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
