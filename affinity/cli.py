"""Command line: ``analyze FILE`` and ``sample``."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import uuid

from pyspark.sql import SparkSession

from affinity import SCHEMA_VERSION
from affinity.errors import AffinityError
from affinity.operators.network import CLUSTER_MODES
from affinity.plans import report
from affinity.plans.analysis import analyze_path
from affinity.settings import Settings
from affinity.sources.synth import write_sample


class JsonFormatter(logging.Formatter):
    """Log lines as JSON; they name files and counts, never what is in them."""

    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"level": record.levelname, "logger": record.name, "message": record.getMessage()})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="affinity", description="Analyse an export of connections.")
    p.add_argument("--version", action="version", version=SCHEMA_VERSION)
    settings = Settings.from_env()
    p.add_argument("--log-level", default=settings.log_level)
    p.add_argument("--log-json", action="store_true", default=settings.log_json)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("file")
    for flag in ("--json", "--markdown", "--summary", "--pretty", "--redact", "--no-graph"):
        a.add_argument(flag, action="store_true")
    a.add_argument("--out")
    a.add_argument("--title", default="Network report")
    a.add_argument("--cluster-by", choices=CLUSTER_MODES, default="company")
    s = sub.add_parser("sample")
    s.add_argument("--out", required=True)
    s.add_argument("--count", type=int, default=600)
    s.add_argument("--seed", type=int, default=42)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done; 1: the file cannot be used; 2: there is no such file; 130: interrupted."""
    args = parser().parse_args(argv)
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonFormatter() if args.log_json else logging.Formatter("%(levelname)s %(name)s: %(message)s"))
    logging.basicConfig(level=args.log_level.upper(), handlers=[handler], force=True)
    log = logging.getLogger("affinity.cli")
    if args.command == "analyze" and not os.path.exists(args.file):
        log.error("there is no file %s", args.file)
        return 2
    spark, settings = spark or SparkSession.builder.appName("affinity").getOrCreate(), Settings.from_env()
    # one group for each run: its jobs can be told apart, and ended, by it
    spark.sparkContext.setJobGroup(f"affinity-{uuid.uuid4().hex[:12]}", args.command, interruptOnCancel=True)
    try:
        if args.command == "sample":
            write_sample(spark, args.out, args.count, args.seed)
            return 0
        doc = analyze_path(spark, args.file, cluster_by=args.cluster_by, redact=args.redact or settings.redact, include_graph=not args.no_graph, max_nodes=settings.max_graph_nodes, max_bytes=settings.max_upload_bytes)
    except AffinityError as e:
        log.error("%s", e)
        return 1
    except KeyboardInterrupt:
        return 130
    text = report.markdown(doc, args.title) if args.markdown else report.summary(doc) if args.summary else json.dumps(doc, indent=2 if args.pretty else None, ensure_ascii=False)
    if args.out:
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
