"""Command line: analyze, impact, callers, callees, search, serve."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .session import SourceGraph


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sparkloom")
    parser.add_argument("--db", default="source-graph")
    commands = parser.add_subparsers(dest="command", required=True)
    analyze = commands.add_parser("analyze")
    analyze.add_argument("repo")
    analyze.add_argument("--force", action="store_true")
    for name in ("impact", "callers", "callees"):
        command = commands.add_parser(name)
        command.add_argument("symbol")
        command.add_argument("--depth", type=int, default=2)
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--k", type=int, default=10)
    serve = commands.add_parser("serve")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _arguments().parse_args(argv)
    session = SourceGraph(spark or SparkSession.builder.appName("sparkloom").getOrCreate(), args.db)
    if args.command == "analyze":
        status = session.analyze(args.repo, args.force)
        print(json.dumps(status, ensure_ascii=False, default=list))
        if not status.get("files"):
            print("no source files", file=sys.stderr)
            return 1
    elif args.command == "impact":
        print(json.dumps(session.impact(args.symbol, args.depth), ensure_ascii=False, indent=2))
    elif args.command == "search":
        found = session.search(args.query, args.k)
        print(f"mode: {found['mode']}")
        for r in found["results"]:
            print(f"{r['score']:.4f} [{r['sources']}] {r['id']} ({r['file']})")
        if not found["results"]:
            print("no hits")
    elif args.command == "serve":
        from .server import serve

        serve(session, args.host, args.port)
    else:
        side = args.command[:-1]
        for r in getattr(session, args.command)(args.symbol, args.depth):
            print(f"[depth {r['depth']}] {r[side]}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
