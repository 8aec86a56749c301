"""Command line: index, search, clear, status, serve (JSON-RPC over standard input and output)."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tessera.plans.engine import Engine
from tessera.settings import Settings

TOOLS = {"index_codebase": ("path",), "search_code": ("path", "query"), "clear_index": ("path",), "get_indexing_status": ("path",)}


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tessera").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def call(engine: Engine, tool: str, given: dict) -> dict:
    if tool not in TOOLS:
        raise ValueError(f"unknown tool {tool!r}")
    for name in TOOLS[tool]:
        if not given.get(name):
            raise ValueError(f"{name} is required")
    if tool == "index_codebase":
        return engine.index(given["path"], background=True)
    if tool == "search_code":
        return engine.search_code(given["path"], given["query"], int(given.get("top_n") or 0))
    return engine.clear(given["path"]) if tool == "clear_index" else engine.status(given["path"])


def respond(engine: Engine, line: str) -> str | None:
    """The answer to one JSON-RPC line; none to a notification."""
    request: dict = {}
    try:
        request = json.loads(line)
        if request["method"] == "initialize":
            result = {"protocolVersion": request.get("params", {}).get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "tessera", "version": "1"}}
        elif request["method"] == "tools/list":
            kind = lambda n: {"type": "integer" if n == "top_n" else "string"}
            result = {"tools": [{"name": t, "inputSchema": {"type": "object", "properties": {n: kind(n) for n in (*need, *(("top_n",) if t == "search_code" else ()))}, "required": list(need)}} for t, need in TOOLS.items()]}
        elif request["method"] == "tools/call":
            got = call(engine, request["params"]["name"], request["params"].get("arguments", {}))
            result = {"content": [{"type": "text", "text": json.dumps(got)}], "structuredContent": got}
        elif "id" not in request:
            return None
        else:
            return json.dumps({"jsonrpc": "2.0", "id": request["id"], "error": {"code": -32601, "message": "unknown method"}})
        return json.dumps({"jsonrpc": "2.0", "id": request["id"], "result": result}) if "id" in request else None
    except Exception as e:  # an answer, not the end of the server
        return json.dumps({"jsonrpc": "2.0", "id": request.get("id") if isinstance(request, dict) else None, "error": {"code": -32602, "message": str(e)[:500]}})


def serve(engine: Engine) -> None:
    out = sys.stdout
    sys.stdout = sys.stderr  # standard output is the protocol's
    for line in sys.stdin:
        if line.strip() and (answer := respond(engine, line)):
            print(answer, file=out, flush=True)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("index", "search", "clear", "status"):
        p = sub.add_parser(name)
        p.add_argument("path")
        if name == "search":
            p.add_argument("query")
            p.add_argument("-n", "--top-n", type=int, default=10)
        if name == "clear":
            p.add_argument("--reset-model", action="store_true")
    sub.add_parser("serve")
    args = parser.parse_args(argv)  # exits with 2 on an unknown command
    settings = Settings.from_env()
    if settings.low_priority and hasattr(os, "nice"):
        try:
            os.nice(10)
        except OSError as e:
            print(f"could not lower the priority: {e}", file=sys.stderr)
    engine = Engine(session(), settings)
    if args.command == "serve":
        serve(engine)
        return 0
    if args.command == "index":
        begun = time.time()
        got = engine.index(args.path) | engine.status(args.path) | {"seconds": round(time.time() - begun, 1)}
    elif args.command == "search":
        got = engine.search_code(args.path, args.query, args.top_n)
    else:
        got = engine.clear(args.path, args.reset_model) if args.command == "clear" else engine.status(args.path)
    print(json.dumps(got, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
