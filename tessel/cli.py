"""Command line: ``python -m tessel.cli index|status|stats|query|graph|project ...``; answers are JSON."""

from __future__ import annotations

import argparse
import inspect
import json
import os
import sys

from tessel.plans.build import Index
from tessel.session import local_session
from tessel.sources.files import find_config, load_config, resolve_roots, scan
from tessel.tools import graphs, queries
from tessel.tools.html import page
from tessel.tools.registry import Registry

TOOLS = {
    name: f for name, f in inspect.getmembers(queries, inspect.isfunction) if f.__module__ == queries.__name__ and next(iter(inspect.signature(f).parameters), "") == "t" and name.split("_")[0] in ("get", "resolve", "analyze", "trace", "search")
}


def main(args: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="tessel")
    parser.add_argument("--index", default=".tessel/index", help="folder of the published index")
    parser.add_argument("--roots", help="add-on paths, ':' or ',' between them")
    parser.add_argument("--registry", default=os.path.expanduser("~/.tessel/projects.json"))
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("--force", action="store_true")
    sub.add_parser("status")
    sub.add_parser("stats")
    q = sub.add_parser("query")
    q.add_argument("tool", choices=sorted(TOOLS))
    q.add_argument("values", nargs="*", help="name=value, or values in the tool's order")
    g = sub.add_parser("graph")
    g.add_argument("--start", help="a node id such as m:name; the whole graph without it")
    g.add_argument("--depth", type=int, default=1)
    g.add_argument("--out", required=True)
    p = sub.add_parser("project")
    p.add_argument("action", choices=["add", "list", "info", "remove", "use"])
    p.add_argument("name", nargs="?")
    a = parser.parse_args(args)

    def answer(value) -> int:
        print(json.dumps(value, default=str, ensure_ascii=False, indent=1))
        return int(isinstance(value, dict) and "error" in value)

    if a.command == "project":
        registry = Registry(a.registry)
        if a.action == "list":
            return answer(registry.list())
        if a.action == "add":
            return answer(registry.add(a.name, resolve_roots(a.roots), os.path.abspath(a.index)))
        if a.action == "remove":
            return answer({"removed": registry.remove(a.name)})
        if a.action == "use":
            registry.set_active(a.name)
        return answer(registry.get(a.name) or {"error": "no such project"})

    spark = spark or local_session("*")
    folder = a.index if "://" in a.index else f"file://{os.path.abspath(a.index)}"
    index = Index(spark, folder)

    def files():
        config = find_config(".")
        return scan(spark, resolve_roots(a.roots), load_config(config)["exclude"] if config else [])

    if a.command == "index":
        return answer(index.build(files(), a.force))
    if a.command == "status":
        return answer(index.status(files() if a.roots or find_config(".") else None))
    if a.command == "stats":
        return answer(index.status().get("counts", {"error": "no index"}))
    tables = index.tables()
    if a.command == "query":
        named = dict(v.split("=", 1) for v in a.values if "=" in v)
        return answer(TOOLS[a.tool](tables, *(v for v in a.values if "=" not in v), **{k: int(v) if v.isdigit() else v for k, v in named.items()}))
    found = graphs.edges(tables)
    if a.start:
        found = graphs.around(found, a.start, a.depth)
    small = queries.rows(found.orderBy("src", "dst", "type", "label"), 5000)
    with open(a.out, "w") as f:
        f.write(page(a.start or "all", sorted({x[k] for x in small for k in ("src", "dst")}), small))
    return answer({"edges": len(small), "file": a.out})


if __name__ == "__main__":
    sys.exit(main())
