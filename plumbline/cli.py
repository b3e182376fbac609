"""Command line: ``python -m plumbline.cli COMMAND ...``.  Exit 2: no index or bad arguments; 1: nothing found, or cycles."""

from __future__ import annotations

import argparse
import json
import os
import sys

from plumbline import __version__, render
from plumbline.session import build_session

LANGUAGES = ("python", "javascript", "typescript", "tsx", "go")


def find_index(start: str) -> str:
    """The nearest ``.plumbline`` folder at or above ``start``, else the one that would be made there."""
    here = os.path.abspath(start)
    while True:
        found = os.path.join(here, ".plumbline")
        if os.path.isdir(found):
            return found
        above = os.path.dirname(here)
        if above == here:
            return os.path.join(os.path.abspath(start), ".plumbline")
        here = above


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    p.add_argument("--index", default=None, help="folder of the index; by default .plumbline here or in a folder above")
    p.add_argument("--master", default=None, help="Spark master; that of spark-submit by default")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple, limit: int | None = None, depth: int | None = None, confidence: float | None = None):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a[0], **(a[1] if len(a) > 1 else {}))
        if limit is not None:
            c.add_argument("--limit", type=int, default=limit)
        if depth is not None:
            c.add_argument("--depth", type=int, default=depth)
        if confidence is not None:
            c.add_argument("--min-confidence", type=float, default=confidence)

    command("index", ("root", {"nargs": "?", "default": "."}), ("--language", {"action": "append"}), ("--force", {"action": "store_true"}), ("--jobs", {"type": int, "help": "cores of a local run"}), ("--quiet", {"action": "store_true"}))
    command("find", ("name",), ("--kind",), ("--lang",), ("--exact", {"action": "store_true"}), limit=20)
    command("search", ("query",), limit=20)
    command("show", ("selector",), ("--source", {"action": "store_true"}), ("--root", {"default": "."}), depth=1)
    command("callers", ("selector",), limit=50, depth=2, confidence=0.5)
    command("calls", ("selector",), limit=50, depth=2, confidence=0.5)
    command("blast", ("target",), limit=60, depth=3, confidence=0.3)
    command("related", ("selector",), limit=15)
    command("file", ("path",))
    command("arch", ("--md", {"help": "file for the Markdown, in place of the screen"}))
    command("cycles")
    command("stats", ("--json", {"action": "store_true"}))
    command("serve")
    command("version")
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if a.command == "version":
        print(__version__)
        return 0
    if a.command == "index":
        unknown = [x for x in a.language or [] if x not in LANGUAGES]
        if unknown:
            print(f"unknown language: {', '.join(unknown)}; known: {', '.join(LANGUAGES)}", file=sys.stderr)
            return 2
    a.index = a.index or find_index(getattr(a, "root", None) or ".")
    spark = build_session("plumbline", a.master or (f"local[{a.jobs}]" if getattr(a, "jobs", None) else None))
    spark.sparkContext.setLogLevel("ERROR")
    from plumbline.service import Engine

    if a.command == "index":
        from plumbline.plans.index import build
        from plumbline.sources.tree import discover

        done = build(spark, discover(spark, a.root, a.language), a.index, a.force)
        if not a.quiet:
            print(f"version {done['version']}: " + ", ".join(f"{v} {k}" for k, v in sorted(done["states"].items())))
            for lang, states in sorted(done.get("languages", {}).items()):
                print(f"  {lang}: " + ", ".join(f"{v} {k}" for k, v in sorted(states.items())))
        for path, error in done["failures"]:
            print(f"failed: {path}: {error}", file=sys.stderr)
        return 0
    try:
        e = Engine.load(spark, a.index, getattr(a, "root", None))
    except FileNotFoundError as x:
        print(x, file=sys.stderr)
        return 2
    if a.command == "serve":
        from plumbline.serve import serve

        return serve(e)
    try:
        return show(e, a)
    except LookupError as x:
        print(x, file=sys.stderr)
        return 1


def warn_of_others(e, selector: str) -> None:
    """Names on standard error the symbols that a selector could mean as well."""
    found = e.candidates(selector, 5)
    if len(found) > 1:
        print(f"{selector!r} means {found[0]['qualname']}; others: " + ", ".join(r["qualname"] for r in found[1:]), file=sys.stderr)


def show(e, a) -> int:
    c = a.command
    if c in ("show", "callers", "calls", "related"):
        warn_of_others(e, a.selector)
    if c == "find":
        rows = e.find_symbols(a.name, a.kind, a.lang, a.limit, a.exact)
        print(render.symbols(rows))
        return 0 if rows else 1
    if c == "search":
        rows = e.search(a.query, a.limit)
        print(render.symbols(rows))
        return 0 if rows else 1
    if c == "show":
        print(render.detail(e.symbol_detail(a.selector, a.depth, a.source)))
    elif c in ("callers", "calls"):
        root, rows = (e.who_calls if c == "callers" else e.calls)(a.selector, a.depth, a.min_confidence, a.limit)
        print(render.tree(root, rows, c))
    elif c == "blast":
        print(render.blast(e.blast_radius(a.target, a.depth, a.min_confidence, a.limit)))
    elif c == "related":
        root, rows = e.related(a.selector, a.limit)
        print(render.symbols(rows))
    elif c == "file":
        print(render.file_summary(e.file_summary(a.path)))
    elif c == "arch":
        text = render.architecture(e.architecture(), 6000)
        if a.md:
            with open(a.md, "w", encoding="utf-8") as f:
                f.write(text + "\n")
        else:
            print(text)
    elif c == "cycles":
        found = 0
        for row in e.cycles().toLocalIterator():
            found = 1
            print(" -> ".join(row["members"]))
        if not found:
            print("No cycles.")
        return found
    elif c == "stats":
        s = e.stats()
        print(json.dumps(s) if a.json else render.stats(s))
    return 0


if __name__ == "__main__":
    sys.exit(main())
