"""The questions as tools of the Model Context Protocol: JSON-RPC, a message per line, over standard input and output."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import TextIO

from plumbline import __version__, render

_SHARE = {"type": "number", "minimum": 0, "maximum": 1}


def _clamp(value, low, high, default):
    return default if value is None else max(low, min(high, value))


def tools(e) -> dict[str, tuple[str, dict, Callable[[dict], str]]]:
    """name: (description, properties, function of the arguments)."""

    def walk(f, word):
        return lambda a: render.tree(*f(a["selector"], _clamp(a.get("depth"), 1, 6, 2), _clamp(a.get("min_confidence"), 0, 1, 0.5), _clamp(a.get("limit"), 1, 200, 50)), word)

    text = {"type": "string"}
    upto = lambda n: {"type": "integer", "minimum": 1, "maximum": n}
    steps = {"selector": text, "depth": upto(6), "min_confidence": _SHARE, "limit": upto(200)}
    return {
        "find_symbols": ("Symbols by name, the most used first.", {"name": text, "kind": text, "lang": text, "limit": upto(100)}, lambda a: render.symbols(e.find_symbols(a["name"], a.get("kind"), a.get("lang"), _clamp(a.get("limit"), 1, 100, 20)))),
        "search_code": ("Full-text search over names, signatures and documentation.", {"query": text, "limit": upto(100)}, lambda a: render.symbols(e.search(a["query"], _clamp(a.get("limit"), 1, 100, 20)))),
        "get_symbol": ("A symbol with its callers, callees and members.", {"selector": text, "depth": upto(4), "include_source": {"type": "boolean"}}, lambda a: render.detail(e.symbol_detail(a["selector"], _clamp(a.get("depth"), 1, 4, 1), bool(a.get("include_source"))))),
        "who_calls": ("Callers, level by level.", steps, walk(e.who_calls, "callers")),
        "what_it_calls": ("Callees, level by level.", steps, walk(e.calls, "calls")),
        "blast_radius": ("Files, symbols and tests that a change affects.", {"target": text, "depth": upto(6), "limit": upto(300)}, lambda a: render.blast(e.blast_radius(a["target"], _clamp(a.get("depth"), 1, 6, 3), limit=_clamp(a.get("limit"), 1, 300, 60)))),
        "related_symbols": ("Symbols near one in the call graph.", {"selector": text, "limit": upto(50)}, lambda a: render.symbols(e.related(a["selector"], _clamp(a.get("limit"), 1, 50, 15))[1])),
        "file_summary": ("A file's symbols, imports and importers.", {"path": text}, lambda a: render.file_summary(e.file_summary(a["path"]))),
        "architecture_overview": ("Modules, layers, cycles, hotspots and entry points.", {}, lambda a: render.architecture(e.architecture())),
        "index_stats": ("Counts and resolution rates.", {}, lambda a: render.stats(e.stats())),
    }


def resources(e) -> dict[str, tuple[str, Callable[[], str]]]:
    """address: (what it is, function that reads it)."""
    return {"plumbline://architecture": ("Overview of the workspace", lambda: render.architecture(e.architecture())), "plumbline://stats": ("Counts and rates of the index", lambda: render.stats(e.stats()))}


#: name: (description, arguments, text with places for them).
PROMPTS = {
    "orient": (
        "Get to know a workspace before changing it.", ["task"],
        "Task: {task}\nFirst read the architecture overview and find the symbols that the task names. For each of them look at its callers, and before you change one at what the change affects; name the tests to run.",
    )
}


def _about(method: str, params: dict, read: dict) -> dict | None:
    """Results of the methods on resources and prompts; None for other methods, KeyError for unknown names."""
    if method == "resources/list":
        return {"resources": [{"uri": u, "name": d, "mimeType": "text/markdown"} for u, (d, _) in read.items()]}
    if method == "resources/read":
        return {"contents": [{"uri": params["uri"], "mimeType": "text/markdown", "text": read[params["uri"]][1]()}]}
    if method == "prompts/list":
        return {"prompts": [{"name": n, "description": d, "arguments": [{"name": a, "required": False} for a in args]} for n, (d, args, _) in PROMPTS.items()]}
    if method == "prompts/get":
        description, args, text = PROMPTS[params["name"]]
        given = params.get("arguments") or {}
        return {"description": description, "messages": [{"role": "user", "content": {"type": "text", "text": text.format(**{a: given.get(a, "not given") for a in args})}}]}
    return None


def answer(message: dict, offered: dict, read: dict | None = None) -> dict | None:
    """The reply to a message; None for notifications.  A tool's failure is text for the reader, not a protocol error."""
    method, number = message.get("method"), message.get("id")
    if number is None:
        return None
    reply = lambda result: {"jsonrpc": "2.0", "id": number, "result": result}
    if method == "initialize":
        version = message.get("params", {}).get("protocolVersion", "2024-11-05")
        return reply({"protocolVersion": version, "capabilities": {"tools": {}, "resources": {}, "prompts": {}}, "serverInfo": {"name": "plumbline", "version": __version__}})
    if method == "ping":
        return reply({})
    if method == "tools/list":
        return reply({"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": list(p)[:1]}} for n, (d, p, _) in offered.items()]})
    if method == "tools/call":
        params = message.get("params", {})
        tool = offered.get(params.get("name"))
        if tool is None:
            return {"jsonrpc": "2.0", "id": number, "error": {"code": -32602, "message": f"unknown tool {params.get('name')}"}}
        try:
            return reply({"content": [{"type": "text", "text": tool[2](params.get("arguments") or {})}]})
        except Exception as x:
            return reply({"content": [{"type": "text", "text": f"**{type(x).__name__}**: {x}"}], "isError": True})
    try:
        result = _about(method, message.get("params") or {}, read or {})
    except KeyError as x:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": -32602, "message": f"unknown: {x}"}}
    if result is not None:
        return reply(result)
    return {"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"unknown method {method}"}}


def serve(engine, read: TextIO = sys.stdin, write: TextIO = sys.stdout) -> int:
    offered, read_ = tools(engine), resources(engine)
    for line in read:
        if line.strip():
            try:
                out = answer(json.loads(line), offered, read_)
            except ValueError:
                out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if out is not None:
                print(json.dumps(out), file=write, flush=True)
    return 0
