"""Python facts from the interpreter's own syntax tree."""

from __future__ import annotations

import ast
import warnings

from plumbline.extract import Definition, Facts, clean_doc, docs_of, keep_refs, register, signature_of, specific

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def comment_above(lines: list[str], start: int) -> tuple[str | None, str | None]:
    """The comment lines that end directly above line ``start``."""
    got: list[str] = []
    k = start - 2
    while k >= 0 and lines[k].strip().startswith("#"):
        got.append(lines[k])
        k -= 1
    return docs_of(got[::-1])


class _Walk:
    def __init__(self, text: str):
        self.lines = text.splitlines()
        self.facts = Facts()

    def source(self, node: ast.AST, end: ast.AST | None = None) -> str:
        last, col = (end.lineno, end.col_offset) if end is not None else (node.end_lineno, node.end_col_offset)
        part = self.lines[node.lineno - 1 : last]
        if part:
            part[-1] = part[-1].encode()[:col].decode(errors="ignore")
            part[0] = part[0].encode()[node.col_offset :].decode(errors="ignore") if len(part) > 1 or last == node.lineno else part[0]
            if len(part) == 1 and node.lineno == last:
                part[0] = self.lines[node.lineno - 1].encode()[node.col_offset : col].decode(errors="ignore")
        return "\n".join(part)

    def define(self, node, name: str, kind: str, owner: list[tuple[str, str]], body=None) -> None:
        local = ".".join([o for o, _ in owner] + [name])
        doc = ast.get_docstring(node) if isinstance(node, _DEFS) else None
        first = min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])
        text, nearest = (clean_doc(doc), None) if doc else comment_above(self.lines, first)
        self.facts.symbols.append(
            Definition(
                name, local, kind, node.lineno, node.end_lineno or node.lineno, signature_of(self.source(node, body)),
                text, ".".join(o for o, _ in owner) or None, not name.startswith("_"), nearest,
            )
        )

    def visit(self, node: ast.AST, owner: list[tuple[str, str]], top: bool) -> None:
        src = ".".join(o for o, _ in owner) or None
        if isinstance(node, _DEFS):
            for d in node.decorator_list:
                self.visit(d, owner, False)
            is_class = isinstance(node, ast.ClassDef)
            kind = "class" if is_class else "method" if owner and owner[-1][1] == "class" else "function"
            self.define(node, node.name, kind, owner, node.body[0])
            inner = [*owner, (node.name, kind)]
            if is_class:
                for b in node.bases:
                    self.facts.refs.append((".".join(o for o, _ in inner), ast.unparse(b), "inherits", b.lineno))
            for name, value in ast.iter_fields(node):
                if name != "decorator_list":
                    for x in value if isinstance(value, list) else [value]:
                        if isinstance(x, ast.AST):
                            self.visit(x, inner, False)
            return
        if top and isinstance(node, (ast.Assign, ast.AnnAssign)):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            names = [t.id for t in targets if isinstance(t, ast.Name) and t.id.isupper() and len(t.id) > 1]
            if names:
                self.define(node, names[0], "const", owner)
                owner = [*owner, (names[0], "const")]
        elif isinstance(node, ast.Call):
            self.facts.refs.append((src, ast.unparse(node.func), "calls", node.lineno))
        elif isinstance(node, ast.Import):
            for a in node.names:
                self.facts.imports.append((self.source(node), a.name, None, a.asname or a.name.rsplit(".", 1)[-1], node.lineno))
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            for a in node.names:
                self.facts.imports.append((self.source(node), module, a.name, a.asname or a.name, node.lineno))
        for x in ast.iter_child_nodes(node):
            self.visit(x, owner, isinstance(node, ast.Module))


def extract(path: str, text: str) -> Facts:
    """Facts of a Python file; raises SyntaxError if it doesn't parse."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text.removeprefix("﻿"))
    w = _Walk(text)
    w.visit(tree, [], True)
    w.facts.symbols = specific(w.facts.symbols)
    w.facts.refs = keep_refs(w.facts.refs)
    return w.facts


def tolerant(path: str, text: str) -> Facts:
    """Facts of any Python file: what the parser rejects is taken apart by a lexer, so that damage costs the lines it lies in."""
    try:
        return extract(path, text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        from plumbline.extract import pylex

        return pylex.extract(path, text)


register("python", tolerant)
