"""Functions of Python texts that the interpreter's parser rejects, by a string- and comment-aware lexer and indentation.

A logical line begins where neither a string nor a bracket is open; a definition goes on until a logical line that isn't
indented deeper.  Damage is kept local: a plain string ends with its line, a bracket that is still open is given up at a line
that can only begin a statement, and if the text ends inside a triple-quoted string, such strings are given up
where a definition begins that isn't indented deeper than they are.
"""

from __future__ import annotations

import ast
import inspect
import re
from bisect import bisect_right

from plumbline.extract import Definition, Facts, clean_doc, keep_refs, signature_of
from plumbline.extract.pyfacts import comment_above

_TOKEN = re.compile(r"""(?P<comment>\#[^\n]*)|(?P<string>(?<!\w)[rRbBuUfFtT]{0,2}(?P<quote>\"{3}|'{3}|"|'))|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<cont>\\\n)|(?P<nl>\n)|(?P<stray>["'])""")
_ENDS = {q: re.compile(r"\\[\s\S]|" + q + ("" if len(q) == 3 else r"|\n")) for q in ('"""', "'''", '"', "'")}
#: Beginnings of lines that no expression goes on with.
_STATEMENT = re.compile(r"[ \t]*(?:(?:async[ \t]+)?def[ \t]+\w|class[ \t]+\w+[ \t]*[(:\[]|from[ \t]+[\w.]+[ \t]+import\b|(?:import|return|raise|while|with|assert|del|global|nonlocal)[ \t]+\w|(?:try|finally)[ \t]*:|@\w[\w.]*(?:\(|[ \t]*\n)|(?:pass|break|continue)[ \t]*(?:\n|\Z))")
_HEAD = re.compile(r"(?:async\s+)?(def|class)\s+([^\W\d]\w*)\s*(?=[(:\[])")
_DEF = re.compile(r"^([ \t]*)(?:(?:async[ \t]+)?def[ \t]+\w+[ \t]*[(\[]|class[ \t]+\w+[ \t]*[(:\[])", re.M)
_BLOCK = re.compile(r"(?:if|elif|else|for|while|with|try|except|finally|match|case|async|def|class|@)(?!\w)|@")
_CONFLICT = re.compile(r"(?:<{7}|={7}|>{7}|\|{7})(?: |\n|\Z)")
_PREFIX = re.compile(r"[rRuU]?(?=[\"'])")


def _width(blank: str) -> int:
    return len(blank.expandtabs(8))


class _Lines:
    """``masked`` is the text with strings as quotes and comments as blanks; ``starts`` are the places where logical lines begin."""

    def __init__(self, text: str, strict: bool):
        self.text, self.strict = text, strict
        self.strings: dict[int, int] = {}  # first character, prefix included -> place after it
        self.whole = True
        self.starts = [0]
        out: list[str] = []
        pos = depth = 0
        while m := _TOKEN.search(text, pos):
            out.append(text[pos : m.start()])
            at, pos, kind = m.start(), m.end(), m.lastgroup
            if m.group("string") is not None:
                pos = self._string_end(at, pos, m.group("quote"))
                self.strings[at] = pos
                out.append(re.sub(r"[^\n]", '"', text[at:pos]))
                continue
            if kind == "comment":
                out.append(" " * (pos - at))
                continue
            out.append(m.group() if kind != "cont" else " \n")
            if kind == "open":
                depth += 1
            elif kind == "close":
                depth = max(0, depth - 1)
            elif kind == "nl":
                if depth and _STATEMENT.match(text, pos):
                    depth = 0
                if not depth:
                    self.starts.append(pos)
        out.append(text[pos:])
        self.masked = "".join(out)

    def _string_end(self, at: int, pos: int, quote: str) -> int:
        limit = len(self.text)
        if self.strict and len(quote) == 3:
            line = self.text.rfind("\n", 0, at) + 1
            width = _width(re.match(r"[ \t]*", self.text[line:at]).group())
            for d in _DEF.finditer(self.text, pos):
                if d.start() and _width(d.group(1)) <= width:
                    limit = d.start() - 1  # the line feed before it stays
                    break
        for e in _ENDS[quote].finditer(self.text, pos, limit):
            if e.group()[0] != "\\":
                return e.end() if e.group() != "\n" else e.start()
        self.whole = self.whole and len(quote) < 3
        return limit


def _header_end(masked: str, pos: int, stop: int) -> int:
    """The place of the colon that ends a header, or -1."""
    depth = 0
    for k in range(pos, stop):
        c = masked[k]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return -1
        elif c == ":" and not depth:
            return k
        elif c == "\n" and not depth and masked[k - 1 : k] != " ":
            return -1
    return -1


def _docstring(lines: _Lines, colon: int, width: int) -> str | None:
    text, masked = lines.text, lines.masked
    at = colon + 1
    while at < len(masked) and masked[at] in " \t\n\f":
        at += 1
    end = lines.strings.get(at)
    if end is None or not _PREFIX.match(text, at):
        return None
    line = text.rfind("\n", 0, at) + 1
    if line > colon and _width(text[line:at]) <= width or masked[end : (masked.find("\n", end) + 1 or len(masked))].strip(" \t\n;\f"):
        return None
    try:
        value = ast.literal_eval(text[at:end])
    except (SyntaxError, ValueError):
        return None
    return inspect.cleandoc(value) if isinstance(value, str) else None


def extract(path: str, text: str) -> Facts:
    """Functions, methods, classes, imports, calls and bases of any Python text."""
    text = text.removeprefix("\ufeff").replace("\r\n", "\n")
    lines = _Lines(text, False)
    if not lines.whole:
        lines = _Lines(text, True)
    masked, rows = lines.masked, text.split("\n")
    feeds = [m.start() for m in re.finditer("\n", text)]
    number = lambda at: bisect_right(feeds, at - 1) + 1
    logical = []  # (place of the first character, width, place after the last character)
    for a, b in zip(lines.starts, [*lines.starts[1:], len(text)]):
        body = masked[a:b]
        if body.strip() and not _CONFLICT.match(body):
            first = a + len(body) - len(body.lstrip(" \t\f"))
            logical.append((first, _width(text[a:first].replace("\f", "")), a + len(body.rstrip())))
    facts = Facts()
    stack: list[tuple] = []  # (width, name, kind, definition or None)
    decorated, end = 0, 1
    for k, (at, width, after) in enumerate(logical):
        # a line that opens no block, but is followed by deeper ones, is damage and ends nothing
        damage = k + 1 < len(logical) and logical[k + 1][1] > width and masked[after - 1] != ":" and not _BLOCK.match(masked, at)
        if not damage:
            while stack and stack[-1][0] >= width:
                last = stack.pop()[3]
                if last is not None:
                    last.end_line = end
        line = number(at)
        head = _HEAD.match(masked, at)
        if head:
            name, is_class = head.group(2), head.group(1) == "class"
            kind = "class" if is_class else "method" if stack and stack[-1][2] == "class" else "function"
            colon = _header_end(masked, head.end(), after)
            made = None
            if colon >= 0:
                chain = [x[1] for x in stack]
                doc = _docstring(lines, colon, width)
                doc, nearest = (clean_doc(doc), None) if doc else comment_above(rows, decorated or line)
                made = Definition(
                    name, ".".join([*chain, name]), kind, line, line, signature_of(text[at:colon]),
                    doc, ".".join(chain) or None, not name.startswith("_"), nearest,
                )
                facts.symbols.append(made)
            stack.append((width, name, kind, made))
        decorated = (decorated or line) if masked[at] == "@" else 0
        end = number(after - 1)
    for *_, made in stack:
        if made is not None:
            made.end_line = end
    _uses(lines, number, facts)
    return facts


#: Words before a parenthesis that aren't called.
_NOT_CALLED = frozenset("if elif while for in not and or is return yield await assert del lambda with as except raise from import else print exec def class match case".split())
_CALL = re.compile(r"(?<![\w.@])((?:[^\W\d]\w*\.)*[^\W\d]\w*)[ \t]*\(")
_BASES = re.compile(r"^[ \t]*class[ \t]+(\w+)[ \t]*\(([^()\n]*)\)", re.M)
_IMPORT = re.compile(r"^[ \t]*import[ \t]+([\w., \t]+?)[ \t]*;?$", re.M)
_FROM = re.compile(r"^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]+(?:\(([^()]*)\)|([\w, \t*]+))", re.M)


def _uses(lines: _Lines, number, facts: Facts) -> None:
    masked = lines.masked

    def owner(line: int) -> str | None:
        inside = [d for d in facts.symbols if d.start_line <= line <= d.end_line]
        return max(inside, key=lambda d: d.start_line).local if inside else None

    for m in _CALL.finditer(masked):
        before = masked[: m.start()].rsplit("\n", 1)[-1].split()
        if m.group(1).split(".")[0] not in _NOT_CALLED and (not before or before[-1] not in ("def", "class")):
            line = number(m.start())
            facts.refs.append((owner(line), m.group(1), "calls", line))
    for m in _BASES.finditer(masked):
        line = number(m.start(1))
        for base in m.group(2).split(","):
            base = base.strip()
            if base and "=" not in base and "*" not in base:
                facts.refs.append((owner(line), base, "inherits", line))
    named = lambda part: [(x.split(" as ")[0].strip(), x.split(" as ")[-1].strip()) for x in re.sub(r"\s+", " ", part).split(",") if x.strip()]
    for m in _IMPORT.finditer(masked):
        for name, alias in named(m.group(1)):
            facts.imports.append((lines.text[m.start() : m.end()].strip(), name, None, alias if alias != name else name.rsplit(".", 1)[-1], number(m.start())))
    for m in _FROM.finditer(masked):
        for name, alias in named(m.group(2) or m.group(3)):
            facts.imports.append((lines.text[m.start() : m.end()].strip(), m.group(1), name, alias, number(m.start())))
    facts.refs = keep_refs(facts.refs)
