"""Facts of JavaScript, TypeScript and Go by a string- and comment-aware lexer and brace matching.

The lexer takes any text, broken ones too; definitions are recognised by their first tokens and delimited by matching their
braces, and documentation is the comment block that ends directly above.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from plumbline.extract import Definition, Facts, docs_of, keep_refs, register, signature_of, specific

_TOKEN = re.compile(
    r"""(?P<ws>\s+)|(?P<lc>//[^\n]*)|(?P<bc>/\*[\s\S]*?(?:\*/|\Z))|(?P<id>[A-Za-z_$\u0080-￿][\w$]*)|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<tick>`)|(?P<num>\.?\d[\w.]*)|(?P<op>=>|\?\.(?!\d)|\.\.\.|:=|<-|\+\+|--|[\s\S])""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_OPEN = {"(": ")", "[": "]", "{": "}"}
_CLOSE = {v: k for k, v in _OPEN.items()}
#: Words that no call or method name can be.
_SCRIPT_WORDS = frozenset("if for while switch catch return function typeof await new import super do else in of delete void throw case yield instanceof class export default const let var".split())
_GO_WORDS = frozenset("if for switch select return func go defer range case type struct interface map chan var const import package else default".split())
_MODIFIERS = frozenset("public private protected static async abstract readonly override get set declare accessor".split())


@dataclass(slots=True)
class _Tok:
    kind: str
    text: str
    pos: int
    end: int
    mate: int = -1


def _template_end(text: str, pos: int) -> int:
    """The place after a template literal that begins at ``pos``."""
    depth, i, n = 0, pos + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if depth == 0 and c == "`":
            return i + 1
        if depth == 0 and text.startswith("${", i):
            depth, i = 1, i + 2
            continue
        if depth:
            if c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
            elif c == "`":
                i = _template_end(text, i)
                continue
        i += 1
    return n


class _Source:
    def __init__(self, text: str, go: bool):
        self.text = text
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]
        self.toks: list[_Tok] = []
        self.comment_lines: dict[int, tuple[int, str]] = {}  # last line -> (first line, text)
        stack: list[int] = []
        pos, n = 0, len(text)
        while pos < n:
            m = _TOKEN.match(text, pos)
            kind, end = m.lastgroup, m.end()
            if kind == "tick":
                end = text.find("`", pos + 1) + 1 or n if go else _template_end(text, pos)
                kind = "str"
            elif kind == "op" and m.group() == "/" and not go and (not self.toks or self.toks[-1].kind == "op" and self.toks[-1].text not in ")]}" or self.toks[-1].text in ("return", "case", "typeof")):
                r = _REGEX.match(text, pos)
                if r:
                    kind, end = "str", r.end()
            if kind in ("lc", "bc"):
                first, last = self.line(pos), self.line(max(pos, end - 1))
                if not text[self.starts[first - 1] : pos].strip():
                    self.comment_lines[last] = (first, text[pos:end])
            elif kind != "ws":
                t = _Tok(kind, text[pos:end], pos, end)
                if t.text in _OPEN and kind == "op":
                    stack.append(len(self.toks))
                elif t.text in _CLOSE and kind == "op":
                    # tolerate stray closers: look for the nearest opener that fits
                    for k in range(len(stack) - 1, -1, -1):
                        if self.toks[stack[k]].text == _CLOSE[t.text]:
                            t.mate = stack[k]
                            self.toks[stack[k]].mate = len(self.toks)
                            del stack[k:]
                            break
                self.toks.append(t)
            pos = end

    def line(self, pos: int) -> int:
        return bisect_right(self.starts, pos)

    def at(self, i: int) -> str:
        return self.toks[i].text if 0 <= i < len(self.toks) else ""

    def after_group(self, i: int) -> int:
        """The token after the group that opens at ``i``."""
        return (self.toks[i].mate if self.toks[i].mate > i else len(self.toks) - 1) + 1

    def doc_above(self, line: int) -> tuple[str | None, str | None]:
        got: list[str] = []
        k = line - 1
        while k in self.comment_lines:
            first, text = self.comment_lines[k]
            got.append(text)
            k = first - 1
        return docs_of(got[::-1])

    def end_of(self, i: int) -> int:
        return self.toks[min(i, len(self.toks) - 1)].end

    def chain_start(self, i: int) -> int:
        """First token of the postfix chain that ends in the name at ``i``."""
        while i >= 2 and self.at(i - 1) in (".", "?."):
            j = i - 2
            if self.at(j) == "!":
                j -= 1
            while self.at(j) in (")", "]") and self.toks[j].mate >= 0:
                j = self.toks[j].mate - 1
                if j < 0 or self.toks[j].kind not in ("id",) and self.at(j) not in (")", "]"):
                    return j + 1
            if self.toks[j].kind not in ("id", "str"):
                return i
            i = j
        return i


class _Scan:
    """Definitions first, then uses with the innermost definition around them."""

    def __init__(self, text: str, go: bool):
        self.s = _Source(text, go)
        self.facts = Facts()
        self.spans: list[tuple[int, int, str, str]] = []  # (first token, last token, name, kind)
        self.pending: list[tuple] = []
        self.names: set[int] = set()  # tokens that are names being defined

    def define(self, name_at: int, kind: str, first: int, body: int, last: int, exported: bool) -> None:
        """A definition from token ``first`` to ``last``; ``body`` is the first token that isn't signature."""
        self.pending.append((first, last, self.s.at(name_at), kind, body, exported))
        self.names.add(name_at)

    def settle(self) -> None:
        s = self.s
        stack: list[tuple] = []
        for first, last, name, kind, body, exported in sorted(self.pending, key=lambda p: (p[0], -p[1])):
            while stack and stack[-1][1] < first:
                stack.pop()
            if kind == "function" and stack and stack[-1][3] in ("class", "interface", "struct", "enum"):
                kind = "method"
            chain = [x[2] for x in stack]
            start, end = s.line(s.toks[first].pos), s.line(max(s.toks[first].pos, s.end_of(last) - 1))
            stop = s.toks[body].pos if first < body <= last else s.end_of(last)
            doc, nearest = s.doc_above(start)
            self.facts.symbols.append(
                Definition(name, ".".join([*chain, name]), kind, start, end, signature_of(s.text[s.toks[first].pos : stop]), doc, ".".join(chain) or None, exported, nearest)
            )
            stack.append((first, last, name, kind))
            self.spans.append((first, last, ".".join([*chain, name]), kind))
        self.facts.symbols = specific(self.facts.symbols)

    def owner(self, i: int) -> str | None:
        """Innermost definition around token ``i``; spans are sorted by their first token."""
        lo = bisect_right(self.spans, i, key=lambda x: x[0]) - 1
        while lo >= 0:
            if self.spans[lo][1] >= i:
                return self.spans[lo][2]
            lo -= 1
        return None

    def inside(self, i: int, kind: str) -> bool:
        """Whether the innermost definition around token ``i`` is of a kind."""
        lo = bisect_right(self.spans, i, key=lambda x: x[0]) - 1
        while lo >= 0 and self.spans[lo][1] < i:
            lo -= 1
        return lo >= 0 and self.spans[lo][3] == kind

    def use(self, i: int, first: int, last: int, kind: str) -> None:
        s = self.s
        self.facts.refs.append((self.owner(i), s.text[s.toks[first].pos : s.toks[last].end], kind, s.line(s.toks[first].pos)))


def _statement_end(s: _Source, i: int) -> int:
    """Last token of a declaration without braces: before a semicolon or a line that goes on with something new."""
    n = len(s.toks)
    while i < n:
        t = s.at(i)
        if t == ";":
            return i - 1
        if t in _OPEN:
            i = s.after_group(i)
            continue
        if t in _CLOSE:
            return i - 1
        if i + 1 < n and "\n" in s.text[s.toks[i].end : s.toks[i + 1].pos] and s.at(i + 1) not in ("|", "&", ".", "?", ":", "=", "+", "?.", "=>") and t not in ("|", "&", "=", "=>", ",", "+", "?", ":"):
            return i
        i += 1
    return n - 1


def _body(s: _Source, i: int) -> int:
    """From after a parameter list: the ``{`` of the body, or -1.  A result type is passed over."""
    n = len(s.toks)
    if s.at(i) == ":":
        i += 1
        while i < n and s.at(i) not in (";", "{", "}", ")", "=>", "="):
            i = s.after_group(i) if s.at(i) in "([" and s.at(i) else i + 1
        if s.at(i) == "{" and s.at(i - 1) in (":", "|", "&", "<", ",", "is"):
            i = s.after_group(i)
    return i if i < n and s.at(i) == "{" else -1


def extract_script(path: str, text: str) -> Facts:
    """Facts of a JavaScript or TypeScript file, with or without JSX."""
    scan = _Scan(text, False)
    s = scan.s
    n = len(s.toks)
    class_bodies: dict[int, str] = {}
    inherits: list[tuple[int, int, int]] = []

    def exported(first: int, name: str) -> bool:
        return s.at(first - 1) in ("export", "default") or not name.startswith("_")

    def heads(i: int) -> int:
        while s.at(i - 1) in ("async", "abstract", "declare"):
            i -= 1
        return i

    i = 0
    while i < n:
        t = s.toks[i]
        word = t.text if t.kind == "id" and s.at(i - 1) not in (".", "?.") else ""
        if word == "function":
            k = i + 1 + (s.at(i + 1) == "*")
            if k < n and s.toks[k].kind == "id":
                p = k + 1
                while p < n and s.at(p) != "(" and s.at(p) not in ("{", ";"):
                    p += 1
                if s.at(p) == "(":
                    b = _body(s, s.after_group(p))
                    first = heads(i)
                    if b >= 0:
                        scan.define(k, "function", first, b, s.after_group(b) - 1, exported(first, s.at(k)))
                    else:
                        e = _statement_end(s, s.after_group(p))
                        scan.define(k, "function", first, e + 1, e, exported(first, s.at(k)))
        elif word in ("class", "interface") and i + 1 < n and s.toks[i + 1].kind == "id" and s.at(i + 1) not in ("extends", "implements"):
            b = i + 2
            while b < n and s.at(b) not in ("{", ";"):
                if s.at(b) in ("extends", "implements"):
                    k = b + 1
                    while k < n and s.at(k) not in ("{", "implements", ";"):
                        if s.toks[k].kind == "id":
                            e = k
                            while s.at(e + 1) == "." and e + 2 < n:
                                e += 2
                            inherits.append((i, k, e))
                            k = e
                            if s.at(k + 1) == "<":
                                depth = 0
                                while k + 1 < n:
                                    k += 1
                                    depth += (s.at(k) == "<") - (s.at(k) == ">")
                                    if depth == 0:
                                        break
                        k += 1
                b += 1
            if s.at(b) == "{":
                first = heads(i)
                scan.define(i + 1, word, first, b, s.after_group(b) - 1, exported(first, s.at(i + 1)))
                class_bodies[b] = word
        elif word == "enum" and i + 2 < n and s.at(i + 2) == "{":
            first = i - 1 if s.at(i - 1) == "const" else heads(i)
            scan.define(i + 1, "enum", first, i + 2, s.after_group(i + 2) - 1, exported(first, s.at(i + 1)))
        elif word == "type" and i + 2 < n and s.toks[i + 1].kind == "id" and s.at(i + 2) in ("=", "<"):
            e = _statement_end(s, i + 2)
            first = heads(i)
            scan.define(i + 1, "type", first, e + 1, e, exported(first, s.at(i + 1)))
        elif word in ("const", "let", "var") and i + 2 < n and s.toks[i + 1].kind == "id":
            k = i + 2
            if s.at(k) == ":":
                while k < n and s.at(k) not in ("=", ";"):
                    k = s.after_group(k) if s.at(k) in _OPEN else k + 1
            if s.at(k) == "=":
                v = k + 1 + (s.at(k + 1) == "async")
                body = -1
                if s.at(v) == "function":
                    p = v + 1
                    while p < n and s.at(p) not in ("(", "{", ";"):
                        p += 1
                    body = _body(s, s.after_group(p)) if s.at(p) == "(" else -1
                else:
                    if s.at(v) == "(":
                        a = s.after_group(v)
                        if s.at(a) == ":":
                            while a < n and s.at(a) not in ("=>", ";"):
                                a = s.after_group(a) if s.at(a) in _OPEN else a + 1
                    else:
                        a = v + 1
                    if s.at(a) == "=>":
                        body = a + 1
                if body >= 0:
                    e = s.after_group(body) - 1 if s.at(body) == "{" else _statement_end(s, body)
                    stop = body if s.at(body) == "{" else max(body - 1, i)
                    scan.define(i + 1, "function", i + 1, stop, e, s.at(i - 1) == "export" or not s.at(i + 1).startswith("_"))
        elif word == "import" and s.at(i + 1) not in ("(", "."):
            i = _script_import(scan, i, n)
            continue
        elif word == "export" and s.at(i + 1) in ("{", "*"):
            e = s.after_group(i + 1) if s.at(i + 1) == "{" else i + 2
            if s.at(e) == "as":
                e += 2
            if s.at(e) == "from" and e + 1 < n and s.toks[e + 1].kind == "str":
                raw, module = text[t.pos : s.toks[e + 1].end], s.at(e + 1)[1:-1]
                names = _names(s, i + 1) if s.at(i + 1) == "{" else [(None, None)]
                scan.facts.imports += [(raw, module, a, b, s.line(t.pos)) for a, b in names]
                i = e + 2
                continue
        i += 1
    # methods: names with parameters directly in a class or interface body
    for b, what in class_bodies.items():
        k, end = b + 1, s.after_group(b) - 1
        start = k
        while k < end:
            c = s.at(k)
            if c == "(" and k > start and (s.toks[k - 1].kind == "id" and s.at(k - 1) not in _SCRIPT_WORDS or s.at(k - 1) == ">"):
                name = k - 1
                if s.at(name) == ">":
                    while name > start and s.at(name) != "<":
                        name -= 1
                    name -= 1
                after = s.after_group(k)
                body = _body(s, after)
                first = start
                while first < name and s.at(first) == "@":
                    first = s.after_group(first + 2) if s.at(first + 2) == "(" else first + 2
                if s.toks[name].kind == "id" and s.at(first) not in ("[",) and "=" not in [s.at(x) for x in range(first, name)]:
                    last = s.after_group(body) - 1 if body >= 0 else min(_statement_end(s, after), end - 1)
                    if body >= 0 or what == "interface" or s.at(first) == "abstract":
                        scan.define(name, "method", first, body if body >= 0 else last + 1, last, True if s.at(b) else not s.at(name).startswith("_"))
                        k = last + 1
                        k += s.at(k) == ";"
                        start = k
                        continue
                k = after
                continue
            if c == ";" or c == "," and what == "interface":
                start = k + 1
            elif c in _OPEN:
                k = s.after_group(k)
                if c == "{" and s.at(k) not in (",", ";", ")", "."):
                    start = k
                continue
            elif k + 1 < end and "\n" in s.text[s.toks[k].end : s.toks[k + 1].pos] and s.at(k + 1) not in ("=", ".", "?", ":") and c not in ("=", "@", ":", "|", "&", "=>", ",") and c not in _MODIFIERS:
                start = k + 1
            k += 1
    scan.settle()
    for cls, first, last in inherits:
        scan.use(cls + 1, first, last, "inherits")
    for k in range(n - 1):
        t = s.toks[k]
        if t.kind != "id" or k in scan.names or t.text in _SCRIPT_WORDS and s.at(k - 1) not in (".", "?."):
            continue
        nxt = k + 1
        if s.at(nxt) == "?.":
            nxt += 1
        if s.at(nxt) == "<" and s.at(k - 1) != "function":
            g = _generic_end(s, nxt)
            nxt = g if g else nxt
        first = s.chain_start(k)
        if s.at(nxt) == "(" or s.at(first - 1) == "new" and s.at(k + 1) != ".":
            if s.at(first - 1) == "new":
                scan.use(first, first, k, "instantiates")
            elif s.at(nxt) == "(" and not (t.text == "async" and s.at(s.after_group(nxt)) in ("=>", ":")):
                scan.use(first, first, k, "calls")
    scan.facts.refs = keep_refs(sorted(scan.facts.refs, key=lambda r: r[3]))
    return scan.facts


def _generic_end(s: _Source, i: int) -> int:
    """The ``(`` after type arguments that open at ``i``, or 0."""
    depth, k = 0, i
    while k < len(s.toks) and k < i + 60:
        t = s.at(k)
        depth += (t == "<") - (t == ">")
        if t in (";", "{", "&", "||", "=", "=>") and t != "=>":
            return 0
        if depth == 0:
            return k + 1 if s.at(k + 1) == "(" else 0
        k += 1
    return 0


def _names(s: _Source, i: int) -> list[tuple[str, str | None]]:
    """(symbol, alias) of the names in the braces at ``i``."""
    out, k, end = [], i + 1, s.after_group(i) - 1
    while k < end:
        if s.toks[k].kind in ("id", "str") and not (s.at(k) == "type" and s.at(k + 1) not in (",", "}", "as")):
            name, alias = s.at(k), None
            if s.at(k + 1) == "as":
                alias = s.at(k + 2)
                k += 2
            out.append((name, alias))
        k += 1
    return out


def _script_import(scan: _Scan, i: int, n: int) -> int:
    s = scan.s
    k = i + 1
    while k < n and s.toks[k].kind != "str" and s.at(k) != ";":
        k = s.after_group(k) if s.at(k) == "{" else k + 1
    if k >= n or s.toks[k].kind != "str":
        return i + 1
    raw, module, line = s.text[s.toks[i].pos : s.toks[k].end], s.at(k)[1:-1], s.line(s.toks[i].pos)
    if s.at(k + 1) == ";":
        raw += ";"
    rows: list[tuple] = []
    j = i + 1
    while j < k:
        if s.at(j) == "{":
            rows += [(raw, module, a, b, line) for a, b in _names(s, j)]
            j = s.after_group(j)
        elif s.at(j) == "*" and s.at(j + 1) == "as":
            rows.append((raw, module, None, s.at(j + 2), line))
            j += 3
        else:
            j += 1
    scan.facts.imports += rows or [(raw, module, None, None, line)]
    return k + 1


def extract_go(path: str, text: str) -> Facts:
    """Facts of a Go file."""
    scan = _Scan(text, True)
    s = scan.s
    n = len(s.toks)
    upper = lambda name: name[:1].isupper()
    structs: list[tuple[int, int]] = []

    def ends_line(k: int) -> bool:
        return k + 1 >= n or "\n" in s.text[s.toks[k].end : s.toks[k + 1].pos]

    def spec_end(k: int) -> int:
        while k < n:
            t = s.at(k)
            if t == ";" or t in _CLOSE:
                return k - 1
            if t in _OPEN:
                k = s.after_group(k) - 1
            if ends_line(k):
                return k
            k += 1
        return n - 1

    def type_spec(k: int) -> int:
        """A type from its name on; returns its last token."""
        v = k + 1
        if s.at(v) == "[" and s.at(v + 1) != "]":
            v = s.after_group(v)
        v += s.at(v) == "="
        kind = s.at(v) if s.at(v) in ("struct", "interface") and s.at(v + 1) == "{" else "type"
        last = s.after_group(v + 1) - 1 if kind != "type" else spec_end(v)
        scan.define(k, kind, k, v + 1 if kind != "type" else last + 1, last, upper(s.at(k)))
        if kind == "struct":
            structs.append((k, v + 1))
        return last

    i, depth = 0, 0
    while i < n:
        t = s.toks[i]
        if t.text == "{":
            depth += 1
        elif t.text == "}":
            depth = max(0, depth - 1)
        if t.kind == "id" and s.at(i - 1) != ".":
            if t.text == "func" and depth == 0:
                k = i + 1
                method = s.at(k) == "("
                if method:
                    k = s.after_group(k)
                if k < n and s.toks[k].kind == "id":
                    p = k + 1
                    if s.at(p) == "[":
                        p = s.after_group(p)
                    b = s.after_group(p) if s.at(p) == "(" else p
                    while b < n and s.at(b) != "{" and not ends_line(b - 1):
                        if s.at(b) in ("struct", "interface") and s.at(b + 1) == "{":
                            b += 1
                        b = s.after_group(b) if s.at(b) in _OPEN else b + 1
                    last = s.after_group(b) - 1 if s.at(b) == "{" else b - 1
                    scan.define(k, "method" if method else "function", i, b, last, upper(s.at(k)))
            elif t.text in ("type", "const") and s.at(i + 1):
                one = type_spec if t.text == "type" else lambda k: (e := spec_end(k), scan.define(k, "const", k, e + 1, e, upper(s.at(k))))[0]
                if s.at(i + 1) == "(":
                    k, end = i + 2, s.after_group(i + 1) - 1
                    while k < end:
                        k = one(k) + 1 if s.toks[k].kind == "id" else k + 1
                elif s.toks[i + 1].kind == "id":
                    one(i + 1)
            elif t.text == "import" and depth == 0:
                k, end = (i + 2, s.after_group(i + 1) - 1) if s.at(i + 1) == "(" else (i + 1, i + 3)
                while k < min(end, n):
                    if s.toks[k].kind == "str":
                        alias = s.at(k - 1) if s.toks[k - 1].kind == "id" and s.at(k - 1) != "import" or s.at(k - 1) == "." else None
                        module = s.at(k)[1:-1]
                        raw = s.text[s.toks[i].pos : s.toks[k].end] if s.at(i + 1) != "(" else s.text[s.toks[k - 1 if alias else k].pos : s.toks[k].end]
                        scan.facts.imports.append((raw, module, None, alias or module.rsplit("/", 1)[-1], s.line(s.toks[k].pos)))
                        if s.at(i + 1) != "(":
                            break
                    k += 1
        i += 1
    scan.settle()
    for name, b in structs:
        k, end = b + 1, s.after_group(b) - 1
        while k < end:
            first = k
            last = spec_end(k)
            f = first + (s.at(first) == "*")
            stop = f
            while s.at(stop + 1) == "." and stop + 2 <= last:
                stop += 2
            rest = [s.toks[x].kind for x in range(stop + 1, last + 1)]
            if s.toks[f].kind == "id" and stop <= last and all(x == "str" for x in rest):
                scan.use(name, f, stop, "inherits")
            k = max(last, first) + 1
    header = False
    for k in range(n - 1):
        t = s.toks[k]
        if t.kind == "id" and t.text in ("if", "for", "switch", "select") and s.at(k - 1) != ".":
            header = True
        elif t.text == "{" and header and t.kind == "op" and s.at(k - 1) not in ("struct", "interface"):
            header = False
        if t.kind != "id" or k in scan.names or t.text in _GO_WORDS:
            continue
        first = s.chain_start(k)
        nxt = k + 1
        if s.at(nxt) == "(":
            if s.at(first - 1) != "func" and not scan.inside(k, "interface"):
                scan.use(first, first, k, "calls")
        elif s.at(nxt) == "{" and not header and s.at(first - 1) not in (")", "struct", "interface", "chan", "map") and (s.at(first - 1) in ("=", ":=", "return", "(", ",", "&", ":", "{", "]", "<-") ) and scan.owner(k) is not None:
            scan.use(first, first, k, "instantiates")
    scan.facts.refs = keep_refs(sorted(scan.facts.refs, key=lambda r: r[3]))
    return scan.facts


for _lang in ("javascript", "typescript", "tsx"):
    register(_lang, extract_script)
register("go", extract_go)
