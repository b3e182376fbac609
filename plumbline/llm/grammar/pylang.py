"""Python 3.13: lexer with indentation and f-strings, and productions of statements, patterns and expressions.

An indented suite is a bracket group like any other: I opens it and D closes it.
"""

from __future__ import annotations

import keyword
import re

from plumbline.llm.grammar import ERROR, Bad, Cursor, Symbols

#: The soft keywords.
SOFT = "match case type _"
S = Symbols(
    " ".join([*keyword.kwlist, *SOFT.split()]),
    "** // >> << ... -> := <= >= == != += -= *= /= %= @= &= |= ^= **= //= >>= <<= + - * / % @ & | ^ ~ < > = . , : ; !",
    0x100,
)
O = S.of
OPENS = {"P": ")", "K": "]", "B": "}", "f": "}", "I": "D"}
_OPEN = {"(": "P", "[": "K", "{": "B"}
_TOKEN = re.compile(
    r"""(?P<ws>[ \t\f]+|\\(?:\r\n|\n|\r)(?=[\s\S]))|(?P<nl>\r\n|\n|\r)|(?P<lc>\#[^\r\n]*)
    |(?P<fstr>(?:[fF][rR]?|[rR][fF])(?:\"\"\"|'''|\"|'))
    |(?P<str>(?P<pre>[rRuUbB]|[rR][bB]|[bB][rR])?(?:\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|\"(?!\"\")(?:[^\\\"\r\n]|\\(?:\r\n|[\s\S]))*\"|'(?!'')(?:[^\\'\r\n]|\\(?:\r\n|[\s\S]))*'|\"\"(?!\")|''(?!')))
    |(?P<id>(?:[^\W\d]|[^\x00-\x7f])(?:\w|[^\x00-\x7f])*)
    |(?P<num>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))
    |(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[-+*/%@&|^~<>=.,:;!])""",
    re.X,
)
_ESCAPE = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4})|N(?!\{[^{}]+\}))")
#: Keywords that may follow a number without a blank.
_GLUED = re.compile(r"(?:and|else|for|if|in|is|not|or)\b")
_CLOSER = {"P": ")", "K": "]", "B": "}", "f": "}"}


def _bad_escape(s: str) -> bool:
    return "\\" in s and bool(_ESCAPE.search(s.replace("\\\\", "")))


class _Lexer:
    """One pass; ``modes`` holds what is open: brackets, f-strings (quote, raw) and format specifications."""

    def __init__(self, text: str):
        self.t = text
        self.out: list[str] = []
        self.modes: list = []

    def fail(self) -> str:
        self.out.append(ERROR)
        return "".join(self.out)

    def run(self) -> str:
        t, out, modes, match, words, ops = self.t, self.out, self.modes, _TOKEN.match, S.words, O
        if "\0" in t:
            return self.fail()
        pos, end = 0, len(t)
        levels = [(0, 0)]
        col = alt = 0
        fresh = True
        while pos < end:
            m = match(t, pos)
            if m is None:
                return self.fail()
            what = m.lastgroup
            if what == "ws":
                if fresh and not modes:
                    for ch in m.group():
                        if ch == " ":
                            col, alt = col + 1, alt + 1
                        elif ch == "\t":
                            col, alt = (col // 8 + 1) * 8, alt + 1
                        elif ch == "\f":
                            col = alt = 0
                        else:
                            break
                pos = m.end()
                continue
            if what == "nl":
                pos = m.end()
                if not modes:
                    if not fresh:
                        out.append("\n")
                    col = alt = 0
                    fresh = True
                continue
            if what == "lc":
                pos = m.end()
                continue
            if fresh and not modes:
                fresh = False
                if col != levels[-1][0] or alt != levels[-1][1]:
                    if col > levels[-1][0]:
                        if alt <= levels[-1][1]:
                            return self.fail()
                        levels.append((col, alt))
                        out.append("I")
                    else:
                        while col < levels[-1][0]:
                            levels.pop()
                            out.append("D")
                        if (col, alt) != levels[-1]:
                            return self.fail()
            if what == "id":
                s = m.group()
                pos = m.end()
                if not s.isascii() and not s.isidentifier():
                    return self.fail()
                out.append(words.get(s, "n"))
            elif what == "op":
                s = m.group()
                if modes and modes[-1][0] == "f":
                    # at the top of a field a colon starts the format, whatever follows it
                    if s[0] == ":":
                        out.append(":")
                        modes.append(("spec",))
                        pos += 1
                        pos = self.spec(pos)
                        if pos < 0:
                            return self.fail()
                        continue
                out.append(ops[s])
                pos = m.end()
            elif what == "open":
                ch = _OPEN[m.group()]
                modes.append((ch,))
                out.append(ch)
                pos = m.end()
            elif what == "close":
                out.append(m.group())
                pos = m.end()
                if not modes or _CLOSER[modes[-1][0]] != m.group():
                    return "".join(out)  # the windows reject it
                top = modes.pop()
                if top[0] == "f":
                    pos = self.literal(pos)
                    if pos < 0:
                        return self.fail()
            elif what == "num":
                s = m.group()
                pos = m.end()
                nxt = t[pos : pos + 1]
                if (nxt.isalnum() or nxt == "_") and not _GLUED.match(t, pos):
                    return self.fail()
                if len(s) > 1 and s[0] == "0" and s.replace("_", "").isdigit() and s.strip("0_"):
                    return self.fail()
                out.append("j" if s[-1] in "jJ" and s[:2] not in ("0x", "0X") else "0")
            elif what == "fstr":
                s = m.group()
                quote = s.lstrip("fFrR")
                out.append("F")
                modes.append(("str", quote, "r" in s.lower()))
                pos = self.literal(m.end())
                if pos < 0:
                    return self.fail()
            else:
                pre = (m.group("pre") or "").lower()
                pos = m.end()
                if "b" in pre:
                    if not m.group().isascii() or "r" not in pre and re.search(r"\\x(?![0-9a-fA-F]{2})", m.group().replace("\\\\", "")):
                        return self.fail()
                    out.append("b")
                else:
                    if "r" not in pre and _bad_escape(m.group()):
                        return self.fail()
                    out.append("s")
        if not modes:
            if not fresh:
                out.append("\n")
            out.extend("D" * (len(levels) - 1))
        elif modes[-1][0] not in _CLOSER:
            return self.fail()
        return "".join(out)

    def literal(self, pos: int) -> int:
        """Reads on in the innermost f-string or format up to its end or the next field; -1 if it doesn't end."""
        modes = self.modes
        while True:
            top = modes[-1]
            if top[0] == "spec":
                return self.spec(pos)
            _, quote, raw = top
            t, begin = self.t, pos
            while True:
                if pos >= len(t):
                    return -1
                c = t[pos]
                if c == "\\":
                    if raw or t[pos + 1 : pos + 2] not in "{}":
                        if t.startswith("\\N{", pos) and not raw:
                            close = t.find("}", pos)
                            if close < 0:
                                return -1
                            pos = close + 1
                        elif raw and t[pos + 1 : pos + 2] in ("{", "}"):
                            pos += 1
                        else:
                            pos += 3 if t.startswith("\\\r\n", pos) else 2
                    else:
                        pos += 1
                elif c in "\r\n" and len(quote) == 1:
                    return -1
                elif t.startswith(quote, pos):
                    if not raw and _bad_escape(t[begin:pos]):
                        return -1
                    modes.pop()
                    return pos + len(quote)
                elif c == "{":
                    if t.startswith("{{", pos):
                        pos += 2
                        continue
                    if not raw and _bad_escape(t[begin:pos]):
                        return -1
                    self.out.append("f")
                    modes.append(("f",))
                    return pos + 1
                elif c == "}":
                    if not t.startswith("}}", pos):
                        return -1
                    pos += 2
                else:
                    pos += 1

    def spec(self, pos: int) -> int:
        """Reads a format specification up to the end of its field or a field in it."""
        t, modes = self.t, self.modes
        quote = next(x[1] for x in reversed(modes) if x[0] == "str")
        while pos < len(t):
            c = t[pos]
            if c == "{":
                self.out.append("f")
                modes.append(("f",))
                return pos + 1
            if c == "}":
                modes.pop()  # the specification; the field's end is read next
                return pos
            if t.startswith(quote, pos) or c in "\r\n" and len(quote) == 1:
                return -1
            pos += 2 if c == "\\" else 1
        return -1


def lex(text: str) -> str:
    """The token classes of a file."""
    return _Lexer(text.removeprefix("\ufeff")).run()


_CHAIN = "".join(O[w] for w in ("elif", "else", "except", "finally"))
_STATEMENT = re.compile(rf"(?:@[^\nI]*\n)*[^\nI]*(?:\nI|\n)(?:[{_CHAIN}][^\nI]*(?:\nI|\n))*")


def cut(symbols: str, kind: str) -> list[tuple[str, str]]:
    """Statements of a suite: with their decorators and with the clauses that go on with them."""
    if kind not in ("file", "suite", "cases"):
        return [(symbols, kind)]
    one = "case" if kind == "cases" else "statement"
    out, last = [], 0
    for m in _STATEMENT.finditer(symbols):
        if m.start() != last:
            break
        out.append((m.group(), one))
        last = m.end()
    if last != len(symbols):
        out.append(("\n\n", "statement"))  # a suite without its header; no statement is empty
    return out or [("", kind)]


def parse(symbols: str, kind: str):
    p = _Python(symbols)
    getattr(p, "k_" + kind)()
    if p.i != len(symbols):
        raise Bad
    return tuple(k for _, k in sorted(p.kinds.items()))


_NAMES = frozenset("n") | S.set(SOFT)
_ATOMS = frozenset("0j") | S.set("True False None ...")
_STRINGS = frozenset("sbF")
_ARITH = S.set("+ - * / // % @ & | ^ << >>")
_COMPARE = S.set("== != < > <= >=")
_AUGMENTED = S.set("+= -= *= /= %= @= &= |= ^= **= //= >>= <<=")
_SIGNS = S.set("+ - ~")
#: What an expression may be assigned as, by the code that :meth:`_Python.primary` gives.
_TARGETS = {"name", "attr", "item", "paren", "list"}
_SINGLE = {"name", "attr", "item", "paren"}


class _Python(Cursor):
    # --- suites and statements ----------------------------------------------------------------
    def k_file(self):
        pass  # without statements

    def k_suite(self):
        raise Bad

    k_cases = k_suite

    def block(self, suite: str = "suite"):
        self.need(":")
        if self.eat("\n"):
            self.group("I", suite)
        elif suite == "suite":
            self.simple_line()
        else:
            raise Bad

    def simple_line(self):
        while True:
            self.simple()
            if self.eat("\n"):
                return
            self.need(";")
            if self.eat("\n"):
                return

    def k_statement(self):
        f = _COMPOUND.get(self.c)
        if f is not None:
            f(self)
        elif self.c == O["match"] and self.s.endswith(":\nI\0"):
            self.i += 1
            self.star_expressions(named=True)
            self.block("cases")
        else:
            self.simple_line()

    def if_(self):
        self.i += 1
        self.named()
        self.block()
        while self.eat(O["elif"]):
            self.named()
            self.block()
        self.else_()

    def else_(self):
        if self.eat(O["else"]):
            self.block()

    def while_(self):
        self.i += 1
        self.named()
        self.block()
        self.else_()

    def for_(self):
        self.i += 1
        self.targets()
        self.need(O["in"])
        self.star_expressions()
        self.block()
        self.else_()

    def try_(self):
        self.i += 1
        self.block()
        kinds = set()
        while self.eat(O["except"]):
            star = self.eat("*")
            if star or self.c != ":":
                self.expression()
                if self.eat(O["as"]):
                    self.name()
            kinds.add(star)
            self.block()
        if len(kinds) > 1:
            raise Bad
        if kinds:
            self.else_()
        if self.eat(O["finally"]):
            self.block()
        elif not kinds:
            raise Bad

    def with_(self):
        self.i += 1
        if self.c == "P" and self.peek() == ":":
            self.group("P", "withparen")
        else:
            self.with_items()
        self.block()

    def with_items(self):
        while True:
            self.with_item()
            if not self.eat(","):
                return

    def with_item(self):
        self.expression()
        if self.eat(O["as"]):
            self.target()

    def k_withparen(self):
        def items():
            while True:
                self.with_item()
                if not self.eat(","):
                    break
                if self.c == "\0":
                    break
            self.end()

        if not self.attempt(items):
            self.k_paren()

    def end(self):
        if self.i != len(self.s) - 1:
            raise Bad

    def def_(self):
        self.i += 1
        self.name()
        if self.c == "K":
            self.group("K", "typeparams")
        self.group("P", "params")
        if self.eat(O["->"]):
            self.expression()
        self.block()

    def class_(self):
        self.i += 1
        self.name()
        if self.c == "K":
            self.group("K", "typeparams")
        if self.c == "P":
            self.group("P", "args")
        self.block()

    def async_(self):
        f = _ASYNC.get(self.peek())
        if f is None:
            raise Bad
        self.i += 1
        f(self)

    def decorated(self):
        while self.eat("@"):
            self.named()
            self.need("\n")
        if self.c == O["async"] and self.peek() != O["def"] or self.c not in (O["def"], O["class"], O["async"]):
            raise Bad
        _COMPOUND[self.c](self)

    def name(self):
        if self.c not in _NAMES:
            raise Bad
        self.i += 1

    # --- simple statements --------------------------------------------------------------------
    def simple(self):
        f = _SIMPLE.get(self.c)
        if f is not None:
            return f(self)
        if self.c == O["type"] and self.peek() in _NAMES and self.attempt(self.type_alias):
            return None
        return self.assignment()

    def type_alias(self):
        self.i += 1
        self.name()
        if self.c == "K":
            self.group("K", "typeparams")
        self.need("=")
        self.expression()

    def assignment(self):
        if self.c == O["yield"]:
            return self.yield_()
        parts, comma = self.star_expressions()
        c = self.c
        if c == ":":
            if comma or len(parts) != 1 or parts[0][0] not in _SINGLE:
                raise Bad
            self.single(parts[0])
            self.i += 1
            self.expression()
            if self.eat("="):
                self.value()
            return None
        if c in _AUGMENTED:
            if comma or len(parts) != 1 or parts[0][0] not in _SINGLE:
                raise Bad
            self.single(parts[0])
            self.i += 1
            return self.value()
        while self.eat("="):
            self.assign(parts)
            if self.c == O["yield"]:
                return self.yield_()
            parts, comma = self.star_expressions()
        return None

    def single(self, part):
        if part[0] == "paren":
            self.kinds[part[1]] = "single"

    def assign(self, parts):
        for code, at in parts:
            code = code.removeprefix("*")
            if code not in _TARGETS:
                raise Bad
            if code in ("paren", "list"):
                self.kinds[at] = "targets" if code == "list" else "targetparen"

    def value(self):
        if self.c == O["yield"]:
            self.yield_()
        else:
            self.star_expressions()

    def yield_(self):
        self.i += 1
        if self.eat(O["from"]):
            self.expression()
        elif self.c not in "\n;)\0=!:":
            self.star_expressions()

    def word(self):
        self.i += 1

    def return_(self):
        self.i += 1
        if self.c not in "\n;":
            self.star_expressions()

    def raise_(self):
        self.i += 1
        if self.c not in "\n;":
            self.expression()
            if self.eat(O["from"]):
                self.expression()

    def assert_(self):
        self.i += 1
        self.expression()
        if self.eat(","):
            self.expression()

    def names(self):
        self.i += 1
        self.name()
        while self.eat(","):
            self.name()

    def del_(self):
        self.i += 1
        while True:
            self.del_target()
            if not self.eat(",") or self.c in "\n;":
                return

    def del_target(self):
        code, at = self.primary()
        if code not in _TARGETS:
            raise Bad
        if code in ("paren", "list"):
            self.kinds[at] = "deleted"

    def k_deleted(self):
        while self.c != "\0":
            self.del_target()
            if not self.eat(","):
                return

    def dotted(self):
        self.name()
        while self.eat("."):
            self.name()

    def import_(self):
        self.i += 1
        while True:
            self.dotted()
            if self.eat(O["as"]):
                self.name()
            if not self.eat(","):
                return

    def from_(self):
        self.i += 1
        dots = False
        while self.c in (".", O["..."]):
            self.i += 1
            dots = True
        if not dots or self.c != O["import"]:
            self.dotted()
        self.need(O["import"])
        if self.eat("*"):
            return
        if self.c == "P":
            self.group("P", "imported")
            return
        while True:
            self.imported()
            if not self.eat(","):
                return

    def imported(self):
        self.name()
        if self.eat(O["as"]):
            self.name()

    def k_imported(self):
        while True:
            self.imported()
            if not self.eat(",") or self.c == "\0":
                return

    # --- targets ------------------------------------------------------------------------------
    def target(self):
        self.eat("*")
        code, at = self.primary()
        if code not in _TARGETS:
            raise Bad
        if code in ("paren", "list"):
            self.kinds[at] = "targets" if code == "list" else "targetparen"

    def targets(self):
        while True:
            self.target()
            if not self.eat(",") or self.c == O["in"]:
                return

    def k_targets(self):
        while self.c != "\0":
            self.target()
            if not self.eat(","):
                return

    def k_targetparen(self):
        if self.c == "*" and "," not in self.s:
            raise Bad
        self.k_targets()

    def k_single(self):
        code, at = self.primary()
        if code not in _SINGLE:
            raise Bad
        if code == "paren":
            self.kinds[at] = "single"

    # --- expressions --------------------------------------------------------------------------
    def star_expressions(self, named: bool = False):
        """([(code, place)], whether there is a comma); the codes tell what could be assigned to."""
        parts, comma = [], False
        while True:
            if self.eat("*"):
                code, at = self.bits()
                parts.append(("*" + code, at))
            else:
                parts.append(self.named() if named else self.expression())
            if not self.eat(","):
                return parts, comma
            comma = True
            if self.c not in _OPERANDS:
                return parts, comma

    def named(self):
        if self.c in _NAMES and self.peek() == O[":="]:
            self.i += 2
            self.expression()
            return "other", -1
        return self.expression()

    def expression(self):
        if self.c == O["lambda"]:
            self.i += 1
            self.parameters(":", False)
            self.need(":")
            self.expression()
            return "other", -1
        got = self.disjunction()
        if self.eat(O["if"]):
            self.disjunction()
            self.need(O["else"])
            self.expression()
            return "other", -1
        return got

    def disjunction(self):
        got = self.inversion()
        while self.c in _LOGIC:
            self.i += 1
            self.inversion()
            got = "other", -1
        return got

    def inversion(self):
        if self.eat(O["not"]):
            while self.eat(O["not"]):
                pass
            self.comparison()
            return "other", -1
        return self.comparison()

    def comparison(self):
        got = self.bits()
        while True:
            c = self.c
            if c in _COMPARE or c == O["in"]:
                self.i += 1
            elif c == O["is"]:
                self.i += 1
                self.eat(O["not"])
            elif c == O["not"] and self.peek() == O["in"]:
                self.i += 2
            else:
                return got
            self.bits()
            got = "other", -1

    def bits(self):
        got = self.factor()
        while self.c in _ARITH:
            self.i += 1
            self.factor()
            got = "other", -1
        return got

    def factor(self):
        signed = False
        while True:
            while self.c in _SIGNS:
                self.i += 1
                signed = True
            if self.eat(O["await"]):
                signed = True
            got = self.primary()
            if not self.eat(O["**"]):
                return ("other", -1) if signed else got
            signed = True

    def primary(self):
        """(code, place): name, attr, item, paren, list or other."""
        c = self.c
        at = self.i
        if c in _NAMES:
            self.i += 1
            code = "name"
        elif c in _ATOMS:
            self.i += 1
            code = "other"
        elif c in _STRINGS:
            self.strings()
            code = "other"
        elif c == "P":
            self.group("P", "paren")
            code = "paren"
        elif c == "K":
            self.group("K", "list")
            code = "list"
        elif c == "B":
            self.group("B", "dict")
            code = "other"
        else:
            raise Bad
        while True:
            if self.eat("."):
                self.name()
                code = "attr"
            elif self.c == "P":
                self.group("P", "args")
                code = "other"
            elif self.c == "K":
                self.group("K", "slices")
                code = "item"
            else:
                return code, at

    def strings(self):
        raw = self.c == "b"
        while self.c in _STRINGS:
            if (self.c == "b") != raw:
                raise Bad
            self.i += 1
            if self.s[self.i - 1] == "F":
                while self.c == "f":
                    self.group("f", "field")

    def k_field(self):
        if self.c == O["yield"]:
            self.yield_()
        else:
            self.star_expressions()
        self.eat("=")
        if self.eat("!"):
            self.need("n")
        if self.eat(":"):
            while self.c == "f":
                self.group("f", "field")

    def clauses(self) -> bool:
        """Comprehension clauses, if there are any."""
        found = False
        while self.c == O["for"] or self.c == O["async"] and self.peek() == O["for"]:
            self.eat(O["async"])
            self.i += 1
            self.targets()
            self.need(O["in"])
            self.disjunction()
            while self.eat(O["if"]):
                self.disjunction()
            found = True
        return found

    def items(self, end: str = "\0") -> tuple[int, bool, bool]:
        """Starred and named expressions: (how many, whether there is a comma, whether one is starred)."""
        n, comma, starred = 0, False, False
        while self.c != end:
            if self.eat("*"):
                self.bits()
                starred = True
            else:
                self.named()
            n += 1
            if not self.eat(","):
                break
            comma = True
        return n, comma, starred

    def k_paren(self):
        if self.c == O["yield"]:
            return self.yield_()
        n, comma, starred = self.items()
        if n == 1 and not comma:
            if starred:
                raise Bad
            self.clauses()
        return None

    def k_list(self):
        n, comma, starred = self.items()
        if n == 1 and not comma and self.clauses() and starred:
            raise Bad

    def k_dict(self):
        if self.c == "\0":
            return
        first = True
        pairs = self.c == O["**"]
        if not pairs:
            at, kinds = self.i, dict(self.kinds)
            if self.c != "*":
                self.named()
            pairs = self.c == ":"
            self.i, self.kinds = at, kinds
        if not pairs:
            return self.k_list()
        while self.c != "\0":
            if self.eat(O["**"]):
                self.bits()
                if self.c in (O["for"], O["async"]):
                    raise Bad
            else:
                self.expression()
                self.need(":")
                self.expression()
                if first and self.clauses():
                    return None
            first = False
            if not self.eat(","):
                return None
        return None

    def k_slices(self):
        while True:
            if self.eat("*"):
                self.bits()
            elif self.c == ":":
                self.slice()
            else:
                self.named()
                if self.c == ":":
                    self.slice()
            if not self.eat(",") or self.c == "\0":
                return

    def slice(self):
        self.need(":")
        if self.c not in ":,\0":
            self.expression()
        if self.eat(":") and self.c not in ",\0":
            self.expression()

    def k_args(self):
        keyword_seen = double_seen = False
        n = 0
        while self.c != "\0":
            if self.eat("*"):
                if double_seen:
                    raise Bad
                self.expression()
            elif self.eat(O["**"]):
                self.expression()
                double_seen = True
            elif self.c in _NAMES and self.peek() == "=":
                self.i += 2
                self.expression()
                keyword_seen = True
            else:
                if keyword_seen or double_seen:
                    raise Bad
                self.named()
                if self.clauses():
                    if n or self.c != "\0":
                        raise Bad
                    return
            n += 1
            if not self.eat(","):
                return

    # --- parameters ---------------------------------------------------------------------------
    def k_params(self):
        self.parameters("\0", True)

    def parameters(self, end: str, typed: bool):
        n, slash, star, default = 0, False, False, False
        while self.c != end:
            if self.eat("/"):
                if not n or slash or star:
                    raise Bad
                slash = True
            elif self.eat("*"):
                if star:
                    raise Bad
                star = True
                if self.eat(","):
                    if self.c not in _NAMES:
                        raise Bad
                    continue
                self.name()
                if typed and self.eat(":"):
                    if self.eat("*"):
                        self.bits()
                    else:
                        self.expression()
            elif self.eat(O["**"]):
                self.name()
                if typed and self.eat(":"):
                    self.expression()
                self.eat(",")
                return
            else:
                self.name()
                if typed and self.eat(":"):
                    self.expression()
                if self.eat("="):
                    self.expression()
                    default = True
                elif default and not star:
                    raise Bad
            n += 1
            if not self.eat(","):
                return

    def k_typeparams(self):
        while True:
            if self.eat("*"):
                self.name()
                if self.eat("="):
                    if self.eat("*"):
                        self.bits()
                    else:
                        self.expression()
            else:
                double = self.eat(O["**"])
                self.name()
                if not double and self.eat(":"):
                    self.expression()
                if self.eat("="):
                    self.expression()
            if not self.eat(",") or self.c == "\0":
                return

    # --- patterns -----------------------------------------------------------------------------
    def k_case(self):
        self.need(O["case"])
        self.open_pattern(":", O["if"])
        if self.eat(O["if"]):
            self.named()
        self.block()

    def open_pattern(self, *ends: str):
        starred = self.star_pattern()
        comma = False
        while self.eat(","):
            comma = True
            if self.c in ends:
                break
            self.star_pattern()
        if starred and not comma:
            raise Bad

    def star_pattern(self) -> bool:
        if self.eat("*"):
            self.name()
            return True
        self.pattern()
        return False

    def pattern(self):
        while True:
            self.closed_pattern()
            if not self.eat("|"):
                break
        if self.eat(O["as"]):
            if self.c == O["_"]:
                raise Bad
            self.name()

    def number(self):
        self.eat("-")
        if self.eat("j"):
            return
        self.need("0")
        if self.c in ("+", "-"):
            self.i += 1
            self.need("j")

    def plain_strings(self):
        c = self.c
        while self.eat(c):
            pass
        if self.c in _STRINGS:
            raise Bad

    def closed_pattern(self):
        c = self.c
        if c in ("-", "0", "j"):
            self.number()
        elif c in "sb":
            self.plain_strings()
        elif c in _CONSTANTS:
            self.i += 1
        elif c in _NAMES:
            self.dotted()
            if self.c == "P":
                self.group("P", "patternargs")
        elif c == "K":
            self.group("K", "patterns")
        elif c == "P":
            self.group("P", "patternparen")
        elif c == "B":
            self.group("B", "mapping")
        else:
            raise Bad

    def k_patterns(self):
        while self.c != "\0":
            self.star_pattern()
            if not self.eat(","):
                return

    def k_patternparen(self):
        if self.c != "\0":
            self.open_pattern("\0")

    def k_patternargs(self):
        named = False
        while self.c != "\0":
            if self.c in _NAMES and self.peek() == "=":
                self.i += 2
                named = True
            elif named:
                raise Bad
            self.pattern()
            if not self.eat(","):
                return

    def k_mapping(self):
        while self.c != "\0":
            if self.eat(O["**"]):
                if self.c == O["_"]:
                    raise Bad
                self.name()
                self.eat(",")
                return
            c = self.c
            if c in ("-", "0", "j"):
                self.number()
            elif c in "sb":
                self.plain_strings()
            elif c in _CONSTANTS:
                self.i += 1
            else:
                self.name()
                self.need(".")
                self.dotted()
            self.need(":")
            self.pattern()
            if not self.eat(","):
                return


_LOGIC = S.set("and or")
_CONSTANTS = S.set("None True False")
#: What an element of an expression list can start with.
_OPERANDS = _NAMES | _ATOMS | _STRINGS | _SIGNS | frozenset("PKB*") | S.set("not lambda await")
_ASYNC = {O["def"]: _Python.def_, O["for"]: _Python.for_, O["with"]: _Python.with_}
_COMPOUND = {
    O["if"]: _Python.if_, O["while"]: _Python.while_, O["for"]: _Python.for_, O["try"]: _Python.try_, O["with"]: _Python.with_,
    O["def"]: _Python.def_, O["class"]: _Python.class_, O["async"]: _Python.async_, "@": _Python.decorated,
}
_SIMPLE = {
    O["pass"]: _Python.word, O["break"]: _Python.word, O["continue"]: _Python.word, O["return"]: _Python.return_, O["raise"]: _Python.raise_,
    O["assert"]: _Python.assert_, O["global"]: _Python.names, O["nonlocal"]: _Python.names, O["del"]: _Python.del_, O["import"]: _Python.import_, O["from"]: _Python.from_,
}
