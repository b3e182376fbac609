"""ECMAScript 2022 modules with JSX, and TypeScript 5 with or without JSX: lexer and productions."""

from __future__ import annotations

import re

from plumbline.llm.grammar import ERROR, Bad, Cursor, Symbols

#: Reserved words, contextual words and operators.
RESERVED = (
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return"
    " super switch this throw true try typeof var void while with"
)
CONTEXTUAL = (
    "let static async await yield of get set from as type interface namespace module declare abstract readonly override accessor implements private protected public"
    " keyof infer unique is asserts satisfies global require constructor out"
)
S = Symbols(
    f"{RESERVED} {CONTEXTUAL}",
    "{ } => ; , < > <= >= == != === !== + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= . ... @ #",
    0x100,
)
O = S.of
_KEYWORDS = S.set(RESERVED)
_CONTEXT = S.set(CONTEXTUAL)
_IDENT = r"(?:[$_]|[^\W\d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[$\w\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
_ESCAPE = r"\\(?:\r\n|[^ux0-9]|0(?![0-9])|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{0*(?:10)?[0-9a-fA-F]{1,5}\})"
_TOKEN = re.compile(
    rf"""(?P<ws>[ \t\v\f\xa0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]+)|(?P<nl>[\r\n\u2028\u2029]+)|(?P<id>{_IDENT})|(?P<lc>//[^\r\n\u2028\u2029]*)|(?P<bc>/\*(?:[^*]|\*(?!/))*\*/)
    |(?P<str>"(?:[^"\\\r\n]|{_ESCAPE})*"|'(?:[^'\\\r\n]|{_ESCAPE})*')
    |(?P<num>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:0|[1-9](?:_?\d)*)n|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?))
    |(?P<tick>`)|(?P<open>[(\[{{])|(?P<close>[)\]}}])
    |(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|<=|>=|==|!=|\*\*|\+\+|--|<<|>>|&&|\|\||\?\?|\?\.(?!\d)|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%<>&|^!~?:=.,;@])|(?P<hash>\#{_IDENT})""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/([A-Za-z$_\d]*)")
_TEMPLATE = re.compile(rf"(?:[^`\\$]|\$(?!\{{)|{_ESCAPE}|\\\n)*")
_TAGGED = re.compile(r"(?:[^`\\$]|\$(?!\{)|\\[\s\S])*")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$-]*(?::[A-Za-z_$][\w$-]*|(?:\.[A-Za-z_$][\w$-]*)+)?")
_JSX_ATTR = re.compile(r"[A-Za-z_$][\w$-]*(?::[A-Za-z_$][\w$-]*)?")
_JSX_GAP = re.compile(r"(?:\s+|/\*(?:[^*]|\*(?!/))*\*/|//[^\r\n]*)*")
_JSX_TEXT = re.compile(r"[^{}<>]*")
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b)")
OPENS = {"P": ")", "K": "]", "B": "}", "t": "}", "x": "}", "y": "}", "z": "}"}
_OPEN = {"(": "P", "[": "K", "{": "B"}
#: Symbols after which an operand has ended, so that / divides and < compares.
_DONE = frozenset("n0srT)]}JX#") | S.set("this super null true false ++ --") | _CONTEXT - S.set("await yield of as satisfies keyof infer is readonly")
#: Symbols before which a line end can end a statement.
_STARTS = frozenset("n0srTBJ#!~@") | _KEYWORDS | _CONTEXT | S.set("++ --")
_MAY_END = _DONE | S.set("break continue return debugger throw yield ! > of as is readonly satisfies keyof infer await * =>") | frozenset(":")
#: Words whose parentheses end no operand.
_HEADS = S.set("if while for with")
#: What stands before the brace of a statement's block (of an operand's braces, anything else).
_BEFORE_BLOCK = frozenset(";}\n)B") | S.set("else do try finally =>")
_SHEBANG = re.compile(r"#![^\r\n  ]*")
_TYPE_ARGUMENTS = re.compile(r"<(?:[^<>{}()]|=>|<(?:[^<>{}()]|<[^<>{}()]*>)*>)*>")
_FLAGS = frozenset("dgimsuvy")


def _regex_fits(body: str, flags: str) -> bool:
    """Groups balanced, nothing repeated that can't be."""
    if len(set(flags)) < len(flags) or set(flags) - _FLAGS:
        return False
    depth, i, operand = 0, 0, False
    while i < len(body):
        c = body[i]
        if c == "\\":
            i += 2
            operand = True
            continue
        if c == "[":
            i += 1
            while i < len(body) and body[i] != "]":
                i += 2 if body[i] == "\\" else 1
            operand = True
        elif c == "(":
            depth += 1
            operand = False
            m = _REGEX_GROUP.match(body, i)
            if m:
                i = m.end()
                continue
        elif c == ")":
            depth -= 1
            if depth < 0:
                return False
            operand = True
        elif c in "*+?":
            if not operand:
                return False
            if body[i + 1 : i + 2] == "?":
                i += 1
            operand = False
        elif c == "{":
            m = _REPEAT.match(body, i)
            if m:
                if not operand:
                    return False
                i = m.end() + (body[m.end() : m.end() + 1] == "?")
                operand = False
                continue
            operand = True
        else:
            operand = c not in "|^"
        i += 1
    return depth == 0


_REGEX_GROUP = re.compile(r"\((?:\?(?:[:=!]|<[=!]|<[A-Za-z_$][\w$]*>))")
_REPEAT = re.compile(r"\{\d+(?:,\d*)?\}")


class _Lexer:
    """One pass with a stack of what is open: brackets, templates and elements."""

    def __init__(self, text: str, lang: str):
        self.t = text
        self.ts = lang in ("typescript", "tsx")
        self.jsx = lang in ("javascript", "tsx")
        self.out: list[str] = []
        #: (symbol, closing bracket, what stood before, more): more is whether a template is tagged, or an element's name.
        self.stack: list[tuple] = []
        #: Whether the bracket closed last ends an operand: True, False, or None where a line end decides.
        self.closed: bool | None = True

    def fail(self) -> str:
        self.out.append(ERROR)
        return "".join(self.out)

    def operand_ended(self, newline: bool) -> bool:
        out = self.out
        if not out:
            return False
        prev = out[-1]
        if prev == ")" or prev == "}":
            return not newline if self.closed is None else self.closed
        return prev in _DONE

    def run(self) -> str:
        t, out, stack = self.t, self.out, self.stack
        match, words, ops = _TOKEN.match, S.words, O
        pos, end = 1 if t.startswith("﻿") else 0, len(t)
        m = _SHEBANG.match(t, pos)
        if m:
            pos = m.end()
        newline = False
        while pos < end:
            m = match(t, pos)
            if m is None:
                return self.fail()
            what = m.lastgroup
            if what == "ws" or what == "lc":
                pos = m.end()
                continue
            if what == "nl":
                newline, pos = True, m.end()
                continue
            if what == "bc":
                pos = m.end()
                if "\n" in m.group():
                    newline = True
                continue
            prev = out[-1] if out else ""
            element = False
            if what == "id":
                pos = m.end()
                # after a dot every word is a name
                ch = "n" if prev in (".", ops["?."]) else words.get(m.group(), "n")
            elif what == "op":
                ch = m.group()
                if ch[0] == "/" and not self.operand_ended(newline):
                    r = _REGEX.match(t, pos)
                    if r is None or not _regex_fits(r.group()[1 : -1 - len(r.group(1))], r.group(1)):
                        return self.fail()
                    ch, pos = "r", r.end()
                elif ch == "<" and self.jsx and not self.operand_ended(newline) and not (self.ts and _GENERIC.match(t, pos)):
                    ch, element = "J", True
                elif ch[0] == ">" and self.ts and len(ch) > 1:
                    # in types >> and >= are closing brackets; productions join them again
                    ch, pos = ">", pos + 1
                else:
                    pos = m.end()
                    ch = ops[ch]
            elif what == "open":
                ch = _OPEN[m.group()]
                pos = m.end()
            elif what == "close":
                ch = m.group()
                pos = m.end()
                newline = False
                out.append(ch)
                if not stack or stack[-1][1] != ch:
                    return "".join(out)  # the windows reject it
                top = stack.pop()
                self.closed = self.ends_operand(top)
                if top[0] == "t":
                    pos = self.template(pos)
                elif top[0] in "xyz":
                    pos = self.element(pos)
                if pos < 0:
                    return self.fail()
                continue
            elif what == "num":
                pos = m.end()
                if pos < end and (t[pos].isalnum() or t[pos] in "_$\\"):
                    return self.fail()
                ch = "0"
            elif what == "str":
                pos, ch = m.end(), "s"
            elif what == "hash":
                pos, ch = m.end(), "#"
            else:  # a template; a line end before it doesn't end a statement
                tagged = self.operand_ended(newline)
                newline = False
                out.append("T")
                stack.append(("T", "", prev, tagged))
                pos = self.template(pos + 1)
                if pos < 0:
                    return self.fail()
                continue
            if newline:
                if prev in _MAY_END and ch in _STARTS:
                    out.append("\n")
                newline = False
            out.append(ch)
            if element:
                pos = self.element(self.open_tag(pos))
                if pos < 0:
                    return self.fail()
            elif ch in OPENS:
                stack.append((ch, OPENS[ch], prev, self.closed))
        if stack and stack[-1][0] in ("T", "tag", "kids"):
            return self.fail()
        return "".join(out)

    def ends_operand(self, top: tuple):
        ch, _, before, closed = top
        if ch == "P":
            return before not in _HEADS
        if ch == "B":
            if before == ")":
                # a block after a head; the body of a function, unless the line goes on
                return None if closed is not False else False
            if before == "" or before in _BEFORE_BLOCK:
                return None if before == O["=>"] else False
            return None if before == "n" else True
        return True

    def template(self, pos: int) -> int:
        """Reads on in a template up to its end or the next group; -1 if it has no end."""
        while True:
            pos = (_TAGGED if self.stack[-1][3] else _TEMPLATE).match(self.t, pos).end()
            if self.t.startswith("`", pos):
                self.stack.pop()
                return pos + 1
            if not self.t.startswith("${", pos):
                return -1
            self.out.append("t")
            self.stack.append(("t", "}", "", None))
            return pos + 2

    def open_tag(self, pos: int) -> int:
        """Reads the name of an element whose ``<`` is at pos."""
        t = self.t
        pos = _JSX_GAP.match(t, pos + 1).end()
        m = _JSX_NAME.match(t, pos)
        name = m.group() if m else ""
        if m:
            pos = m.end()
            if self.ts:
                m = _TYPE_ARGUMENTS.match(t, pos)
                if m:
                    pos = m.end()
        self.stack.append(("tag", "", "", name))
        return pos

    def element(self, pos: int) -> int:
        """Reads on in an element's attributes or children up to the next group or its end; -1 if it doesn't fit."""
        t, stack = self.t, self.stack
        while True:
            what, name = stack[-1][0], stack[-1][3]
            if what == "tag":
                pos = _JSX_GAP.match(t, pos).end()
                if t.startswith("/", pos):
                    pos = _JSX_GAP.match(t, pos + 1).end()
                    if not name or not t.startswith(">", pos):
                        return -1
                    pos += 1
                    stack.pop()
                    if not stack or stack[-1][0] not in ("tag", "kids"):
                        return self.leave(pos)
                    continue
                if t.startswith(">", pos):
                    stack[-1] = ("kids", "", "", name)
                    pos += 1
                    continue
                if not name:
                    return -1
                if t.startswith("{", pos):
                    return self.braces(pos, "z")
                m = _JSX_ATTR.match(t, pos)
                if m is None:
                    return -1
                pos = _JSX_GAP.match(t, m.end()).end()
                if t.startswith("=", pos):
                    pos = _JSX_GAP.match(t, pos + 1).end()
                    if t.startswith("{", pos):
                        return self.braces(pos, "y")
                    if t.startswith("<", pos):
                        pos = self.open_tag(pos)
                        continue
                    m = _JSX_STRING.match(t, pos)
                    if m is None:
                        return -1
                    pos = m.end()
                continue
            pos = _JSX_TEXT.match(t, pos).end()
            if t.startswith("{", pos):
                return self.braces(pos, "x")
            if not t.startswith("<", pos):
                return -1
            inner = _JSX_GAP.match(t, pos + 1).end()
            if t.startswith("/", inner):
                inner = _JSX_GAP.match(t, inner + 1).end()
                m = _JSX_NAME.match(t, inner)
                if (m.group() if m else "") != name:
                    return -1
                pos = _JSX_GAP.match(t, m.end() if m else inner).end()
                if not t.startswith(">", pos):
                    return -1
                pos += 1
                stack.pop()
                if not stack or stack[-1][0] not in ("tag", "kids"):
                    return self.leave(pos)
                continue
            pos = self.open_tag(pos)

    def leave(self, pos: int) -> int:
        self.out.append("X")
        return pos

    def braces(self, pos: int, kind: str) -> int:
        self.out.append(kind)
        self.stack.append((kind, "}", "", None))
        return pos + 1


def lex(text: str, lang: str) -> str:
    """The token classes of a file: J and X around an element, T before the groups of a template."""
    return _Lexer(text, lang).run()


_STATEMENTS = ("file", "block", "nsbody", "ambientbody")
_AFTER = S.set("else while")


def cut(symbols: str, kind: str) -> list[tuple[str, str]]:
    """Statements of a block, split after semicolons where no statement goes on."""
    if kind not in _STATEMENTS or ";" not in symbols:
        return [(symbols, kind)]
    out, last, i = [], 0, symbols.find(";")
    while i >= 0:
        nxt = symbols[i + 1 : i + 2]
        if nxt == "\n":
            nxt = symbols[i + 2 : i + 3]
        if nxt and nxt not in _AFTER:
            out.append((symbols[last : i + 1], kind))
            last = i + 1
        i = symbols.find(";", i + 1)
    out.append((symbols[last:], kind))
    return out


def parse(symbols: str, kind: str, lang: str):
    p = _Script(symbols, lang)
    getattr(p, "k_" + kind)()
    p.skip()
    if p.i != len(symbols):
        raise Bad
    return tuple(k for _, k in sorted(p.kinds.items()))


_ASSIGN = S.set("+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=")
_BINARY = S.set("< > <= >= == != === !== + - * / % ** << >> >>> & | ^ && || ?? instanceof in")
_PREFIX = S.set("! ~ + - typeof void delete await")
_NAMES = frozenset("n") | _CONTEXT
_WORDS = _NAMES | _KEYWORDS
_KEYS = _WORDS | frozenset("0s#K")
_MODIFIERS = S.set("static async get set readonly declare abstract override accessor private protected public")
_CONTINUES = S.set("in instanceof")


class _Script(Cursor):
    def __init__(self, s: str, lang: str):
        super().__init__(s)
        self.ts = lang in ("typescript", "tsx")
        self.tsx = lang == "tsx"
        self.no_in = False
        self.no_cond_arrow = False

    # --- line ends ----------------------------------------------------------------------------
    def skip(self) -> None:
        if self.s[self.i] == "\n":
            self.i += 1

    def after(self) -> str:
        """The next symbol, line ends disregarded."""
        return self.s[self.i + 1] if self.s[self.i] == "\n" else self.s[self.i]

    def want(self, ch: str) -> None:
        self.skip()
        self.need(ch)

    def got(self, ch: str) -> bool:
        if self.after() == ch:
            self.skip()
            self.i += 1
            return True
        return False

    def sub(self, ch: str, kind: str) -> None:
        self.skip()
        self.group(ch, kind)

    def name(self) -> None:
        self.skip()
        if self.c not in _NAMES:
            raise Bad
        self.i += 1

    def semicolon(self) -> None:
        if self.eat(";") or self.c in "\n\0":
            return
        raise Bad

    # --- statements ---------------------------------------------------------------------------
    def k_file(self):
        self.statements(True)

    def k_nsbody(self):
        self.statements(True)

    def k_ambientbody(self):
        self.ambient = True
        self.statements(True)

    def k_block(self):
        self.statements(False)

    def statements(self, module: bool):
        while True:
            self.skip()
            if self.c == "\0":
                return
            self.statement(module, True)

    def statement(self, module: bool = False, item: bool = False):
        self.skip()
        c, nx = self.c, self.peek()
        f = _STATEMENT.get(c)
        if c == ";":
            self.i += 1
        elif c == "B":
            self.group("B", "block")
        elif f is not None:
            if c in _ITEMS and not item:
                raise Bad
            if c in (O["import"], O["export"]) and not (c == O["import"] and nx in ("P", ".")):
                if not module:
                    raise Bad
            f(self)
        elif c in _NAMES and nx == ":":
            self.i += 2
            self.statement()
        elif c == O["async"] and nx == O["function"]:
            if not item:
                raise Bad
            self.i += 1
            self.function()
        elif c == O["let"] and nx in (_NAMES | {"B", "K"}) and item:
            self.lexical()
        elif c == "@":
            self.decorators()
            self.got(O["export"]) and self.got(O["default"])
            if self.ts:
                self.got(O["abstract"])
            self.class_()
        elif self.ts and c in _TS_STATEMENTS and self.ts_statement(module, item):
            pass
        else:
            self.expression()
            self.semicolon()

    def lexical(self):
        const = self.c == O["const"]
        self.i += 1
        if const and self.ts and self.c == O["enum"]:
            return self.enum()
        self.declarators(True, const)
        self.semicolon()

    def declarators(self, init_needed: bool, const: bool = False):
        while True:
            self.skip()
            pattern = self.c in "BK"
            self.binding()
            if self.ts:
                if self.c == "!" and self.peek() == ":":
                    self.i += 1
                if self.got(":"):
                    self.type()
            if self.got("="):
                self.assign()
            elif init_needed and (pattern or const) and not self.ambient:
                raise Bad
            if not self.got(","):
                return

    ambient = False

    def binding(self):
        self.skip()
        if self.c == "B":
            self.group("B", "pattern")
        elif self.c == "K":
            self.group("K", "listpattern")
        else:
            self.name()

    def k_pattern(self):
        while self.after() != "\0":
            if self.got(O["..."]):
                self.binding()
                self.skip()
                if self.c != "\0":
                    raise Bad
                return
            self.skip()
            c = self.c
            plain = c in _NAMES
            self.key()
            if self.got(":"):
                self.element_pattern()
            else:
                if not plain:
                    raise Bad
                if self.got("="):
                    self.assign()
            if self.after() != "\0":
                self.want(",")

    def element_pattern(self):
        self.binding()
        if self.got("="):
            self.assign()

    def k_listpattern(self):
        while self.after() != "\0":
            if self.got(","):
                continue
            if self.got(O["..."]):
                self.binding()
                self.skip()
                if self.c != "\0":
                    raise Bad
                return
            self.element_pattern()
            if self.after() != "\0":
                self.want(",")

    def var(self):
        self.i += 1
        self.declarators(True)
        self.semicolon()

    def if_(self):
        self.i += 1
        self.sub("P", "cond")
        self.statement()
        if self.after() == O["else"]:
            self.skip()
            self.i += 1
            self.statement()

    def while_(self):
        self.i += 1
        self.sub("P", "cond")
        self.statement()

    def do(self):
        self.i += 1
        self.statement()
        self.want(O["while"])
        self.sub("P", "cond")
        self.eat(";")

    def for_(self):
        self.i += 1
        self.sub("P", "awaithead" if self.got(O["await"]) else "forhead")
        self.statement()

    def k_cond(self):
        self.expression()

    def k_forhead(self):
        if self.attempt(self.for_each):
            return
        self.no_in = True
        if self.c in (O["var"], O["const"]) or self.c == O["let"] and self.peek() in (_NAMES | {"B", "K"}):
            self.i += 1
            self.declarators(True, self.s[self.i - 1] == O["const"])
        elif self.c != ";":
            self.expression()
        self.no_in = False
        self.want(";")
        if self.after() != ";":
            self.expression()
        self.want(";")
        if self.after() != "\0":
            self.expression()

    def k_awaithead(self):
        self.for_each(True)

    def for_each(self, awaits: bool = False):
        if self.c in (O["var"], O["const"], O["let"]) and self.peek() in (_NAMES | {"B", "K"}) and not (self.c == O["let"] and self.peek() == O["of"]):
            self.i += 1
            self.binding()
            if self.ts and self.got(":"):
                self.type()
        else:
            if not self.unary_is_target():
                raise Bad
        if self.got(O["of"]):
            self.assign()
        elif awaits:
            raise Bad
        else:
            self.want(O["in"])
            self.expression()
        self.skip()
        if self.c != "\0":
            raise Bad

    def unary_is_target(self) -> bool:
        kind = self.unary()
        self.pattern(kind)
        return kind in ("ref", "group", "object", "array")

    def pattern(self, kind: str) -> None:
        """What was read last as an object or array is assigned to."""
        if kind in ("object", "array"):
            self.kinds[self.i - 1] = "assigned" + kind

    def return_(self):
        self.i += 1
        if self.c not in "\n\0;":
            self.expression()
        self.semicolon()

    def jump(self):
        self.i += 1
        if self.c in _NAMES:
            self.i += 1
        self.semicolon()

    def throw(self):
        self.i += 1
        if self.c in "\n\0;":
            raise Bad
        self.expression()
        self.semicolon()

    def try_(self):
        self.i += 1
        self.sub("B", "block")
        some = False
        if self.got(O["catch"]):
            some = True
            if self.after() == "P":
                self.sub("P", "catch")
            self.sub("B", "block")
        if self.got(O["finally"]):
            some = True
            self.sub("B", "block")
        if not some:
            raise Bad

    def k_catch(self):
        self.binding()
        if self.ts and self.got(":"):
            self.type()

    def switch(self):
        self.i += 1
        self.sub("P", "cond")
        self.sub("B", "switchbody")

    def k_switchbody(self):
        defaults = 0
        while self.after() != "\0":
            self.skip()
            if self.eat(O["default"]):
                defaults += 1
                if defaults > 1:
                    raise Bad
            else:
                self.need(O["case"])
                self.expression()
            self.want(":")
            while self.after() not in ("\0", O["case"], O["default"]):
                self.statement(False, True)

    def debugger(self):
        self.i += 1
        self.semicolon()

    def import_(self):
        if self.peek() in ("P", "."):
            self.expression()
            return self.semicolon()
        self.i += 1
        self.skip()
        if self.c == "s":
            self.i += 1
            return self.import_end()
        if self.ts and self.c == O["type"] and (self.peek() in ("B", "*") or self.peek() in _NAMES and not (self.peek() == O["from"] and self.peek(2) == "s")):
            self.i += 1
        some = False
        if self.c in _NAMES:
            self.i += 1
            some = True
            if self.ts and self.got("="):
                if self.c == O["require"] and self.peek() == "P":
                    self.i += 1
                    self.sub("P", "args")
                else:
                    self.name()
                    while self.eat("."):
                        self.name()
                return self.semicolon()
            if self.after() == O["from"]:
                some = False
                self.skip()
                self.i += 1
                self.want("s")
                return self.import_end()
            self.want(",")
        if self.got("*"):
            self.want(O["as"])
            self.name()
        elif self.after() == "B":
            self.sub("B", "imports")
        else:
            raise Bad
        self.want(O["from"])
        self.want("s")
        self.import_end()

    def import_end(self):
        if self.c == O["with"] and self.peek() == "B":
            if not self.ts:
                raise Bad
            self.i += 1
            self.sub("B", "object")
        self.semicolon()

    def k_imports(self):
        while self.after() != "\0":
            self.skip()
            if self.ts and self.c == O["type"] and (self.peek() in _WORDS or self.peek() == "s") and not (self.peek() == O["as"] and self.peek(2) in (",", "\0")):
                self.i += 1
            if self.c == "s" or self.c in _WORDS and self.c not in _NAMES:
                self.i += 1
                self.want(O["as"])
                self.name()
            else:
                self.name()
                if self.got(O["as"]):
                    self.name()
            if self.after() != "\0":
                self.want(",")

    def k_exports(self):
        while self.after() != "\0":
            self.skip()
            if self.ts and self.c == O["type"] and (self.peek() in _WORDS or self.peek() == "s") and not (self.peek() == O["as"] and self.peek(2) in (",", "\0")):
                self.i += 1
            self.module_name()
            if self.got(O["as"]):
                self.module_name()
            if self.after() != "\0":
                self.want(",")

    def module_name(self):
        self.skip()
        if self.c not in _WORDS and self.c != "s":
            raise Bad
        self.i += 1

    def export(self):
        self.i += 1
        self.skip()
        c = self.c
        if c == O["default"]:
            self.i += 1
            self.skip()
            c = self.c
            if c == O["function"] or c == O["async"] and self.peek() == O["function"]:
                self.got(O["async"])
                self.function(False)
            elif c == O["class"] or c == "@":
                self.decorators()
                self.class_()
            elif self.ts and c == O["abstract"] and self.peek() == O["class"]:
                self.i += 1
                self.class_()
            elif self.ts and c == O["interface"] and self.peek() in _NAMES:
                self.interface()
            else:
                self.assign()
                self.semicolon()
        elif c == "*":
            self.i += 1
            if self.got(O["as"]):
                self.module_name()
            self.want(O["from"])
            self.want("s")
            self.import_end()
        elif c == "B" or self.ts and c == O["type"] and self.peek() in ("B", "*"):
            if c == O["type"]:
                self.i += 1
            if self.got("*"):
                self.got(O["as"]) and self.module_name()
                self.want(O["from"])
            else:
                self.sub("B", "exports")
                if not self.got(O["from"]):
                    return self.semicolon()
            self.want("s")
            self.import_end()
        elif self.ts and c == "=":
            self.i += 1
            self.expression()
            self.semicolon()
        elif self.ts and c == O["as"]:
            self.i += 1
            self.want(O["namespace"])
            self.name()
            self.semicolon()
        elif self.ts and c == O["import"]:
            self.import_()
        elif c in (O["var"], O["const"], O["function"], O["class"], "@") or c == O["let"] or c == O["async"] and self.peek() == O["function"]:
            self.statement(False, True)
        elif self.ts and (c == O["enum"] or c in _TS_STATEMENTS and self.ts_statement(True, True)):
            if c == O["enum"]:
                self.enum()
        else:
            raise Bad

    # --- TypeScript statements ----------------------------------------------------------------
    def ts_statement(self, module: bool, item: bool) -> bool:
        c, nx = self.c, self.peek()
        if c == O["interface"] and nx in _NAMES:
            self.interface()
        elif c == O["type"] and nx in _NAMES:
            self.i += 1
            self.name()
            self.type_params()
            self.want("=")
            self.type()
            self.semicolon()
        elif c in (O["namespace"], O["module"]) and (nx in _NAMES or nx == "s"):
            self.i += 1
            named = not self.eat("s")
            if named:
                self.name()
                while self.eat("."):
                    self.name()
            if self.after() == "B":
                self.sub("B", "ambientbody" if self.ambient or not named else "nsbody")
            else:
                self.semicolon()
        elif c == O["global"] and nx == "B":
            self.i += 1
            self.sub("B", "ambientbody")
        elif c == O["abstract"] and nx == O["class"]:
            self.i += 1
            self.class_()
        elif c == O["declare"] and (nx in S.set("const let var function class enum namespace module global abstract type interface async")):
            self.i += 1
            self.ambient = True
            self.statement(module, item)
            self.ambient = False
        else:
            return False
        return True

    def interface(self):
        self.i += 1
        self.name()
        self.type_params()
        if self.got(O["extends"]):
            self.type_refs()
        self.sub("B", "members")

    def type_refs(self):
        while True:
            self.type()
            if not self.got(","):
                return

    def enum(self):
        self.i += 1
        if not self.ts:
            raise Bad
        self.name()
        self.sub("B", "enumbody")

    def k_enumbody(self):
        while self.after() != "\0":
            self.skip()
            if self.c in _WORDS or self.c == "s":
                self.i += 1
            elif self.c == "K":
                self.group("K", "computed")
            else:
                raise Bad
            if self.got("="):
                self.assign()
            if self.after() != "\0":
                self.want(",")

    # --- functions and classes ----------------------------------------------------------------
    def function(self, named: bool = True):
        self.want(O["function"])
        self.got("*")
        self.skip()
        if self.c in _NAMES:
            self.i += 1
        elif named:
            raise Bad
        self.rest_of_function(True)

    def rest_of_function(self, bodyless: bool = False):
        if self.ts:
            self.type_params()
        self.sub("P", "params")
        if self.ts and self.got(":"):
            self.return_type()
        if self.c != "B" and self.after() != "B" and self.ts and bodyless:
            return self.semicolon()
        self.sub("B", "block")

    def k_params(self):
        while self.after() != "\0":
            self.decorators()
            self.skip()
            if self.ts:
                while self.c in _MODIFIERS and self.peek() in (_NAMES | {"B", "K"}):
                    self.i += 1
                if self.c == O["this"]:
                    self.i += 1
                    if self.got(":"):
                        self.type()
                    if self.after() != "\0":
                        self.want(",")
                    continue
            rest = self.got(O["..."])
            self.binding()
            if self.ts:
                self.got("?")
                if self.got(":"):
                    self.type()
            if self.got("="):
                if rest:
                    raise Bad
                self.assign()
            if self.after() != "\0":
                if rest:
                    raise Bad
                self.want(",")

    def decorators(self):
        while self.got("@"):
            if self.c == "P":
                self.sub("P", "paren")
            else:
                self.name()
                while self.c == ".":
                    self.i += 1
                    self.need("n")
                if self.c == "P":
                    self.group("P", "args")

    def class_(self):
        self.want(O["class"])
        self.skip()
        if self.c in _NAMES and not (self.c == O["implements"] and self.ts):
            self.i += 1
        if self.ts:
            self.type_params()
        if self.got(O["extends"]):
            self.left_hand(no_object=True)
            if self.ts and self.after() == "<":
                self.type_args()
        if self.ts and self.got(O["implements"]):
            self.type_refs()
        self.sub("B", "classbody")

    def k_classbody(self):
        while True:
            self.skip()
            if self.c == "\0":
                return
            if self.eat(";"):
                continue
            self.member()

    def key(self):
        self.skip()
        if self.c == "K":
            self.group("K", "computed")
        elif self.c in _KEYS:
            self.i += 1
        else:
            raise Bad

    def member(self):
        self.decorators()
        self.skip()
        if self.c == O["static"] and self.peek() == "B":
            self.i += 1
            return self.group("B", "block")
        if self.ts and self.c == "K" and self.attempt(self.index_signature):
            return
        accessor = False
        while self.c in (_MODIFIERS if self.ts else S.set("static async get set accessor")) and (self.after_modifier()):
            if self.c == O["accessor"] and not self.ts:
                raise Bad
            accessor = accessor or self.c in (O["get"], O["set"])
            self.i += 1
            self.skip()
            if self.ts and self.c == "K" and self.attempt(self.index_signature):
                return
        star = self.eat("*")
        self.key()
        if self.ts and not self.eat("?"):
            self.eat("!")
        if self.c == "P" or self.ts and self.c == "<":
            if self.ts:
                self.type_params()
            self.sub("P", "params")
            if self.ts and self.got(":"):
                self.return_type()
            if self.after() == "B":
                self.sub("B", "block")
            elif self.ts:
                self.semicolon()
            else:
                raise Bad
            return
        if star or accessor:
            raise Bad
        if self.ts and self.got(":"):
            self.type()
        if self.got("="):
            self.assign()
        self.semicolon()

    def after_modifier(self) -> bool:
        """A modifier is one if a member's name follows, and not if it is the name itself."""
        nx = self.peek()
        if nx == "\n":
            return self.c not in S.set("async get set accessor") and self.peek(2) in _KEYS and self.ts or self.c == O["static"]
        return nx in _KEYS or nx == "*" and self.c in S.set("async static private protected public override")

    def index_signature(self):
        self.group("K", "indexsig")
        self.want(":")
        self.type()
        self.member_end()

    def member_end(self):
        if self.c in ",;":
            self.i += 1
        elif self.c not in "\n\0":
            raise Bad

    # --- expressions --------------------------------------------------------------------------
    def expression(self):
        self.assign()
        while self.got(","):
            self.assign()

    def assign(self):
        self.skip()
        c = self.c
        if c in (O["yield"],) and self.peek() not in (O["=>"], "=", ".", ")", ",", ";", "\0", ":", "K", "P") or c == O["yield"] and self.peek() in ";\0,P":
            self.i += 1
            if self.c in "\n\0;,:":
                return
            self.eat("*")
            return self.assign()
        if self.arrow():
            return
        kind = self.conditional()
        c = self.after()
        if c == "=":
            if kind not in ("ref", "object", "array", "group"):
                raise Bad
            self.pattern(kind)
            self.skip()
            self.i += 1
            self.assign()
        elif c in _ASSIGN:
            if kind not in ("ref", "group"):
                raise Bad
            self.skip()
            self.i += 1
            self.assign()
        elif c == ">" and self.ts and kind in ("ref", "group") and self.s.startswith((">" + O[">="], ">>" + O[">="], ">" * 2 + "=", ">" * 3 + "="), self.i):
            while self.eat(">"):
                pass
            self.i += 1
            self.assign()
        elif self.covers:
            self.pattern(kind)

    #: Whether the objects of this group are assigned to.
    covers = False

    def k_assignedobject(self):
        self.covers = True
        self.k_object()

    def k_assignedarray(self):
        self.covers = True
        self.k_array()

    def arrow(self) -> bool:
        i = self.i
        j = i + 1 if self.s[i] == O["async"] and self.s[i + 1] != "\n" else i
        c, nx = self.s[j], self.s[j + 1] if j + 1 < len(self.s) else "\0"
        if c in _NAMES and nx == O["=>"]:
            self.i = j + 2
            self.arrow_body()
            return True
        if c == O["async"] and nx == O["=>"]:
            self.i = j + 2
            self.arrow_body()
            return True
        if c == "P" and nx == O["=>"]:
            self.i = j
            self.group("P", "params")
            self.i += 1
            self.arrow_body()
            return True
        if self.ts and (c == "<" or c == "P" and nx == ":"):
            if c == "P" and self.no_cond_arrow:
                return False

            def head():
                self.i = j
                self.type_params()
                self.sub("P", "params")
                if self.got(":"):
                    self.return_type()
                self.need(O["=>"])

            if self.attempt(head):
                self.arrow_body()
                return True
        self.i = i
        return False

    def arrow_body(self):
        self.skip()
        if self.c == "B":
            self.group("B", "block")
        else:
            self.assign()

    def conditional(self) -> str:
        kind = self.binary()
        if self.after() == "?":
            self.skip()
            self.i += 1
            if self.ts:
                i, kinds, old = self.i, dict(self.kinds), self.no_cond_arrow
                if self.attempt(lambda: (self.assign(), self.want(":"), self.assign())):
                    return "value"
                self.i, self.kinds = i, kinds
                self.no_cond_arrow = True
                try:
                    self.assign()
                finally:
                    self.no_cond_arrow = old
            else:
                old_in, self.no_in = self.no_in, False
                self.assign()
                self.no_in = old_in
            self.want(":")
            self.assign()
            return "value"
        return kind

    def binary(self) -> str:
        kind = self.unary()
        while True:
            c = self.after()
            if self.ts and c in (O["as"], O["satisfies"]) and self.c == c:
                self.i += 1
                if not self.eat(O["const"]):
                    self.type()
                kind = "group" if kind in ("ref", "group") else "value"
                continue
            if c not in _BINARY or c == O["in"] and self.no_in:
                return kind
            self.skip()
            if c == ">" and self.ts:
                # > >= >> >>= >>> >>>= arrive as single signs
                n = 0
                while self.c == ">" and n < 3:
                    self.i += 1
                    n += 1
                if self.c == "=" or self.c in (O["=="],):
                    if n > 1 and self.c == "=":
                        self.i -= n
                        return kind
                    if self.c == O["=="]:
                        raise Bad
                    self.i += 1
            else:
                self.i += 1
            if c == O["**"] and kind == "unary":
                raise Bad
            self.unary()
            kind = "value"

    def unary(self) -> str:
        self.skip()
        c = self.c
        if c in _PREFIX and not (c == O["await"] and self.peek() in (O["=>"], "=", ".", ",", ";", "\0")):
            self.i += 1
            self.unary()
            return "unary" if c != O["await"] else "value"
        if c in (O["++"], O["--"]):
            self.i += 1
            if self.unary() not in ("ref", "group"):
                raise Bad
            return "value"
        if c == "<" and self.ts and not self.tsx:
            self.i += 1
            if not self.eat(O["const"]):
                self.type()
            self.want(">")
            self.unary()
            return "value"
        if c == "#" and self.after_hash_in():
            self.i += 1
            return "value"
        kind = self.left_hand()
        if self.c in (O["++"], O["--"]):
            if kind not in ("ref", "group"):
                raise Bad
            self.i += 1
            return "value"
        return kind

    def after_hash_in(self) -> bool:
        return self.peek() == O["in"]

    def left_hand(self, no_object: bool = False) -> str:
        kind, chain = self.primary(), False
        while True:
            c = self.after()
            if c == ".":
                self.skip()
                self.i += 1
                if self.c not in "n#":
                    raise Bad
                self.i += 1
                kind = "ref"
            elif c == O["?."]:
                self.skip()
                self.i += 1
                chain = True
                if self.c == "P":
                    self.group("P", "args")
                elif self.c == "K":
                    self.group("K", "index")
                elif self.ts and self.c == "<":
                    self.type_args()
                    self.sub("P", "args")
                elif self.c in "n#":
                    self.i += 1
                else:
                    raise Bad
                kind = "value"
            elif c == "K":
                self.sub("K", "index")
                kind = "ref"
            elif c == "P":
                self.sub("P", "args")
                kind = "value"
            elif c == "T":
                if chain:
                    raise Bad
                self.template()
                kind = "value"
            elif c == "!" and self.ts and self.c == "!":
                self.i += 1
            elif c == "<" and self.ts and kind != "value0" and self.attempt(self.call_types):
                kind = "value"
            else:
                return "value" if chain and kind == "ref" else kind

    def call_types(self):
        self.type_args()
        c = self.after()
        if c not in ("P", "T") and (c in _DONE or c in _PREFIX or c in "BK<"):
            raise Bad

    def template(self):
        self.want("T")
        while self.c == "t":
            self.group("t", "cond")

    def primary(self) -> str:
        self.skip()
        c = self.c
        if c in _NAMES:
            if c == O["async"] and self.peek() == O["function"]:
                self.i += 1
                self.function(False)
                return "value"
            self.i += 1
            return "ref"
        if c in "0sr":
            self.i += 1
            return "value"
        if c in _SIMPLE:
            self.i += 1
            return "value"
        if c == "P":
            self.group("P", "paren")
            return "group"
        if c == "K":
            self.group("K", "array")
            return "array"
        if c == "B":
            self.group("B", "object")
            return "object"
        if c == "T":
            self.template()
            return "value"
        if c == "J":
            self.i += 1
            while self.c in "xyz" and self.c != "\0":
                self.group(self.c, {"x": "jsxchild", "y": "cond", "z": "spread"}[self.c])
            self.need("X")
            return "value"
        if c == O["function"]:
            self.function(False)
            return "value"
        if c == O["class"] or c == "@":
            self.decorators()
            self.class_()
            return "value"
        if c == O["new"]:
            self.i += 1
            if self.eat("."):
                self.need("n")
                return "value"
            self.new_target()
            return "value"
        if c == O["super"]:
            self.i += 1
            if self.after() not in ("P", ".", "K"):
                raise Bad
            return "value"
        if c == O["import"]:
            self.i += 1
            if self.eat("."):
                self.need("n")
            elif self.c != "P":
                raise Bad
            return "value"
        raise Bad

    def new_target(self):
        self.skip()
        if self.c == O["new"]:
            self.i += 1
            if self.eat("."):
                self.need("n")
            else:
                self.new_target()
        else:
            self.primary()
        while True:
            c = self.after()
            if c == ".":
                self.skip()
                self.i += 1
                if self.c not in "n#":
                    raise Bad
                self.i += 1
            elif c == "K":
                self.sub("K", "index")
            elif c == "T":
                self.template()
            elif self.ts and c == "<" and self.attempt(self.call_types):
                pass
            else:
                break
        if self.c == "P":
            self.group("P", "args")

    def k_paren(self):
        self.expression()

    def k_index(self):
        self.expression()

    def k_computed(self):
        self.assign()

    def k_spread(self):
        self.need(O["..."])
        self.assign()

    def k_jsxchild(self):
        if self.after() == "\0":
            return
        if self.got(O["..."]):
            self.assign()
        else:
            self.expression()

    def k_args(self):
        while self.after() != "\0":
            self.got(O["..."])
            self.assign()
            if self.after() != "\0":
                self.want(",")

    def k_array(self):
        while self.after() != "\0":
            if self.got(","):
                continue
            self.got(O["..."])
            self.assign()
            if self.after() != "\0":
                self.want(",")

    def k_object(self):
        while self.after() != "\0":
            self.skip()
            if self.eat(O["..."]):
                self.assign()
            else:
                self.property()
            if self.after() != "\0":
                self.want(",")

    def property(self):
        accessor = False
        while self.c in S.set("async get set") and (self.peek() in _KEYS or self.peek() == "*" and self.c == O["async"]):
            accessor = True
            self.i += 1
        star = self.eat("*")
        c = self.c
        self.key()
        if self.after() in ("P", "<") and (self.after() == "P" or self.ts):
            return self.rest_of_function()
        if accessor or star:
            raise Bad
        if self.got(":"):
            return self.assign()
        if c not in _NAMES:
            raise Bad
        if self.got("="):
            if not self.covers:
                raise Bad
            self.assign()

    # --- types --------------------------------------------------------------------------------
    def type_params(self):
        if self.after() != "<":
            return
        self.skip()
        self.i += 1
        while True:
            self.skip()
            while self.c in (O["const"], O["in"], O["out"]) and self.peek() in _NAMES:
                self.i += 1
            self.name()
            if self.got(O["extends"]):
                self.type()
            if self.got("="):
                self.type()
            if self.got(">"):
                return
            self.want(",")
            if self.got(">"):
                return

    def type_args(self):
        self.want("<")
        while True:
            self.type()
            if self.got(">"):
                return
            self.want(",")

    def return_type(self):
        self.skip()
        if self.c == O["asserts"] and self.peek() in (_NAMES | {O["this"]}):
            self.i += 2
            if self.got(O["is"]):
                self.type()
            return
        if self.c in (_NAMES | {O["this"]}) and self.peek() == O["is"]:
            self.i += 2
            return self.type()
        self.type()

    def type(self):
        self.skip()
        if self.c == O["new"] or self.c == O["abstract"] and self.peek() == O["new"]:
            self.got(O["abstract"])
            self.i += 1
            self.type_params()
            self.sub("P", "params")
            self.want(O["=>"])
            return self.return_type()
        if self.c == "<" or self.c == "P" and self.peek() == O["=>"]:
            self.type_params()
            self.sub("P", "params")
            self.want(O["=>"])
            return self.return_type()
        self.union()
        if self.c == O["extends"] and not self.no_extends:
            self.i += 1
            old, self.no_extends = self.no_extends, True
            self.type()
            self.no_extends = old
            self.want("?")
            self.type()
            self.want(":")
            self.type()

    no_extends = False

    def union(self):
        self.got("|") or self.got("&")
        while True:
            self.type_operand()
            if not (self.got("|") or self.got("&")):
                return

    def type_operand(self):
        self.skip()
        if self.c == "P" and self.peek() == O["=>"] or self.c == "<" or self.c == O["new"]:
            return self.type()
        if self.c in S.set("keyof unique readonly") and (self.peek() in _WORDS or self.peek() in "PKBsT0"):
            self.i += 1
            return self.type_operand()
        if self.c == O["infer"] and self.peek() in _NAMES:
            self.i += 2
            if self.c == O["extends"]:
                i, kinds = self.i, dict(self.kinds)
                self.i += 1
                self.union()
                if self.c == "?" and not self.no_extends:
                    self.i, self.kinds = i, kinds
            return self.array_suffix()
        c = self.c
        if c == O["typeof"]:
            self.i += 1
            if self.c == O["import"]:
                self.import_type()
            else:
                if self.c not in _NAMES and self.c != O["this"]:
                    raise Bad
                self.i += 1
                while self.eat("."):
                    if self.c not in "n#":
                        raise Bad
                    self.i += 1
            if self.c == "<":
                self.type_args()
        elif c == O["import"]:
            self.import_type()
            if self.c == "<":
                self.type_args()
        elif c in _NAMES:
            self.i += 1
            while self.c == ".":
                self.i += 1
                self.need("n")
            if self.c == "<":
                self.type_args()
        elif c in S.set("void null this true false"):
            self.i += 1
        elif c in "0s":
            self.i += 1
        elif c == "-":
            self.i += 1
            self.need("0")
        elif c == "T":
            self.i += 1
            while self.c == "t":
                self.group("t", "onetype")
        elif c == "P":
            self.group("P", "onetype")
        elif c == "K":
            self.group("K", "tuple")
        elif c == "B":
            self.group("B", "members")
        else:
            raise Bad
        self.array_suffix()

    def import_type(self):
        self.i += 1
        self.sub("P", "args")
        while self.eat("."):
            self.need("n")

    def array_suffix(self):
        while self.c == "K":
            self.group("K", "suffix")

    def k_suffix(self):
        if self.after() != "\0":
            self.type()

    def k_onetype(self):
        self.return_type()

    def k_tuple(self):
        while self.after() != "\0":
            self.got(O["..."])
            self.skip()
            if self.c in _WORDS and (self.peek() == ":" or self.peek() == "?" and self.peek(2) == ":"):
                self.i += 1
                self.eat("?")
                self.need(":")
                self.type()
            else:
                self.type()
            self.got("?")
            if self.after() != "\0":
                self.want(",")

    def k_indexsig(self):
        self.name()
        self.want(":")
        self.type()

    def k_mappedkey(self):
        self.name()
        self.want(O["in"])
        self.type()
        if self.got(O["as"]):
            self.type()

    def k_members(self):
        while True:
            self.skip()
            if self.c == "\0":
                return
            if self.c in ",;":
                self.i += 1
                continue
            self.type_member()

    def type_member(self):
        i, kinds = self.i, dict(self.kinds)
        if self.c in "+-":
            self.i += 1
        if self.c == O["readonly"] and self.peek() in "K":
            self.i += 1
        if self.c == "K":
            if self.attempt(self.index_signature) or self.attempt(self.mapped):
                return
        self.i, self.kinds = i, kinds
        if self.c == O["new"] and self.peek() in "P<":
            self.i += 1
        if self.c in "P<" :
            self.type_params()
            self.sub("P", "params")
            if self.got(":"):
                self.return_type()
            return self.member_end()
        while self.c in S.set("readonly get set") and self.peek() in _KEYS:
            self.i += 1
        self.key()
        self.eat("?")
        if self.c in "P<":
            self.type_params()
            self.sub("P", "params")
            if self.got(":"):
                self.return_type()
        elif self.got(":"):
            self.type()
        self.member_end()

    def mapped(self):
        self.group("K", "mappedkey")
        if self.c in "+-":
            self.i += 1
        self.eat("?")
        if self.got(":"):
            self.type()
        self.member_end()


_SIMPLE = S.set("this null true false")
_ITEMS = S.set("const class function import export enum")
_TS_STATEMENTS = S.set("interface type namespace module global abstract declare")
_STATEMENT = {
    O["const"]: _Script.lexical, O["var"]: _Script.var, O["if"]: _Script.if_, O["while"]: _Script.while_, O["do"]: _Script.do, O["for"]: _Script.for_,
    O["return"]: _Script.return_, O["break"]: _Script.jump, O["continue"]: _Script.jump, O["throw"]: _Script.throw, O["try"]: _Script.try_,
    O["switch"]: _Script.switch, O["debugger"]: _Script.debugger, O["import"]: _Script.import_, O["export"]: _Script.export, O["enum"]: _Script.enum,
    O["function"]: _Script.function, O["class"]: _Script.class_,
}

