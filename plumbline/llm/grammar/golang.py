"""Go 1.22: lexer with automatic semicolons, and productions of declarations, statements, types and expressions."""

from __future__ import annotations

import re

from plumbline.llm.grammar import ERROR, Bad, Cursor, Symbols

#: Keywords and operators of Go.
S = Symbols(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "+ - * / % & | ^ << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= && || <- ++ -- == < > = ! ~ != <= >= := ... , . : ; @",
    0x100,
)
O = S.of
_TOKEN = re.compile(
    r"""(?P<ws>[ \t\r]+)|(?P<nl>\n)|(?P<id>[^\W\d]\w*)|(?P<lc>//[^\n]*)|(?P<bc>/\*(?:[^*]|\*(?!/))*\*/)
    |(?P<str>"(?:[^"\\\n]|\\(?:[abfnrtv\\"]|x[0-9a-fA-F]{2}|[0-7]{3}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*")|(?P<raw>`[^`]*`)
    |(?P<rune>'(?:[^'\\\n]|\\(?:[abfnrtv\\']|x[0-9a-fA-F]{2}|[0-7]{3}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')
    |(?P<num>(?:0[xX](?:_?[0-9a-fA-F])*(?:\.(?:[0-9a-fA-F](?:_?[0-9a-fA-F])*)?)?(?:[pP][+-]?\d(?:_?\d)*)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+
      |(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)i?)
    |(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!~,.:;])|(?P<open>[(\[{])|(?P<close>[)\]}])""",
    re.X,
)
OPENS = {"P": ")", "K": "]", "B": "}"}
_OPEN = {"(": "P", "[": "K", "{": "B"}
_ENDS = frozenset("n0s)]}") | S.set("break continue fallthrough return ++ --")


def lex(text: str) -> str:
    """The token classes of a file; ``\\n`` is an inserted semicolon, left out before a closing brace."""
    out: list[str] = []
    words = S.words
    pos, end = 1 if text.startswith("\ufeff") else 0, len(text)
    match = _TOKEN.match
    while pos < end:
        m = match(text, pos)
        if m is None:
            return "".join(out) + ERROR
        pos = m.end()
        what = m.lastgroup
        if what == "ws":
            continue
        if what == "id":
            out.append(words.get(m.group(), "n"))
        elif what == "nl" or what == "lc":
            if what == "nl" and out and out[-1] in _ENDS:
                out.append("\n")
        elif what == "op":
            out.append(O[m.group()])
        elif what == "open":
            out.append(_OPEN[m.group()])
        elif what == "close":
            ch = m.group()
            if ch == "}" and out and out[-1] == "\n":
                out.pop()
            out.append(ch)
        elif what == "bc":
            if "\n" in m.group() and out and out[-1] in _ENDS:
                out.append("\n")
        elif what == "num":
            t = m.group()
            if text[pos : pos + 1].isalnum() or text[pos : pos + 1] == "_":
                return "".join(out) + ERROR
            if len(t) > 1 and t[0] == "0" and t.isdigit() and not set(t) <= set("01234567"):
                return "".join(out) + ERROR
            if t[:2] in ("0x", "0X") and ("." in t and "p" not in t.lower() or len(t) == 2):
                return "".join(out) + ERROR
            out.append("0")
        else:
            out.append("s" if what != "rune" else "0")
    return "".join(out)


BINARY = S.set("+ - * / % & | ^ << >> &^ && || == < > != <= >=")
UNARY = S.set("+ - ! ^ * & <-")
ASSIGN = S.set("= += -= *= /= %= &= |= ^= <<= >>= &^=")
_LISTS = {"block": "stmt", "switchbody": "clause", "selectbody": "comm", "structbody": "field", "ifacebody": "elem", "imports": "import", "consts": "const", "vars": "var", "types": "type"}


def cut(symbols: str, kind: str) -> list[tuple[str, str]]:
    """Statements of a block, members of a body: split at inserted semicolons, where no statement goes on."""
    if kind == "file":
        parts = [p for p in re.split("\n", symbols) if p]
        out, state = [], "package"
        for p in parts:
            if state == "package":
                out.append((p, "package"))
                state = "import"
            elif p[0] == O["import"] and state == "import":
                out.append((p, "imports_decl"))
            else:
                state = "decl"
                out.append((p, "decl"))
        return out or [("", "package")]
    if kind in ("switchbody", "selectbody"):
        parts = [p for p in symbols.split("\n") if p]
        if parts and parts[0][0] not in (O["case"], O["default"]):
            return [("\0", "never")]
        return [(p, _LISTS[kind]) for p in parts]
    if kind in _LISTS:
        return [(p, _LISTS[kind]) for p in symbols.split("\n") if p]
    return [(symbols, kind)]


def parse(symbols: str, kind: str):
    p = _Go(symbols)
    getattr(p, "k_" + kind)()
    while p.eat(";"):
        pass
    if p.c != "\0" or p.i != len(symbols):
        raise Bad
    return tuple(k for _, k in sorted(p.kinds.items()))


class _Go(Cursor):
    # --- groups -------------------------------------------------------------------------------
    def k_never(self):
        raise Bad

    def k_package(self):
        self.need(O["package"])
        self.need("n")
        while self.eat(";"):
            if self.c == O["import"]:
                self.k_imports_decl()
            elif self.c not in "\0;":
                self.k_decl()

    def k_imports_decl(self):
        self.need(O["import"])
        if self.c == "P":
            self.group("P", "imports")
        else:
            self.k_import()

    def k_import(self):
        if self.c in "n.":
            self.i += 1
        self.need("s")
        while self.eat(";"):
            if self.c not in "\0;":
                self.k_import()

    def k_decl(self):
        while True:
            if self.c == O["func"]:
                self.i += 1
                if self.c == "P":
                    self.group("P", "params")
                self.need("n")
                if self.c == "K":
                    self.group("K", "typeparams")
                self.signature()
                if self.c == "B":
                    self.group("B", "block")
            elif not self.declaration():
                raise Bad
            if not self.eat(";"):
                return
            if self.c == "\0":
                return

    def declaration(self) -> bool:
        for word, many, one in ((O["const"], "consts", self.k_const), (O["var"], "vars", self.k_var), (O["type"], "types", self.k_type)):
            if self.c == word:
                self.i += 1
                if self.c == "P":
                    self.group("P", many)
                else:
                    one()
                return True
        return False

    def names(self):
        self.need("n")
        while self.eat(","):
            self.need("n")

    def k_const(self):
        self.names()
        if self.c not in "=\0;":
            self.type()
        if self.eat("="):
            self.exprs()
        if self.c == ";" and self.peek() == "n":
            self.i += 1
            self.k_const()

    def k_var(self):
        self.names()
        if self.eat("="):
            self.exprs()
        else:
            self.type()
            if self.eat("="):
                self.exprs()
        if self.c == ";" and self.peek() == "n":
            self.i += 1
            self.k_var()

    def k_type(self):
        self.need("n")
        if self.c == "K" and self.peek() not in "\0;":
            # type parameters, or an array type
            self.group("K", "params_or_len")
            self.eat("=")
            self.type()
        else:
            self.eat("=")
            self.type()

    # --- types --------------------------------------------------------------------------------
    def signature(self):
        self.group("P", "params")
        if self.c == "P":
            self.group("P", "params")
        elif self.starts_type():
            self.type()

    def starts_type(self) -> bool:
        return self.c in _TYPE_STARTS

    def type(self):
        c = self.c
        if c == "n":
            self.i += 1
            if self.c == "." and self.peek() == "n":
                self.i += 2
            if self.c == "K":
                self.group("K", "typeargs")
        elif c == "*":
            self.i += 1
            self.type()
        elif c == "P":
            self.group("P", "typeparen")
        elif c == "K":
            self.group("K", "len")
            self.type()
        elif c == O["map"]:
            self.i += 1
            self.group("K", "onetype")
            self.type()
        elif c == O["chan"]:
            self.i += 1
            self.eat(O["<-"])
            self.type()
        elif c == O["<-"]:
            self.i += 1
            self.need(O["chan"])
            self.type()
        elif c == O["func"]:
            self.i += 1
            self.signature()
        elif c == O["struct"]:
            self.i += 1
            self.group("B", "structbody")
        elif c == O["interface"]:
            self.i += 1
            self.group("B", "ifacebody")
        else:
            raise Bad

    def k_typeparen(self):
        self.type()

    def k_onetype(self):
        self.type()

    def k_len(self):
        if self.c == "\0":
            return
        if self.c == O["..."]:
            self.i += 1
            return
        self.expr()

    def k_typeargs(self):
        self.type()
        while self.eat(","):
            if self.c == "\0":
                return
            self.type()

    def constraint(self):
        while True:
            self.eat("~")
            self.type()
            if not self.eat("|"):
                return

    def k_typeparams(self):
        while True:
            self.names_then_constraint()
            if self.c == "\0":
                return
            self.need(",")
            if self.c == "\0":
                return

    def names_then_constraint(self):
        self.need("n")
        while self.c == "," and self.peek() == "n" and self.peek(2) in (",", "n", "~", "*", "K", "P", O["interface"], O["func"], O["map"], O["chan"], O["struct"]):
            self.i += 2
        self.constraint()

    def k_params_or_len(self):
        if not self.attempt(lambda: (self.k_typeparams(), self.end())):
            self.k_len()
            self.end()

    def end(self):
        if self.i != len(self.s) - 1:
            raise Bad

    def k_params(self):
        named, bare, last = False, True, ""
        while self.c != "\0":
            if self.c == "n" and (self.peek() in _TYPE_STARTS and self.peek() != "K" or self.peek() == O["..."]):
                self.i += 1
                self.eat(O["..."])
                self.type()
                named, last = True, "named"
            elif self.c == "n" and self.peek() == "K":
                # name and array type, or a generic type
                if self.attempt(lambda: (self.need("n"), self.type(), self.sep())):
                    named, last = True, "named"
                else:
                    self.type()
                    last, bare = "type", False
            elif self.c == "n" and self.peek() in ",\0":
                self.i += 1
                last = "name"
            else:
                self.eat(O["..."])
                self.type()
                last, bare = "type", False
            if self.c == "\0":
                break
            self.need(",")
        if named and (not bare or last != "named"):
            raise Bad

    def sep(self):
        if self.c not in ",\0":
            raise Bad

    def k_field(self):
        while True:
            if self.c == "*" or self.c == "n" and self.peek() in ".s\0;" or self.c == "n" and self.peek() == "K" and self.peek(2) in "s\0;":
                self.eat("*")
                self.type()
            else:
                self.names()
                self.type()
            self.eat("s")
            if not self.eat(";") or self.c == "\0":
                return

    def k_elem(self):
        while True:
            if self.c == "n" and self.peek() == "P":
                self.i += 1
                self.signature()
            else:
                self.constraint()
            if not self.eat(";") or self.c == "\0":
                return

    # --- expressions --------------------------------------------------------------------------
    def exprs(self, lit: bool = True) -> bool:
        """Whether there are several."""
        self.expr(lit)
        many = False
        while self.eat(","):
            self.expr(lit)
            many = True
        return many

    def expr(self, lit: bool = True):
        self.unary(lit)
        while self.c in BINARY:
            self.i += 1
            self.unary(lit)

    def unary(self, lit: bool):
        while self.c in UNARY:
            if self.c == O["<-"] and self.peek() == O["chan"]:
                self.type()
                return self.postfix(lit, True)
            self.i += 1
        c = self.c
        typelike = False
        if c in "0s":
            self.i += 1
        elif c == "n":
            self.i += 1
            typelike = True
        elif c == "P":
            self.group("P", "paren")
        elif c == O["func"]:
            self.i += 1
            self.signature()
            if self.c == "B":
                self.group("B", "block")
        elif c in _TYPE_STARTS:
            self.type()
            typelike = True
            if self.c == "B":
                self.group("B", "values")
                typelike = False
        else:
            raise Bad
        self.postfix(lit, typelike)

    def postfix(self, lit: bool, typelike: bool):
        while True:
            c = self.c
            if c == ".":
                self.i += 1
                if self.c == "P":
                    self.group("P", "assertion")
                    typelike = False
                else:
                    self.need("n")
            elif c == "K":
                self.group("K", "index")
            elif c == "P":
                self.group("P", "args")
                typelike = False
            elif c == "B" and lit and typelike:
                self.group("B", "values")
                typelike = False
            else:
                return

    def k_paren(self):
        self.expr()

    def k_assertion(self):
        if self.eat(O["type"]):
            return
        self.type()

    def k_args(self):
        while self.c != "\0":
            self.expr()
            if self.eat(O["..."]):
                self.eat(",")
                return
            if self.c == "\0":
                return
            self.need(",")

    def k_index(self):
        if self.c == ":":
            parts = 0
        else:
            self.expr()
            if self.c == "," or self.c == "\0":
                while self.eat(","):
                    if self.c != "\0":
                        self.expr()
                return
            parts = 0
        while self.eat(":"):
            parts += 1
            if self.c not in ":\0":
                self.expr()
            elif parts == 2:
                raise Bad
        if parts not in (1, 2):
            raise Bad

    def k_values(self):
        while self.c != "\0":
            self.value()
            if self.eat(":"):
                self.value()
            if self.c == "\0":
                return
            self.need(",")

    def value(self):
        if self.c == "B":
            self.group("B", "values")
        else:
            self.expr()

    # --- statements ---------------------------------------------------------------------------
    def k_stmt(self):
        while True:
            if self.c != ";":
                self.statement()
            if not self.eat(";"):
                return
            if self.c == "\0" or self.c in _CLAUSES:
                return

    def simple(self, lit: bool = True, ranged: bool = False):
        start = self.i
        if ranged and self.eat(O["range"]):
            return self.expr(lit)
        many = self.exprs(lit)
        c = self.c
        if c == O[":="]:
            if self.s[start : self.i].replace("n", "").replace(",", ""):
                raise Bad
            self.i += 1
            if ranged and self.eat(O["range"]):
                return self.expr(lit)
            self.exprs(lit)
        elif c in ASSIGN:
            self.i += 1
            if ranged and c == "=" and self.eat(O["range"]):
                return self.expr(lit)
            self.exprs(lit)
        elif c in (O["++"], O["--"]):
            self.i += 1
        elif c == O["<-"]:
            self.i += 1
            self.expr(lit)
        elif many:
            raise Bad  # a list by itself

    def statement(self):
        c = self.c
        if c == "n" and self.peek() == ":":
            self.i += 2
            if self.c not in "\0;":
                self.statement()
        elif c == "B":
            self.group("B", "block")
        elif c in (O["go"], O["defer"]):
            self.i += 1
            self.expr()
            if self.s[self.i - 1] != "P":
                raise Bad
        elif c == O["return"]:
            self.i += 1
            if self.c not in "\0;":
                self.exprs()
        elif c in (O["break"], O["continue"]):
            self.i += 1
            self.eat("n")
        elif c == O["goto"]:
            self.i += 1
            self.need("n")
        elif c == O["fallthrough"]:
            self.i += 1
        elif c == O["if"]:
            self.if_()
        elif c == O["for"]:
            self.i += 1
            self.for_()
        elif c == O["switch"]:
            self.i += 1
            if self.c != "B":
                if self.c != ";":
                    self.simple(False)
                if self.eat(";") and self.c != "B":
                    self.simple(False)
            self.group("B", "switchbody")
        elif c == O["select"]:
            self.i += 1
            self.group("B", "selectbody")
        elif c in (O["const"], O["var"], O["type"]):
            self.declaration()
        else:
            self.simple()

    def if_(self):
        self.need(O["if"])
        if self.c == ";":
            self.i += 1
            self.expr(False)
        else:
            self.simple(False)
            if self.eat(";"):
                self.expr(False)
        self.group("B", "block")
        if self.eat(O["else"]):
            if self.c == O["if"]:
                self.if_()
            else:
                self.group("B", "block")

    def for_(self):
        if self.c != "B":
            if self.c != ";":
                self.simple(False, True)
            if self.eat(";"):
                if self.c != ";":
                    self.expr(False)
                self.need(";")
                if self.c != "B":
                    self.simple(False)
        self.group("B", "block")

    def k_clause(self):
        while self.c in (O["case"], O["default"]):
            if self.eat(O["default"]):
                self.need(":")
            else:
                self.i += 1
                self.exprs()
                self.need(":")
        if self.c != "\0":
            self.k_stmt()
            if self.c in _CLAUSES:
                self.k_clause()

    def k_comm(self):
        while self.c in (O["case"], O["default"]):
            if self.eat(O["default"]):
                self.need(":")
            else:
                self.i += 1
                self.simple()
                self.need(":")
        if self.c != "\0":
            self.k_stmt()
            if self.c in _CLAUSES:
                self.k_comm()


_CLAUSES = S.set("case default")
_TYPE_STARTS = frozenset("n*PK") | S.set("map chan <- func struct interface")

