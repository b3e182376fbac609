"""Lexers, token-pair grammars and statement productions of the languages.

A lexer turns a text into a flat string with one character for each token class; brackets stay in it, nothing is
nested yet.  Nesting is reduced outside, by windows over the bracket tokens, which gives the symbol string of
every bracket group with one symbol (its opening) for each group in it.  A production is the symbol string of a group,
or of one statement of it; equal strings need to be validated once only, and a valid one tells what each nested
group has to be.
"""

from __future__ import annotations

#: The class of what a lexer can't read; no grammar permits it next to anything.
ERROR = "\x01"
#: The classes before the first and after the last token of a text.
START, END = "\x02", "\x03"
#: Closing brackets; what opens is a letter of the language's ``OPENS``, which also stands for the group in its parent.
CLOSES = ")]}D"


class Bad(Exception):
    """The production isn't valid."""


class Symbols:
    """One character for each keyword and operator of a language."""

    def __init__(self, words: str, operators: str, base: int):
        self.of: dict[str, str] = {}
        self.text: dict[str, str] = {}
        for k, w in enumerate([*words.split(), *operators.split()]):
            ch = w if len(w) == 1 and not w.isalnum() else chr(base + k)
            self.of[w] = ch
            self.text[ch] = w
        self.words = {w: self.of[w] for w in words.split()}

    def set(self, names: str) -> frozenset[str]:
        return frozenset(self.of[x] for x in names.split())


class Cursor:
    """Reads one symbol string; ``kinds`` says what the nested groups have to be, by place."""

    def __init__(self, s: str):
        self.s = s + "\0"
        self.i = 0
        self.kinds: dict[int, str] = {}

    @property
    def c(self) -> str:
        return self.s[self.i]

    def peek(self, k: int = 1) -> str:
        j = self.i + k
        return self.s[j] if j < len(self.s) else "\0"

    def eat(self, ch: str) -> bool:
        if self.s[self.i] == ch:
            self.i += 1
            return True
        return False

    def need(self, ch: str) -> None:
        if self.s[self.i] != ch:
            raise Bad
        self.i += 1

    def group(self, ch: str, kind: str) -> None:
        if self.s[self.i] != ch:
            raise Bad
        self.kinds[self.i] = kind
        self.i += 1

    def attempt(self, f, *a) -> bool:
        """Run ``f``; on failure go back as if nothing had been read."""
        i, kinds = self.i, dict(self.kinds)
        try:
            f(*a)
            return True
        except Bad:
            self.i, self.kinds = i, kinds
            return False


#: Productions remembered by each worker; beyond it the memory starts anew (results are the same).
REMEMBERED = 400_000


def validate(groups: list[tuple[int, str]], parse, cut, memory: dict) -> bool:
    """Whether all bracket groups of a text are valid, given as (depth, symbols) in the order of their openings.

    The first is the text itself, of kind ``file``.  ``cut(symbols, kind)`` splits symbols into (symbols, kind)
    productions; ``parse(symbols, kind)`` returns the kinds of the production's groups in order, or raises Bad.
    In the order of the openings the groups of a group follow it at once, so one queue for each depth suffices.
    """
    queues: list[list[str]] = [["file"]]
    for depth, symbols in groups:
        kind = queues[depth].pop()
        wanted: list[str] = []
        for part, part_kind in cut(symbols, kind):
            key = (part_kind, part)
            if key in memory:
                kinds = memory[key]
            else:
                if len(memory) > REMEMBERED:
                    memory.clear()
                try:
                    kinds = parse(part, part_kind)
                except Bad:
                    kinds = None
                except RecursionError:
                    return True  # deeper than can be told, in any language
                memory[key] = kinds
            if kinds is None:
                return False
            wanted += kinds
        wanted.reverse()
        if depth + 1 == len(queues):
            queues.append(wanted)
        else:
            queues[depth + 1] = wanted
    return True
