import pytest

from plumbline.extract import extractor_for, keep_refs, register, Facts

PY = '''import os, a.b as c
from .m import x, y as z
LIMIT = compute(3)
name = other()
# Above.
@deco(1)
class Engine(Base, mixin.M):
    """Runs."""
    def run(self, n: int = size()) -> int:
        return self._go(n).then_do(x)
    async def _go(self): pass
'''
TS = '''import { pad as p, slug } from "./util";
import * as ns from "../x";
export interface Options { name: string; send(x: string): void; }
export type Mode = "a" | "b";
enum Color { Red, Green }
/** Base transport. */
export abstract class Transport<T> extends Base.Deep implements Options {
  /** Sends { not a brace. */
  async send(x: string): Promise<void> {
    const y = slug(p(x)).trim().replace("}", /b[(/]{/g);
    return new Http.Client(`${y({})} }`);
  }
}
export const makeClient = async (u: string): Promise<void> => { ns.post<string>(u); };
'''
GO = '''package store

import (
	"strings"
	alias "example.com/x/yy"
)

// Store holds things.
type Store struct {
	*Base
	items map[string]*Record
}

// Put adds } things.
func (s *Store) Put(key string) *Record {
	r := &Record{Key: strings.ToLower("}" + key)}
	return alias.List(r)
}
'''


def shape(f):
    return {(d.local, d.kind, d.start_line, d.end_line) for d in f.symbols}


def test_python():
    f = extractor_for("python")("p.py", PY)
    assert shape(f) == {("LIMIT", "const", 3, 3), ("Engine", "class", 7, 11), ("Engine.run", "method", 9, 10), ("Engine._go", "method", 11, 11)}
    assert {(s, d, k) for s, d, k, _ in f.refs} == {
        ("LIMIT", "compute", "calls"), (None, "other", "calls"), (None, "deco", "calls"), ("Engine", "Base", "inherits"), ("Engine", "mixin.M", "inherits"),
        ("Engine.run", "size", "calls"), ("Engine.run", "self._go", "calls"), ("Engine.run", "self._go(n).then_do", "calls"),
    }
    assert [i[1:4] for i in f.imports] == [("os", None, "os"), ("a.b", None, "c"), (".m", "x", "x"), (".m", "y", "z")]
    by = {d.local: d for d in f.symbols}
    assert by["Engine"].docstring == "Runs." and by["Engine"].signature == "class Engine(Base, mixin.M)" and not by["Engine._go"].exported


def test_typescript():
    f = extractor_for("typescript")("t.ts", TS)
    assert shape(f) == {
        ("Options", "interface", 3, 3), ("Options.send", "method", 3, 3), ("Mode", "type", 4, 4), ("Color", "enum", 5, 5), ("Transport", "class", 7, 13), ("Transport.send", "method", 9, 12), ("makeClient", "function", 14, 14),
    }
    assert {(s, d, k) for s, d, k, _ in f.refs} >= {
        ("Transport", "Base.Deep", "inherits"), ("Transport", "Options", "inherits"), ("Transport.send", "slug", "calls"), ("Transport.send", "slug(p(x)).trim().replace", "calls"), ("Transport.send", "Http.Client", "instantiates"), ("makeClient", "ns.post", "calls"),
    }
    assert [i[1:4] for i in f.imports] == [("./util", "pad", "p"), ("./util", "slug", None), ("../x", None, "ns")]
    assert {d.local: d.docstring for d in f.symbols}["Transport.send"] == "Sends { not a brace."


def test_go():
    f = extractor_for("go")("s.go", GO)
    assert shape(f) == {("Store", "struct", 9, 12), ("Put", "method", 15, 18)}
    assert {(s, d, k) for s, d, k, _ in f.refs} == {("Store", "Base", "inherits"), ("Put", "Record", "instantiates"), ("Put", "strings.ToLower", "calls"), ("Put", "alias.List", "calls")}
    assert [i[1:4] for i in f.imports] == [("strings", None, "strings"), ("example.com/x/yy", None, "alias")]


@pytest.mark.parametrize("lang", ["javascript", "typescript", "tsx", "go"])
@pytest.mark.parametrize("text", ["", "}}}{{{", "function (", "class X extends {", "`${", "'", "/*", "const x = (", "func", "type T struct {", "import"])
def test_broken_texts_do_not_fail(lang, text):
    extractor_for(lang)("x", text)


def test_broken_python_keeps_what_is_whole():
    text = "import os.path as p\nfrom a.b import (c, d as e)\n\n\nclass K(Base, metaclass=M):\n    def g(self):\n        return e.run(c(1))\n\n\ndef f(:\n    x = = 1\n\n\ndef h():\n    K()\n"
    f = extractor_for("python")("x.py", text)
    assert {(s.local, s.kind) for s in f.symbols} >= {("K", "class"), ("K.g", "method"), ("h", "function")}
    assert {r[:3] for r in f.refs} >= {("K.g", "e.run", "calls"), ("K.g", "c", "calls"), ("h", "K", "calls"), ("K", "Base", "inherits")}
    assert {i[1:4] for i in f.imports} == {("os.path", None, "p"), ("a.b", "c", "c"), ("a.b", "d", "e")}
    assert extractor_for("python")("x.py", "def f(:").symbols == []


def test_refs_are_distinct_and_without_noise():
    assert keep_refs([("f", "a.b", "calls", 1), ("f", "a.b", "calls", 1), ("f", "x.len", "calls", 2), ("f", "(g)", "calls", 3), ("f", "h <T>", "calls", 4)]) == [("f", "a.b", "calls", 1), ("f", "g", "calls", 3), ("f", "h", "calls", 4)]


def test_a_language_can_be_added():
    register("nothing", lambda path, text: Facts())
    assert extractor_for("nothing")("x", "y").symbols == []


def test_limits_hold_for_the_index_only():
    from plumbline.extract import indexed

    args = ", ".join(f"a{i} int" for i in range(80))
    d = extractor_for("go")("x.go", "\n".join(f"// Line {i}." for i in range(30)) + f"\nfunc Put({args}) {{}}\n").symbols[0]
    assert d.docstring.count("\n") == 29 and d.signature == f"func Put({args})"
    x = indexed(d)
    assert x.docstring == "\n".join(f"Line {i}." for i in range(18, 30)) and 200 < len(x.signature) <= 220
    long = indexed(extractor_for("python")("x.py", f'def f():\n    """{"word " * 300}"""\n').symbols[0])
    assert len(long.docstring) <= 500 and long.docstring.endswith("…")
