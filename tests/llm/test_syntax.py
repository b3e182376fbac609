import ast
import inspect
import random
import re
import textwrap
import warnings

import pytest

from plumbline.llm.grammar import CLOSES, END, ERROR, START, golang, pairs, pylang, script
from plumbline.llm.syntax import LANGUAGES, OPENS, bracket_groups, impossible_pairs, invalid_files, invalid_rates, lex, lexed_files, productions_hold

GO_OK = [
    "package p", "package p\nimport \"fmt\"\nimport (\n\ta \"b\"\n\t. \"c\"\n)\n", "package p\nvar x, y int = 1, 2\nconst (\n\tA = iota\n\tB\n)\ntype T = map[string][]*chan<- int\n",
    "package p\nfunc (t *T[K]) F(a, b int, c ...string) (n int, err error) {\n\tif x := f(); x > 0 {\n\t\treturn\n\t} else if y {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t\tcontinue\n\t}\n\tfor range 10 {\n\t}\n\tfor k, v := range m {\n\t\t_ = v[k:]\n\t}\n\tswitch z := q.(type) {\n\tcase int, *T:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\tcase ch <- 1:\n\t}\n\tgo func() { defer g() }()\n\tx.y[0], a = &T{A: 1, B: []int{1, 2}}, 'x'\nL:\n\tgoto L\n}\n",
    "package p\nfunc Map[T any, U ~int | string](xs []T, f func(T) U) []U { return nil }\ntype S struct {\n\t*E\n\tp.Q\n\ta, b int `json:\"x\"`\n}\ntype I interface {\n\tM(int) error\n\t~int | ~string\n}\n",
    "package p\nfunc f() {\n\tswitch x { case 1: f(); default: }\n\tselect { case a := <-b: g(); default: }\n\tswitch x { case 1, 2: f(); g(); case 3: h() }\n}\n", "package p; func f() { x := `raw\n\"}`; if v, ok := m[\"a\"]; ok && v == (T{1}) { return } }",
]
GO_BAD = ["package p\nfunc f() { a, b }", "", "\n", "x := 1", "package p\nfunc f() {", "package p\nfunc f() { a b }", "package p\nfunc f( {}", "package p\nx = 1", "package p\nfunc f() { if x \n{ } }", "package p\nfunc f() { f(1\n) }", "package p\nfunc f() { x := 08 }", "package p\nfunc f() { return \"a }", "package p\nfunc f() {}\nimport \"x\"", "package p\nfunc f() {\n<<<<<<< HEAD\n}", "package p\nfunc f(a int, b) {}", "package p\nfunc f() { else {} }", "package p\nvar s = “x”"]
JS_OK = [
    "if (a) /re/.test(b);", "while (x) /re/g.exec(y);", "if (a) { }\n/re/.test(b);", "function f(){}\n/re/.test(b);", "x = f(a) / b / c; y = {a} / 2; z = a[0] / b", "({a = 1, b: {c = 2}} = x); [{d = 1}] = y; for ({e = 1} of z); for ([f, g] of h);", "const p = ({a = 1}) => a;", "const q = <A b={<C/>} d='e'>{f}<g.h/>{...i}</A>;",
    "", " \n", "import a, {b as c, default as d} from 'x'\nexport * as q from 'y'; export default class {}", "const {a, b: [c = 1, ...d], ...e} = f, g = (x, {y}) => x / y / 2;", "if (a) b; else c\nfor (const x of y) for (let i = 0, n = 3; i < n; i++) {}\nfor await (const z of q) ;\ndo x++; while (x < 3)",
    "class A extends B.C(d) { #p = 1; static { this.#p; } static async *gen() { yield* x; } get y() { return 1 } set y(v) {} 'k'() {} [c] = 2 }", "x = a ? b : c ? d : e; a ??= b?.[c]?.(d) ?? `t${`n${1}`}`;", "const r = /[/}]{2}/g.test(s), q = a / b / c; label: for (;;) { break label }",
    "async function f() { await g(); return async x => await x } try { } catch { } finally { }", "const el = <div className=\"a\" {...p}>text {x ? <b/> : null} <></> {/* c */}</div>;", "switch (x) { case 1: y(); break; default: }\nvar get = 1, set = 2, of = 3, async = 4; get\nset", "let x = {a, b() {}, get c() { return 1 }, async *d() {}, [e]: f, 'g': 1, ...h}; new.target; import('x'); import.meta.url; 1_000n; 0xFF",
]
JS_BAD = ["({a=1})", "x = /(/", "x = /a**/", "for await (x in y) ;", "const x = ;", "if (a {", "function (", "a b", "let x = 1 2", "f() = 3", "const a;", "x = {a: 1 b: 2}", "<div></span>", "<div>{}}</div>", "return )", "'abc", "`${", "/abc", "a ? b", "class { x() {} ", "import {a from 'x'", "for (x of) {}", "const s = “x”;", "else {}", "x = 08", "{ \"a\": 1, \"b\": 2 }", "interface A {}", "let x: number = 1;", "enum A {}", "catch (e) {}", "=======\n"]
TS_OK = [
    "let x: number | string[] = 1, y!: Map<string, Array<number>>;", "interface A<T extends B = C> extends D<T>, E { readonly a?: string; [k: string]: any; m<T>(x: T): void; new (x: number): A; get v(): string }", "type F = (a: number, ...b: string[]) => void; type M = { [K in keyof T]?: T[K] }; type C = A extends infer U ? U[] : never; type T = [a: string, b?: number, ...c: X[]];",
    "abstract class A<T> implements B, C<T> { private readonly x = 1; constructor(private a: string, public b?: number) { super(); } abstract m(): void; static s?: T; declare z: number; override f<U>(this: A<U>, x: U): x is string { return true } }", "enum E { A = 1, B = 'x' } const enum F { A } declare module 'm' { export const x: number; } namespace N.M { export type Q = 1 }",
    "function f(x: string): void; function f(x: any) { return x as unknown as Foo<Bar<Baz>>; }", "const g = <T,>(x: T): T => x, h = async <T>(a: T): Promise<void> => {}; f<string>(x); new Map<string, Set<number>>(); a! + b!.c; x satisfies Y; a >= b; a >> b; a >>>= 2;", "import type { A } from 'x'; import { type B, C } from 'y'; export type { D }; import q = require('z'); export = q;", "const o = c ? (a) : b;", "let v = <any>x; let u: typeof import('x'); function assertIs(x: unknown): asserts x is string {} @dec() class Z { @inp() a: string; }",
]
TSX_OK = ["const a = <A<B> x={1}>t</A>;", "const g = <T,>(x: T): T => x; const h = <b c='d'/>;"]
TS_BAD = ["let x: = 1;", "interface A { a: }", "type X = ;", "class A { m(: void {} }", "enum { A }", "let x: Array<string = 1;", "const y = <div>text</div>;", "function f(a: number b: string) {}", "interface { }"]
PY_OK = ["if a:\n\tb\n\tc\n", "x = f'''{\na}'''\n", "f'{a=}{b!r:>{w}.{p}}{{}}{c:%H:%M}'\n", "ä = x\U000e0100 = 1\n", "match = case = type = _ = 1\nmatch(x)\ntype(x)\nprint(match, case)\n", "match x, *y:\n  case {'a': 1, **k} | C(a, b=2) | -1 + 2j | None: pass\n  case (1 | 2) as z, *_: pass\n", "with (a as b, c): pass\nwith (a, b) as c: pass\nwith (a): pass\n", "def f(a, /, b=1, *c: *d, e, **g) -> h: pass\nclass C[T: int = str, *U, **V](B, m=1): pass\n", "(a) = b\n(a, [b, *c]), d.e = f\n(a): int = 1\n(a) += 1\ndel (a, b), c[0]\n", "x = a if b else lambda *c, d=1: (yield)\n", "1if a else 2\n", "f(x for x in y)\nf(*a, b=1, *c, **d)\n", "x[a:b:c, ::, *d, e:=1]\n", "try: a\nexcept: b\n", "if a: b\nelse: c\n", "", "\n# c\n", "x: int = 1\nmatch x:\n    case [1, *r] if r: pass\n    case _: pass\n", "type A[T] = list[T]\nasync def f(a, /, b, *, c=1, **k) -> int:\n    async with a as b, c: yield\n    return [x async for x in y if (z := x)]\n", "try:\n    a\nexcept* E as e:\n    b\nelse:\n    c\nfinally:\n    d\n", "@d\nclass C(B, k=1): x = 1; y = 2\n", "f = f'{a!r:>{w}} {\"x\"}'\nz = x if y else lambda *a: 0\nprint(*a, **b)\nfor i in 1, 2:\n  pass\nelse:\n  pass\n", "if a:\n    b\n\n    # c\n  # odd comment\nelif d: e\nelse:\n    f\n", "x = (1 +\n2)\ny = 'a' \\\n  'b'\n"]
PY_BAD = ["f'{}'", "f'{a'", "f'{a!}'", "f(a=1, b)", "f(x for x in y, 1)", "def f(a=1, b): pass", "def f(*): pass", "def f(a, /, b, /): pass", "(a for b in c) = 1", "a + 1 += 2", "del f()", "with a as f(): pass", "for f() in x: pass", "'a' b'c'", "a = *", "(*a)", "@d\nx = 1\n", "match x:\n  y = 1\n", "if a:\n\tb\n        c\n", "try: a\nexcept b: c\nexcept* d: e\n", "not in x", "a = not", "lambda x=1, y: 0", "import a.b as c.d", "from . import (a", "from x import a,", "{**a for a in b}", "{a: b, c}", "x = yield = 1", "async x = 1", "def f(:\n  pass", "if a:\nb", "  x = 1", "x = (1", "x = 'a", "f() = 1", "else:\n  x", "try:\n  x\n", "x y", "88px", "a = “b”", "if a\n  b", "class C:\n", "def f():\n    a\n  b\n", "x = 08", "<<<<<<< HEAD\n", "import", "return = 1", "for x in:\n  y", "x = '\\x1'"]


def flat(text, lang):
    return START + lex(text, lang) + END


def groups_of(tokens):
    """(depth, symbols) of the bracket groups, by a stack; None if they don't nest."""
    groups, stack = [(0, [])], [(0, "")]
    for c in tokens:
        if c in OPENS:
            groups[stack[-1][0]][1].append(c)
            groups.append((len(stack), []))
            stack.append((len(groups) - 1, OPENS[c]))
        elif c in CLOSES:
            if stack[-1][1] != c:
                return None
            stack.pop()
        else:
            groups[stack[-1][0]][1].append(c)
    return [(d, "".join(x)) for d, x in groups] if len(stack) == 1 else None


def impossible(text, lang):
    t = flat(text, lang)
    return [p for p in zip(t, t[1:]) if p not in pairs.permitted(lang)]


def valid(text, lang):
    groups = groups_of(lex(text, lang))
    return not impossible(text, lang) and groups is not None and productions_hold(groups, lang, {})


@pytest.mark.parametrize("text", GO_OK)
def test_go_valid(text):
    assert valid(text, "go")


@pytest.mark.parametrize("text", GO_BAD)
def test_go_invalid(text):
    assert not valid(text, "go")


@pytest.mark.parametrize("text", JS_OK)
def test_script_valid(text):
    assert valid(text, "javascript")


@pytest.mark.parametrize("text", JS_BAD)
def test_script_invalid(text):
    assert not valid(text, "javascript")


@pytest.mark.parametrize("text", TS_OK)
def test_typed_valid(text):
    assert valid(text, "typescript")


@pytest.mark.parametrize("text", TSX_OK)
def test_typed_elements_valid(text):
    assert valid(text, "tsx")


@pytest.mark.parametrize("text", TS_BAD)
def test_typed_invalid(text):
    assert not valid(text, "typescript")


def parses(text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except SyntaxError:
        return False


@pytest.mark.parametrize("text", PY_OK + PY_BAD)
def test_python_agrees_with_the_parser(text):
    assert parses(text) == (text in PY_OK) == valid(text, "python")


def test_python_agrees_with_the_parser_on_damaged_code():
    source = "".join(inspect.getsource(m) for m in (ast, inspect, random, textwrap, pylang, script))
    lines, words = source.split("\n"), re.findall(r"\w+|[^\w\s]", source)
    dice = random.Random(7)
    seen = {True: 0, False: 0}
    for _ in range(3000):
        at = dice.randrange(len(lines))
        parts = re.findall(r"\s+|\w+|[^\w\s]", textwrap.dedent("\n".join(lines[at : at + dice.randrange(1, 7)]))) or ["\n"]
        for _ in range(dice.randrange(3)):
            k = dice.randrange(len(parts))
            parts[k : k + dice.randrange(2)] = [dice.choice(words)] if dice.random() < 0.5 else []
            parts = parts or ["\n"]
        text = "".join(parts)
        seen[parses(text)] += 1
        assert parses(text) == valid(text, "python"), text
    assert min(seen.values()) > 500


def test_the_pair_grammars_decide():
    for text, lang in (("a b", "javascript"), ("x = ;", "python"), ("package p\nvar x = * / 2", "go"), ("let x: = 1;", "typescript"), ("x = 08", "python"), ("print 'a'", "python"), ("const s = “x”;", "tsx"), ("", "go")):
        assert impossible(text, lang)
    for lang in LANGUAGES:
        assert not any(ERROR in p for p in pairs.permitted(lang)) and 500 < len(pairs.permitted(lang)) < 20_000


def test_windows_give_the_groups_of_a_stack(spark):
    texts = [("go", t) for t in GO_OK + GO_BAD] + [("javascript", t) for t in JS_OK + JS_BAD] + [("typescript", t) for t in TS_OK + TS_BAD] + [("python", t) for t in PY_OK + PY_BAD]
    d = spark.createDataFrame([(k, x, t) for k, (x, t) in enumerate(texts)], "file_id long, lang string, text string")
    lexed = lexed_files(d)
    got = {}
    for r in bracket_groups(lexed).orderBy("file_id", "at").collect():
        got.setdefault(r["file_id"], []).append(r)
    wrong = {r["file_id"] for r in impossible_pairs(lexed).collect()}
    for k, (lang, text) in enumerate(texts):
        groups = groups_of(lex(text, lang))
        assert all(r["fits"] for r in got[k]) == (groups is not None)
        if groups is not None:
            assert [(r["depth"], r["symbols"][1:] if i == 0 else r["symbols"]) for i, r in enumerate(got[k])] == groups
        assert (k in wrong) == bool(impossible(text, lang))
    assert {r[0] for r in invalid_files(d).collect()} == {k for k, (lang, text) in enumerate(texts) if not valid(text, lang)}


def test_deep_nesting_is_told_alike():
    for lang, text in (("python", "x = " + "(" * 3000 + ")" * 3000), ("javascript", "x = " + "(" * 3000 + "1" + ")" * 3000), ("go", "package p\nvar x = " + "(" * 3000 + "1" + ")" * 3000), ("javascript", "x = " + "!" * 90_000 + "1"), ("go", "package p\nvar x = " + "!" * 90_000 + "1")):
        assert valid(text, lang)


def test_operator(spark):
    rows = [(1, "go", "package p\n"), (2, "go", ""), (3, "python", "x = ("), (4, "tsx", "const a = <b>c</b>;"), (5, "typescript", "const a = <b>c</b>;"), (6, "en", "x = ("), (7, None, "("), (None, "go", "("), (8, "python", None), (9, "javascript", ""), (3, "python", "x = ("), (10, "python", "(" * 300)]
    d = spark.createDataFrame(rows, "file_id long, lang string, text string").selectExpr("*", "1 AS pair", "2 AS state")
    assert {r[0] for r in invalid_files(d).collect()} == {2, 3, 5, 10}
    f = spark.createDataFrame([(1, "r/a.go"), (2, "r/b.go"), (3, None), (5, "q/c.ts")], "id long, path string").selectExpr("id", "path", "'s' AS sha256", "cast(null as timestamp_ntz) AS indexed_at")
    assert {(r["repo"], r["lang"], r["n_files"], r["n_invalid"]) for r in invalid_rates(f, d).collect()} == {("r", "go", 2, 1), (None, "python", 1, 1), ("q", "typescript", 1, 1)}
    assert invalid_files(d.limit(0)).count() == 0
    assert set(LANGUAGES) == {"python", "javascript", "typescript", "tsx", "go"}
