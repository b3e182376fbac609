import pytest

from plumbline.llm.docpairs import code_pairs, documented_symbols, informative_ids, is_informative, lexed_pairs, strip_comment

SAYS = [
    "Never returns null.", "Rounds half to even.", "O(n log n) in rows.", "Not reentrant!", "Idempotent; a second close is safe.", "/** Thread-safe. */", "# Blocks until the lock frees.", "// Leaves the cursor untouched.",
    "Der Lauf sortiert danach die Zeilen.", "读取并返回缓存。", "TODO: drop this some day.\nRaises on empty input.", "@returns the row, or nothing once it is closed", "See how locks work in the shared module, where 12 rows share one cell.",
    "Please flush it first, as readers poll it 19 times a day.", ":param x: bytes to skip before the footer", "Constructor; keeps the lock until the first read.", "Der Aufruf blockiert, bis die Sperre frei ist.", "Ne renvoie jamais null.", "Devuelve nulo si la fila falta.", "Later rows win.", "The string is never empty.",
    "Deprecated. Use the pool.", '"""Sizes are in pages.\n\n@param parse_row\n"""',
]
EMPTY = [
    None, "", " \n ", "/** */", "-----", "?", "...", "TODO", "TODO: document this", "FIXME", "xxx", "tbd", "N/A", "none", "Parse the row.", "parseRow", "parse row", "Parses a row", "@param row\n@returns", ":param row:\n:return:", "@param row the row\n@returns the result",
    "To come.", "Doc string missing", "Noch offen.", "Voir le manuel.", "Constructor.", "This is where the magic happens.", "Coming soon", "More to come.", "Getter for row.", "Siehe das Handbuch.", "Does its thing.", "Pending.",
    "Description.", "description goes here", "Add a description here please", "Missing documentation.", "Beschreibung folgt", "Hier fehlt noch ein Text.", "por hacer", "待补充", "See base class.", "@see other_thing", "{@inheritDoc}", "Inherited.",
    "@author Jane Doe", "2023-06-19 initial version", "Copyright the row authors. All rights reserved.", "noqa: D401", "pylint: disable=too-many-arguments", "eslint-disable-next-line no-unused-vars", "type: ignore", "go:noinline", "vim: set ts=4 sw=4 et:", "-*- coding: utf-8 -*-",
    "if row > 30: store(row)", "return 926", "tracer.emit(row, 9)\nreturn 4", "------ row helpers ------", "#region helpers", "Auto-generated method stub", "Performs the operation and returns the result.", "This function will parse row.", "Docstring for parseRow.",
    "This one does just what its name says, so there is nothing more to be said about it here.", "Will be documented once the interface has settled; until then please have a look at the tests.", "Blah blah blah, some words to be put here by whoever comes next, blah blah.",
]


@pytest.mark.parametrize("doc", SAYS)
def test_says_something(doc):
    assert is_informative(doc, "parse_row", "def parse_row(row, cursor: str) -> int")


@pytest.mark.parametrize("doc", EMPTY)
def test_says_nothing(doc):
    assert not is_informative(doc, "parseRow", "parseRow(row: string): number")


def test_comment_syntax():
    assert strip_comment("/**\n * A.\n */") == ["", "A.", ""] and strip_comment("// x\r\n// y") == ["x", "y"]


def test_operators(spark):
    rows = [
        (1, 10, "function", "f", "f()", "Never null.", 2, 3), (1, 10, "function", "f", "f()", "Never null.", 2, 3), (2, 10, "class", "C", "C", "Never null.", 1, 1), (3, 10, "method", "m", None, "Never null.", 1, 1),
        (4, 10, "method", "m", "m()", "TODO", 1, 1), (5, 11, "method", "m", "m()", "Fails late.", 1, 1), (6, 10, "method", "m", "m()", "Fails late.", 9, 12), (7, 10, None, "m", "m()", "Fails late.", 1, 1), (None, 10, "function", "f", "f()", "Never null.", 1, 1),
        (8, None, "function", "f", "f()", "Never null.", None, None),
    ]
    s = spark.createDataFrame(rows, "id long, file_id long, kind string, name string, signature string, docstring string, start_line int, end_line int").selectExpr("*", "'go' AS lang", "1 AS symbol_id")
    d = spark.createDataFrame([(10, "a\nb\r\nc\n"), (11, None), (None, "x")], "file_id long, text string")
    assert {r[0] for r in informative_ids(s).collect()} == {1, 5, 6, 8}
    assert documented_symbols(s).count() == 4
    assert [(r["symbol_id"], r["code"]) for r in code_pairs(s, d).collect()] == [(1, "b\nc")]
    assert informative_ids(s.limit(0)).count() == 0


def test_lexed(spark):
    go = "package p\n\n// Put never blocks.\nfunc Put(k string) string { return k }\n\n// TODO\nfunc Get() {}\n"
    d = spark.createDataFrame([(1, "go", go), (2, "python", "def f(:"), (3, "en", "prose"), (4, None, "x"), (5, "python", 'def g():\n    """Fails late."""\n')], "file_id long, lang string, text string")
    assert {(r["file_id"], r["name"], r["code"].count("\n")) for r in lexed_pairs(d).collect()} == {(1, "Put", 0), (5, "g", 1)}


BROKEN = '''class Store:
    def put(self, key):  # a { in a comment
        """Never blocks.

        def inner(): of the text
        """
        return {"a": "}", 'b': key

    @cached(1)
    async def get(self,
                  key="(") -> dict[str, int]:
        \'\'\'Fails late.\'\'\'
        x = "not closed
        if key
            return x
<<<<<<< HEAD
        return None

# Counts every waiter.
def size(n): return n

def lost(:
    """Never found."""

def tail(n):
    """Keeps the newest row."""
    print n
'''


def test_lexed_keeps_the_functions_of_broken_python(spark):
    unclosed = 'def a():\n    """Never blocks.\n    return 1\n\ndef b():\n    """Fails late."""\n    return 2\n'
    cut = 'def a():\r\n    """Never blocks."""\r\n    return 1\r\n\r\ndef b(x):\r\n    """Fails late."""\r\n    return (x,'
    d = spark.createDataFrame([(1, "python", BROKEN), (2, "python", unclosed), (3, "python", cut)], "file_id long, lang string, text string")
    got = {(r["file_id"], r["local"], r["kind"], r["start_line"], r["end_line"], r["signature"], r["docstring"].split("\n")[0]) for r in lexed_pairs(d).collect()}
    assert got == {
        (1, "Store.put", "method", 2, 7, "def put(self, key)", "Never blocks."), (1, "Store.get", "method", 10, 17, 'async def get(self, key="(") -> dict[str, int]', "Fails late."),
        (1, "size", "function", 20, 20, "def size(n)", "Counts every waiter."), (1, "tail", "function", 25, 27, "def tail(n)", "Keeps the newest row."),
        (2, "b", "function", 5, 7, "def b()", "Fails late."), (3, "a", "function", 1, 3, "def a()", "Never blocks."), (3, "b", "function", 5, 7, "def b(x)", "Fails late."),
    }


def test_lexed_takes_the_whole_comment_and_signature(spark):
    above = lambda sign: "\n".join([f"{sign} Never blocks."] + [f"{sign} TODO"] * 29)
    args = ", ".join(f"argument_{i} int" for i in range(30))
    texts = [
        ("go", f"package p\n\n{above('//')}\nfunc Put({args}) int {{ return 1 }}\n"), ("typescript", f"{above('//')}\nfunction put() {{ return 1 }}\n"), ("python", f"{above('#')}\ndef put():\n    return 1\n"),
        ("python", f"{above('#')}\ndef put():\n    return (\n"), ("python", 'def put():\n    """' + "TODO\n\n    " * 100 + 'Never blocks."""\n'), ("go", "/* " + "TODO\n\n" * 100 + "Never blocks. */\nfunc Put() {}\n"),
    ]
    got = {r["file_id"]: r for r in lexed_pairs(spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "file_id long, lang string, text string")).collect()}
    assert {i: len(r["docstring"].split("\n")) for i, r in got.items()} == {0: 30, 1: 30, 2: 30, 3: 30, 4: 201, 5: 201}
    assert all("Never blocks." in r["docstring"] for r in got.values()) and got[0]["signature"] == f"func Put({args}) int"
