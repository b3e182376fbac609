import json
import io
import os

import pytest

from plumbline import cli, render
from plumbline.plans.index import Snapshots, build
from plumbline.serve import answer, resources, serve, tools
from plumbline.service import Engine
from plumbline.sources.tree import discover, indexable
from plumbline.streaming.follow import follow

FILES = {
    "src/app/core.py": 'from app.helpers import norm\n\n\nclass Base:\n    pass\n\n\nclass Engine(Base):\n    """Runs the thing."""\n\n    def run(self, x):\n        return self._prep(norm(x))\n\n    def _prep(self, x):\n        return x\n\n\ndef create():\n    return Engine()\n',
    "src/app/helpers.py": "WIDTH = 3\n\n\ndef norm(x):\n    return x\n",
    "src/app/test_core.py": "from app.core import create\n\n\ndef test_it():\n    create()\n",
    "src/ring/a.py": "from ring import b\n\n\ndef f():\n    return b.g()\n",
    "src/ring/b.py": "from ring import a\n\n\ndef g():\n    return a.f()\n",
    "svc/store.go": 'package svc\n\nimport "strings"\n\ntype Store struct{}\n\nfunc (s *Store) Put(k string) string { return Clean(k) }\n\nfunc Clean(k string) string { return strings.Trim(k, " ") }\n',
    "web/node_modules/x.js": "function no() {}\n",
    "web/app.min.js": "function no() {}\n",
    "bad.py": "def broken(:\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


@pytest.fixture(scope="module")
def indexed(spark, tree, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    return folder, build(spark, discover(spark, str(tree)), folder, rounds=3)


@pytest.fixture(scope="module")
def engine(spark, indexed, tree):
    return Engine.load(spark, indexed[0], str(tree / "src"))


def test_build(indexed):
    _, done = indexed
    assert done["states"] == {"added": 7} and done["failures"] == []


def test_edges(engine):
    names = {r["id"]: r["qualname"] for r in engine.space.symbols.collect()}
    got = {(names[r["src_id"]], names.get(r["dst_id"]), r["reason"]) for r in engine.space.edges.collect()}
    assert got == {
        ("app.core:Engine", "app.core:Base", "same-file"), ("app.core:Engine.run", "app.core:Engine._prep", "same-file"), ("app.core:Engine.run", "app.helpers:norm", "import"),
        ("app.core:create", "app.core:Engine", "same-file"), ("app.test_core:test_it", "app.core:create", "import"), ("ring.a:f", "ring.b:g", "import"), ("ring.b:g", "ring.a:f", "import"),
        ("svc:Put", "svc:Clean", "same-file"), ("svc:Clean", None, "external"),
    }


def test_questions(engine):
    assert engine.find_symbols("Engine", kind="class")[0]["qualname"] == "app.core:Engine"
    assert [r["qualname"] for r in engine.who_calls("app.helpers:norm", 3)[1]] == ["app.core:Engine.run"]
    assert [r["qualname"] for r in engine.search("runs thing")][:1] == ["app.core:Engine"]
    assert engine.search("::") == []
    hit = engine.blast_radius("app/core.py")
    assert hit.kind == "file" and not hit.truncated and engine.blast_radius("app/core.py", limit=1).truncated and [r["path"] for r in hit.tests.collect()] == ["src/app/test_core.py"]
    assert engine.blast_radius("app.helpers:norm").kind == "symbol"
    assert [r["members"] for r in engine.cycles().collect()] == [["ring.a", "ring.b"]]
    a = engine.architecture()
    assert {r["module"]: r["layer"] for r in a.rows("modules")}["app.helpers"] == 2 and a.rows("counts")[0]["files"] == 7
    assert {r["qualname"] for r in engine.related("app.core:create")[1]} >= {"app.core:Engine", "app.test_core:test_it"}
    assert engine.one("src/app/core.py:create")["qualname"] == "app.core:create"
    d = engine.symbol_detail("app.core:Engine", include_source=True)
    assert [r["name"] for r in d.rows("members")] == ["run", "_prep"]
    with pytest.raises(LookupError):
        engine.one("nothing-like-that")
    s = engine.file_summary("helpers.py")
    assert [r["path"] for r in s.rows("importers")] == ["src/app/core.py"]
    assert engine.stats()["resolution"]["external"] == 1


def test_views(engine):
    assert "ring.a -> ring.b" in render.architecture(engine.architecture())
    assert "Engine.run" in render.tree(*engine.who_calls("app.helpers:norm"), "callers")
    assert "src/app/test_core.py" in render.blast(engine.blast_radius("app/core.py"))
    assert "norm" in render.file_summary(engine.file_summary("helpers.py")) and "files: 7" in render.stats(engine.stats())
    assert "Runs the thing" in render.detail(engine.symbol_detail("app.core:Engine"))
    assert render.fit(["x" * 30, "y"], 5) == "... 2 more lines left out" and render.fit(["a", "b" * 30], 1) == "a\n... 1 more lines left out"
    assert [render.human_bytes(n) for n in (0, 999, 1500, 2_000_000)] == ["0 B", "999 B", "1.5 kB", "2.0 MB"]


def test_tools(engine):
    offered = tools(engine)
    say = lambda **m: answer({"jsonrpc": "2.0", "id": 1, **m}, offered)
    assert len(say(method="tools/list")["result"]["tools"]) == 10
    assert "app.core:Engine.run" in say(method="tools/call", params={"name": "who_calls", "arguments": {"selector": "app.helpers:norm"}})["result"]["content"][0]["text"]
    assert say(method="tools/call", params={"name": "get_symbol", "arguments": {"selector": "zzz-none"}})["result"]["isError"]
    assert say(method="no")["error"]["code"] == -32601
    ask = lambda **m: answer({"jsonrpc": "2.0", "id": 1, **m}, offered, resources(engine))
    assert [r["uri"] for r in ask(method="resources/list")["result"]["resources"]] == ["plumbline://architecture", "plumbline://stats"]
    assert "files: 7" in ask(method="resources/read", params={"uri": "plumbline://stats"})["result"]["contents"][0]["text"]
    assert ask(method="resources/read", params={"uri": "plumbline://no"})["error"]["code"] == -32602
    assert ask(method="prompts/list")["result"]["prompts"][0]["name"] == "orient"
    assert "rename f" in ask(method="prompts/get", params={"name": "orient", "arguments": {"task": "rename f"}})["result"]["messages"][0]["content"]["text"]
    limits = {t["name"]: t["inputSchema"]["properties"] for t in ask(method="tools/list")["result"]["tools"]}
    assert limits["who_calls"]["depth"] == {"type": "integer", "minimum": 1, "maximum": 6}
    out = io.StringIO()
    serve(engine, io.StringIO('{"jsonrpc":"2.0","id":7,"method":"initialize"}\n{"jsonrpc":"2.0","method":"notifications/initialized"}\nnonsense\n'), out)
    assert [json.loads(x).get("id") for x in out.getvalue().splitlines()] == [7, None]


def test_command_line(indexed, capsys):
    run = lambda *a: (cli.main(["--index", indexed[0], *a]), capsys.readouterr().out)
    assert run("find", "Engine")[0] == 0
    assert run("cycles") == (1, "ring.a -> ring.b\n")
    assert run("show", "no-such-symbol")[0] == 1
    assert run("version")[0] == 0
    assert cli.main(["--index", "/tmp/none-at-all", "stats"]) == 2
    assert cli.main(["index", "--language", "cobol"]) == 2


def test_incremental(spark, tree, tmp_path):
    folder = str(tmp_path / "i")
    sources = lambda: discover(spark, str(tree))
    first = build(spark, sources(), folder, rounds=2)
    assert first["version"] == 1
    again = build(spark, sources(), folder, rounds=2)
    assert again["states"]["unchanged"] == 7 and again["version"] == 1
    before = {r["id"] for r in Engine.load(spark, folder).space.symbols.collect()}
    (tree / "src/app/helpers.py").write_text("def other(x):\n    return x\n")
    os.remove(tree / "src/ring/b.py")
    try:
        done = build(spark, sources(), folder, rounds=2)
        assert done["states"]["changed"] == 1 and done["states"]["removed"] == 1
        e = Engine.load(spark, folder)
        ids = {r["id"] for r in e.space.symbols.collect()}
        edges = e.space.edges.collect()
        assert all(r["src_id"] in ids and (r["dst_id"] is None or r["dst_id"] in ids) for r in edges)
        assert {r["reason"] for r in edges if r["dst_name"] == "norm"} == {"unresolved"}
        assert before & ids  # untouched symbols keep their ids
    finally:
        for n in ("src/app/helpers.py", "src/ring/b.py"):
            (tree / n).write_text(FILES[n])


def test_streaming(spark, tmp_path):
    changes, folder = str(tmp_path / "c"), str(tmp_path / "i")
    put = lambda rows: spark.createDataFrame(rows, "path string, lang string, text string, at string").selectExpr("path", "lang", "text", "cast(at as timestamp) AS changed_at").write.mode("append").parquet(changes)
    put([("a.py", "python", "def old(): pass\n", "2024-01-01"), ("a.py", "python", "def f(): pass\n", "2024-01-02")])
    follow(spark, changes, folder, str(tmp_path / "k"), rounds=1).awaitTermination()
    put([("b.py", "python", "import a\ndef g(): a.f()\n", "2024-01-03")])
    follow(spark, changes, folder, str(tmp_path / "k"), rounds=1).awaitTermination()
    e = Engine.load(spark, folder)
    assert {r["qualname"] for r in e.space.symbols.collect()} == {"a:f", "b:g"}
    assert [r["reason"] for r in e.space.edges.collect()] == ["import"]


def test_what_is_indexed(spark):
    df = spark.createDataFrame([("a.py", 1), ("env/a.py", 1), (".x/a.py", 1), ("x.pb.go", 1), ("big.go", 2_000_000), ("b.txt", 1), ("c.d.ts", 1)], "path string, length long")
    assert {r["path"]: r["lang"] for r in indexable(df).collect()} == {"a.py": "python", "c.d.ts": "typescript"}
    assert indexable(df, ["go"]).count() == 0


def test_the_index_is_found_from_below(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / ".plumbline").mkdir()
    assert cli.find_index(str(tmp_path / "a" / "b")) == str(tmp_path / ".plumbline")


def test_no_index(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Snapshots(spark, str(tmp_path)).current()


def test_the_pointer_is_replaced_and_old_versions_expire(spark, indexed, tmp_path):
    shots = Snapshots(spark, str(tmp_path / "i"))
    source = Snapshots(spark, indexed[0]).current()
    tables = {n: spark.read.parquet(f"{source}/{n}.parquet") for n in ("files", "symbols", "refs", "imports", "edges")}
    shots.commit(tables)
    os.makedirs(tmp_path / "i" / "v7")  # what a failed run left
    shots.commit(tables, note="x")
    assert shots.get("version") == 8 and shots.get("note") == "x" and shots.get("built_at") > 0 and shots.get("no", 1) == 1
    shots.put(note="y")
    assert shots.get("note") == "y" and shots.get("version") == 8
    shots.compact()
    assert shots.get("version") == 9 and shots.get("rows")["files"] == 7 and shots.size() > 0
    assert shots.expire(keep=1) == [1, 7, 8] and Engine.load(spark, str(tmp_path / "i")).find_symbols("Engine")


def test_unreadable_files_keep_their_rows(spark, tmp_path):
    src = spark.createDataFrame([("a.py", "python", b"def f(): pass\n"), ("b.py", "python", b"def g(): pass\n")], "path string, lang string, content binary")
    folder = str(tmp_path / "i")
    assert build(spark, src, folder, rounds=1)["languages"] == {"python": {"added": 2}}
    gone = src.selectExpr("path", "lang", "if(path = 'a.py', null, content) AS content")
    assert build(spark, gone, folder, rounds=1)["states"] == {"unchanged": 1}
    assert {r["name"] for r in Engine.load(spark, folder).space.symbols.collect()} == {"f", "g"}


def test_a_build_leaves_nothing_staged(spark, tmp_path):
    from plumbline.session import stage_dir

    staged = lambda: set(os.listdir(os.path.join(stage_dir(spark), "plumbline")))
    src = spark.createDataFrame([("a.py", "python", "def f(): pass\n")], "path string, lang string, text string")
    build(spark, src, str(tmp_path / "first"), rounds=1)
    before = staged()
    build(spark, src, str(tmp_path / "i"), rounds=1)
    assert staged() == before and Engine.load(spark, str(tmp_path / "i")).find_symbols("f")
