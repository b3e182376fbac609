import pytest

from plumbline.llm.provenance import composition, header_of, judge_header, not_hand_written, verdict


@pytest.mark.parametrize(
    "head,kind",
    [
        ("// Code generated by protoc-gen-go. DO NOT EDIT.", "generated"), ("# @generated by tool 1.2", "generated"), ("/*\n * This file was automatically generated from a.proto.\n */", "generated"),
        ("// Diese Datei wurde von X erzeugt. Nicht bearbeiten.", "generated"), ("# Copyright the authors\n# Vendored from lib 1.2.3; keep in step with upstream.", "vendored"),
        ("// lib v1.2.3 (c) the lib authors. Included here unmodified.", "vendored"), ("// imported verbatim from the lib project, release 1.2.3", "vendored"),
        ("// Originally generated by toolc; maintained by hand since 2019.", ""), ("// Was vendored from lib-kit; rewritten here, edit freely.", ""),
        ('# Writes the "DO NOT EDIT" banner into files; this module itself is ordinary code.', ""), ("// Auto-generated method stub", ""), ("// Copyright the authors, 2019\n// Keeps a catalog of rows.", ""),
        ('x = "Code generated by tool. DO NOT EDIT."', ""), ("", ""),
        # held out: none of these is in the given tables
        ("# created automatically by protoc-gen-foo", "generated"), ("# Output of tools/mkstate.py - regenerate instead of editing", "generated"), ("# Erstellt durch das Werkzeug gen.py", "generated"),
        ("// Ce fichier a été généré par outil", "generated"), ("// Este archivo fue generado por swig", "generated"), ("// The code that follows was generated by antlr 4", "generated"), ("# This source is produced by bindgen", "generated"),
        ("# The report is generated by the nightly job", ""), ("# Helper that documents how code is generated by protoc", ""), ("# Tokens are generated by the lexer", ""), ("# The file list is generated at start", ""),
        ("# Values copied from the settings page", ""), ("# Do not edit the cache while a writer runs", ""), ("# This file was taken from libfoo", "vendored"), ("// Code generated by x. DO NOT EDIT.\n// Parses the options.", "generated"),
    ],
)
def test_headers(head, kind):
    assert judge_header(header_of(head + "\npackage x\ncode()\n")) == kind


def test_composition():
    table = "T = [\n" + ",\n".join(", ".join(str(i * j) for j in range(8)) for i in range(40)) + "\n]\n"
    assert verdict(composition(table)) == "data"
    assert verdict(composition("!function(e){" + "var a=1;function b(c){return c.d+a?c[3]:void 0}e.f=(g,h)=>g?{x:h}:!1;" * 30 + "}(this);")) == "minified"
    assert verdict(composition("!function(e){" + "var counter=1;function render(c){return c.depth+counter?c[3]:void 0}e.publish=(g,h)=>g?{value:h}:!1;" * 8 + "}(this);")) == "minified"
    assert verdict(composition("a,b,c\n" + "1,2,3\n" * 20)) == "data"
    address = 'export const A = 5;\n\nexport const B = "https://x.example/' + "/".join(f"part{k}" for k in range(90)) + '";\n'
    prose = 'package a\n\nconst B = "' + "Callers wait for the next lagoon, as it drifts. " * 20 + '"\n'
    assert verdict(composition(address)) == verdict(composition(prose)) == "" and verdict(composition('A = "' + "ab0+/" * 200 + '"\n')) == "data"
    code = "import os\n\n\ndef f(path, n=3):\n    for name in os.listdir(path):\n        if name.endswith('.py') and n > 2:\n            yield name, n\n"
    assert verdict(composition(code)) == "" and verdict(composition(code + f'X = "{"long text " * 60}"\n')) == ""
    made = "".join(f"A_{i} = _reg({i}, b'\\x0{i % 9}')\n" for i in range(60))
    assert verdict(composition(made), True) == "repeated"


def test_operator(spark):
    files = [
        (1, "r/vendor/a.py", "2024-01-01"), (2, "r/src/b.py", "2024-01-02"), (2, "r/vendor/b.py", "2024-01-01"), (3, "r/src/vendors/c.py", "2024-01-01"), (4, "r/x_pb2.py", "2024-01-01"),
        (5, None, "2024-01-01"), (6, "r/src/g.py", None), (None, "r/vendor/z.py", "2024-01-01"), (7, "r/generators/minify_x.py", "2024-01-01"),
    ]
    f = spark.createDataFrame(files, "id long, path string, at string").selectExpr("id", "path", "'s' AS sha256", "cast(at as timestamp_ntz) AS indexed_at", "1 AS file_id", "'q' AS header")
    docs = [(1, "x = 1\n"), (2, "y = 2\n"), (3, "z = 3\n"), (6, "# @generated by t\nx = 1\n"), (5, None), (None, "# @generated by t\n"), (7, ""), (7, " ")]
    d = spark.createDataFrame(docs, "file_id long, text string").selectExpr("file_id", "text", "'n' AS repo")
    assert {r["file_id"]: r["reason"] for r in not_hand_written(f, d).collect()} == {1: "third-party", 4: "generated", 6: "generated"}


def test_empty(spark):
    f = spark.createDataFrame([], "id long, path string, sha256 string, indexed_at timestamp_ntz")
    assert not_hand_written(f, spark.createDataFrame([], "file_id long, text string")).count() == 0


def _copied(spark, places, edit):
    """A third-party file in ``places`` marked directories, an edited copy with a weak header, and a file of its own with such a header."""
    lines = [f"result_{k} = compute_value({k})" for k in range(20)]
    head = "# Sort Kit 2.4.1\n"
    assert judge_header(header_of(head + lines[0])) == "weak"
    docs = [(k, f"r{k}/vendor/kit/a.py", "\n".join(lines)) for k in range(places)]
    docs += [(1000, "own/src/a.py", head + edit(lines)), (1001, "own/src/b.py", head + "\n".join(x.replace("value", "other") for x in lines)), (1002, "own/src/c.py", "\n".join(lines[:5] + [f"own_line_number_{k} = {k}" for k in range(15)]))]
    f = spark.createDataFrame([x[:2] for x in docs], "id long, path string").selectExpr("id", "path", "'s' AS sha256", "timestamp_ntz'2024-01-01' AS indexed_at")
    found = not_hand_written(f, spark.createDataFrame([(x[0], x[2]) for x in docs], "file_id long, text string")).collect()
    return {r["file_id"]: r["reason"] for r in found if r["file_id"] >= 1000}


def test_a_project_copied_to_many_places_is_found(spark):
    assert _copied(spark, 80, lambda x: "\n".join([*x[:18], "changed_here = 1234567", x[19]])) == {1000: "contained"}


def test_containment_survives_white_space(spark):
    assert _copied(spark, 2, lambda x: "\r\n".join("\t" + y for y in x)) == {1000: "contained"}
