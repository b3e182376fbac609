"""Problem 1: files that nobody wrote by hand in their own repository.

Evidence, strongest first, each judged on the file's own path and text:

* the path: directories for third-party code, names that build tools give;
* the header: a note in the comments before the first code that a program or another project made it;
* the composition of the text: machine-repeated lines, compressed code, literals without code;
* containment: the share of a file's lines that also occur in marked third-party files of *other*
  repositories, from an inverted index of line hashes.  A copy is no case by itself, so containment only
  decides where the header speaks of an origin too weakly to count alone (a project with a version, say).

The index has a row per line hash with the least and greatest marked repository, which combine on the map side;
a line in a third of all files is one row per task and kept, and no pair of files is formed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import spread, stage
from plumbline.sources.tables import latest_files

#: Directory names (between slashes, lower case) that hold third-party code.
THIRD_PARTY_DIRS = (
    r"(?:^|/)(?:_?vendor|_?vendored|third[_-]?party|3rd[_-]?party|node_modules|bower_components|jspm_packages|site-packages|dist-packages"
    r"|externs?|externals?|godeps|pods|carthage|deps/[^/]+|libs/[^/]*-\d[^/]*)/"
)
#: File and directory names that code generators give.
GENERATED_NAMES = (
    r"(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw)?\.go|_pb\.(?:d\.)?[jt]sx?|_pb\.mjs|_grpc_pb\.[jt]s|\.(?:g|gen|generated|tables)\.[a-z]+|_(?:gen|generated|string|easyjson)\.[a-z]+"
    r"|(?:^|/)zz_generated[^/]*|(?:^|/)mock_[^/]*\.go)$|/(?:__generated__|generated|autogen|gen)/[^/]*$"
)
#: File names that bundlers and minifiers give.
MINIFIED_NAMES = r"(?:[.-](?:min|bundle|prod)\.(?:m|c)?jsx?|/chunk-[0-9a-z]+\.(?:m|c)?js)$"
#: Names that no text is needed to believe.
SURE_NAMES = r"(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw)?\.go|(?:^|/)zz_generated[^/]*|[.-]min\.(?:m|c)?js|\.bundle\.js|/__generated__/[^/]*)$"

_I = re.IGNORECASE
#: What a claim is about: the file itself, as the subject of a sentence or left out before a participle.
_SELF = r"^\W*(?:(?:please\s+note\W+|note\W+|warning\W+|attention\W+|achtung\W+)?(?:this|the|these|all|diese[rs]?|dieses|ce|cette|este|esta|questo)?\s*(?:is\s+an?\s+|whole\s+|entire\s+|source\s+)?(?:file|code|source|module|script|document|package|class(?:es)?|bindings?|parser|content|datei|quelltext|fichier|archivo|fichero|arquivo|file|código|code)s?\b(?:\s+(?:is|was|has|have|been|were|are|that|which|follows?|below|here|wurde|wird|ist|a|été|est|fue|es|foi|è|stato|von\s+\S+))*\s+|(?:this|the\s+following)\s+(?:is|was)\s+)?"
_HOW = r"(?:(?:fully\s+|entirely\s+)?(?:auto(?:matically|matisch|matiquement|máticamente|maticamente)?|machine|maschinell|programmatically)[-\s]*)?"
_GENERATED = re.compile(
    rf"""@generated\b | <auto-?generated\b
    | {_SELF}{_HOW}(?:generated|produced|emitted|compiled|transpiled|rendered|erzeugt|generiert|généré|generado|generato|gerado)\b(?!\s+(?:method|function|constructor|catch|stub|type|files?\s+are|code\s+is|rows?|values?|ids?|tokens?|names?|keys?|output))
    | {_SELF}(?:auto-?|machine[-\s])(?:generated|created|made|written|built)\b(?!\s+(?:method|function|constructor|catch|stub|type))
    | {_SELF}(?:created|made|written|built|erstellt|geschrieben|créé|creado|creato|criado)\s+(?:auto\w*|maschinell|by\s+(?:a\s+|the\s+)?(?:tool|program|script|generator|compiler)\b|by\s+\S*(?:gen|\.\w+|protoc\S*|c)\b|(?:durch|von)\s+(?:das|dem|den|der|die|einem|ein)?\s*(?:werkzeug|programm|skript|generator)|(?:par|por|da)\s+\S+)
    | {_SELF}(?:automatisch|maschinell|automatically|von\s+\S+)\s+(?:\S+\s+)?(?:created|produced|written|built|erstellt|erzeugt|generiert)\b
    | ^\W*output\s+of\s+\S+[./]\S+ | \bregenerate\s+(?:it\s+)?instead\b
    | \b(?:do\s+not|don'?t|never)\s+(?:hand[-\s]?)?(?:edit|modify|change|touch|alter)\b(?!\s+(?:the|a|an|any|it\s+while|without|unless|order)\b) | \b(?:changes?|edits?|modifications?)\b.{{0,40}}\b(?:lost|overwritten|discarded)
    | \bnicht\s+(?:bearbeiten|ändern|editieren) | \bne\s+pas\s+(?:modifier|éditer) | \bno\s+(?:editar|modificar)\b | \bnon\s+modificare\b | 自动生成 | 自動生成 | 请勿(?:修改|编辑)""",
    re.X | _I,
)
_VENDORED = re.compile(
    rf"""{_SELF}(?:vendored|imported|copied|taken|lifted|bundled|borrowed|forked|mirrored)\s+(?:verbatim\s+|unmodified\s+|unchanged\s+|as[- ]is\s+|directly\s+)?(?:from|copy|in|at)\b
    | {_SELF}(?:a\s+)?(?:bundled\s+|vendored\s+)?third[-\s]party\s+(?:copy|code|source|file|library|component) | \b(?:included|bundled|shipped|distributed|reproduced)\s+(?:here\s+|hereby\s+)?(?:unmodified|unchanged|verbatim|as[-\s]is)\b
    | {_SELF}(?:an?\s+|the\s+)?(?:bundled\s+|vendored\s+)?copy\s+of\s+\S+.{{0,60}}\b(?:upstream|release|version|commit|v?\d+\.\d+)\b | \bkeep\s+in\s+(?:step|sync)\s+with\s+upstream | \bupstream\s+(?:commit|version|revision|release|tag)\b
    | \bdo\s+not\s+(?:patch|fix|edit)\s+(?:locally|here)\b""",
    re.X | _I,
)
#: The file is written by hand now: takes back what other lines claim.
_OWN = re.compile(
    r"""\b(?:originally|once|formerly|initially|previously)\s+(?:auto-?matically\s+)?(?:auto-?)?(?:generated|vendored|copied|imported|forked|derived|taken|bundled|minified)\b
    | \b(?:maintained|edited|written|kept|rewritten|changed|modified|reworked|tweaked)\s+(?:here\s+)?(?:by\s+hand|manually|since|locally) | \brewritten\b | \bedit\s+freely\b | \bfeel\s+free\s+to\s+edit
    | \bno\s+longer\s+(?:generated|vendored|in\s+sync) | \bnot\s+(?:generated|auto-?generated|vendored|minified)\b | \bhand[-\s]?(?:written|edited|maintained|crafted)\b | \bordinary\s+(?:code|source|module)""",
    re.X | _I,
)
#: The line speaks of other files: what the module does, at its beginning.
_DOES = re.compile(r"^\W*(?:writes?|emits?|prints?|produces|generates?|creates?|adds?|inserts?|checks?|detects?|skips?|finds?|parses?|reads?|strips?|removes?)\b | \b(?:method|function|constructor)\s+stub\b", re.X | _I)
#: An origin without a claim: counts only together with containment.
_WEAK = re.compile(r"\bv?\d+\.\d+\.\d+\b|\bupstream\b|https?://\S+/\S+|\(c\)\s+the\b|\bbased\s+on\b", _I)
_QUOTED = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|`[^`\n]*`|[“”„«][^“”»\n]*[“”»]")

_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(?<![\w.])-?\d[\w.]*")
_COMMENTS = re.compile(r"/\*[\s\S]*?\*/|^\s*(?://|#(?!\[)).*$", re.M)
_GAPS = re.compile(r"[\s,\[\]{}:()]+")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_SYNTAX = re.compile(r"[(){};=]")
#: What a line's shape disregards: literals, numbers and names.
_ATOM = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\d[\w.]*|[A-Za-z_$][\w$]*")


def header_of(text: str) -> list[str]:
    """The comment lines before the first code, without comment signs; package clauses and pragmas are passed over."""
    out, block = [], ""
    for raw in text.lstrip("﻿").splitlines():
        s = raw.strip()
        if block:
            end = s.find(block)
            out.append((s if end < 0 else s[:end]).lstrip("*! ").strip())
            if end >= 0:
                block = ""
            continue
        if not s or s.startswith("#!") or re.match(r"package\s+\w+\s*;?$|['\"]use \w+['\"];?$|from __future__ ", s):
            continue
        if s.startswith("/*"):
            rest = s[2:].lstrip("*! ")
            end = rest.find("*/")
            out.append((rest if end < 0 else rest[:end]).strip())
            block = "*/" if end < 0 else ""
            if end >= 0 and rest[end + 2 :].strip():
                break
            continue
        if s.startswith("<!--"):
            out.append(s[4:].replace("-->", "").strip())
            block = "" if "-->" in s else "-->"
            continue
        if s.startswith(("//", "#", "--", ";;")):
            out.append(s.lstrip("/#-;! ").strip())
            continue
        if s[:3] in ('"""', "'''"):
            q, rest = s[:3], s[3:]
            end = rest.find(q)
            out.append((rest if end < 0 else rest[:end]).strip())
            block = q if end < 0 else ""
            continue
        break
    return out


def judge_header(lines: list[str]) -> str:
    """'generated', 'vendored', 'weak' or ''."""
    kind = ""
    for line in lines:
        bare = _QUOTED.sub(" ", line) if not line.startswith("<") else line
        if _OWN.search(bare):
            return ""
        if _DOES.search(bare):
            continue
        if not kind and _GENERATED.search(bare):
            kind = "generated"
        elif not kind and _VENDORED.search(bare):
            kind = "vendored"
    if kind:
        return kind
    return "weak" if any(_WEAK.search(x) for x in lines) else ""


class Composition(NamedTuple):
    """Shares that tell how a text is made; the names of files only shift the thresholds."""

    long: float  # characters in lines of more than 300 that are long without their literals too
    width: float  # characters a line
    short: float  # names of one or two letters among all names outside of literals, if there are 20
    data: bool  # literals and hardly anything else
    repeated: float  # lines of the four most frequent shapes, names and numbers disregarded
    numbered: bool  # about a number a line


def composition(text: str) -> Composition:
    lines = text.split("\n")
    size = len(text)
    wide = [x for x in lines if len(x) > 300]
    long = sum(len(x) for x in wide if len(_LITERAL.sub("0", x)) > 200) / size
    width = size / len(lines)
    short = 0.0
    if long > 0.1 or width > 80:
        names = _NAME.findall(_LITERAL.sub(" ", text))
        if len(names) >= 20:
            short = sum(len(n) <= 2 for n in names) / len(names)
    raw = text.encode("utf-8", "surrogatepass")
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    data = False
    if digits > 0.12 * size or wide or text.count('"') + text.count("'") > 0.02 * size + 8:
        code = _COMMENTS.sub(" ", text)
        found = _LITERAL.findall(code)
        chars = sum(map(len, found))
        solid = len(code) - sum(map(len, _GAPS.findall(code)))
        if chars > 0.75 * solid:
            names = len(_NAME.findall(_LITERAL.sub(" ", code)))
            # a long literal is data if it is neither prose nor an address
            blob = max((len(x) for x in found if " " not in x and "://" not in x), default=0)
            data = len(found) >= 20 and names <= 0.25 * len(found) or blob >= 400 and names <= 12
    if not data and not _SYNTAX.search(text):
        rows = [x for x in lines if x.strip()]
        commas, tabs = {x.count(",") for x in rows}, {x.count("\t") for x in rows}
        data = len(rows) >= 8 and (len(commas) == 1 and commas != {0} or len(tabs) == 1 and tabs != {0})
    repeated, numbered = 0.0, False
    if len(lines) >= 12:
        shapes = Counter(x for x in map(str.strip, _ATOM.sub("a", text).split("\n")) if len(x) > 3)
        total = sum(shapes.values())
        if total:
            repeated = sum(n for _, n in shapes.most_common(4)) / total
            numbered = digits > 0.8 * total and len(lines) >= 30
    return Composition(long, width, short, data, repeated, numbered)


def verdict(c: Composition, generated_name: bool = False, minified_name: bool = False) -> str:
    """'minified', 'data', 'repeated' or ''; the same rules as :func:`_verdict_column`."""
    if c.short > 0.2 and (c.long > 0.5 or minified_name and (c.long > 0.3 or c.width > 80)) or minified_name and c.long > 0.3:
        return "minified"
    if c.data:
        return "data"
    if c.repeated >= 0.6 and generated_name or c.repeated >= 0.9 and c.numbered:
        return "repeated"
    return ""


def _verdict_column():
    by_name = F.col("min_name") & ((F.col("c.long") > 0.3) | (F.col("c.width") > 80))
    minified = ((F.col("c.short") > 0.2) & ((F.col("c.long") > 0.5) | by_name)) | (F.col("min_name") & (F.col("c.long") > 0.3))
    repeated = ((F.col("c.repeated") >= 0.6) & F.col("gen_name")) | ((F.col("c.repeated") >= 0.9) & F.col("c.numbered"))
    return F.when(minified, "minified").when(F.col("c.data"), "data").when(repeated, "repeated").otherwise("")


_SHARES = "struct<long:double,width:double,short:double,data:boolean,repeated:double,numbered:boolean>"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text")).to_pylist()
        made = [composition(t) for t in text]
        parts = [pa.array(x, t) for x, t in zip(zip(*made), (pa.float64(),) * 3 + (pa.bool_(), pa.float64(), pa.bool_()))] if made else []
        if made:
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("file_id")),
                    pa.array([judge_header(header_of(t)) for t in text], pa.string()),
                    pa.StructArray.from_arrays(parts, list(Composition._fields)),
                ],
                ["file_id", "header", "c"],
            )


def file_evidence(files: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per file id: file_id, repo, third_party, gen_name, min_name, sure_name, has_text, header, made.

    The latest row of each file id holds; of several texts of a file the greatest.  Null paths have no path
    evidence, null and blank texts no text evidence.
    """
    path = F.lower("path")
    named = latest_files(files, "id", "path").select(
        F.col("id").alias("file_id"),
        F.substring_index("path", "/", 1).alias("repo"),
        *[F.coalesce(path.rlike(p), F.lit(False)).alias(n) for n, p in (("third_party", THIRD_PARTY_DIRS), ("gen_name", GENERATED_NAMES), ("min_name", MINIFIED_NAMES), ("sure_name", SURE_NAMES))],
    )
    texts = documents.where(F.col("file_id").isNotNull() & F.col("text").rlike(r"\S")).select("file_id", "text")
    # texts don't travel: they are judged where they are read, and the verdict waits for the name's flags
    judged = (
        spread(texts).mapInArrow(_judge, f"file_id bigint, header string, c {_SHARES}")
        .groupBy("file_id").agg(F.max("header").alias("header"), F.max("c").alias("c"))
    )
    return (
        named.join(judged, "file_id", "left")
        .withColumn("has_text", F.col("c").isNotNull())
        .withColumn("made", F.when(F.col("has_text"), _verdict_column()))
        .drop("c")
    )


def third_party_paths(files: DataFrame) -> DataFrame:
    """(file_id, repo, marked): whether the latest path of each file lies in a directory for third-party code."""
    return latest_files(files, "id", "path").select(
        F.col("id").alias("file_id"), F.substring_index("path", "/", 1).alias("repo"), F.coalesce(F.lower("path").rlike(THIRD_PARTY_DIRS), F.lit(False)).alias("marked")
    )


def vendored_containment(marked: DataFrame, documents: DataFrame, min_line: int = 16) -> DataFrame:
    """(file_id, lines, contained): exact containment of each file's lines in the marked files of other repositories.

    ``marked`` has (file_id, repo, marked).  A line counts without white space around it and once per file; short lines
    don't count, and files without a line that counts have no row.  However many files a line is in, it counts: a project that is
    copied into a great many places has no other ones.  Null texts, ids and repositories have no containment.
    """
    lines = (
        documents.where("file_id IS NOT NULL AND text IS NOT NULL")
        .select("file_id", F.explode(F.split("text", "[\r\n]")).alias("line"))
        .select("file_id", F.btrim("line", F.lit(" \t\f\v\ufeff")).alias("line"))
        .where(F.length("line") >= min_line)
        .select("file_id", F.xxhash64("line").alias("h"))
        .distinct()
        .join(marked.select("file_id", "repo", "marked").hint("merge"), "file_id")  # grows with the files; its staged size would deceive
    )
    lines = stage(lines, "lines")
    index = lines.where("marked").groupBy("h").agg(F.min("repo").alias("r0"), F.max("repo").alias("r1"))
    return (
        lines.join(index.hint("merge"), "h", "left")
        .groupBy("file_id")
        .agg(F.count("*").alias("lines"), F.avg(F.when((F.col("r0") != F.col("repo")) | (F.col("r1") != F.col("repo")), 1.0).otherwise(0.0)).alias("contained"))
    )


def not_hand_written(files: DataFrame, documents: DataFrame, min_contained: float = 0.8, min_lines: int = 5) -> DataFrame:
    """(file_id, reason) of the files that are not hand-written source of their own repository.

    reason: third-party, generated, vendored, minified, data, repeated or contained.  Empty tables give no rows.
    """
    evidence = stage(file_evidence(files, documents), "evidence")
    copies = vendored_containment(evidence.select("file_id", "repo", (F.col("third_party") | (F.col("header") == "vendored")).alias("marked")), documents)
    weak = evidence.where("header = 'weak'").join(copies, "file_id", "left")
    contained = weak.where((F.col("contained") >= min_contained) & (F.col("lines") >= min_lines)).select("file_id", F.lit("contained").alias("reason"))
    reason = (
        F.when(F.col("third_party"), "third-party")
        .when(F.col("header").isin("generated", "vendored"), F.col("header"))
        .when(F.col("made") != "", F.col("made"))
        .when(~F.col("has_text") & F.col("sure_name"), "generated")
    )
    own = evidence.withColumn("reason", reason).where("reason IS NOT NULL").select("file_id", "reason")
    return own.unionByName(contained).groupBy("file_id").agg(F.min("reason").alias("reason"))
