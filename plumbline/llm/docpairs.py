"""Problem 4: functions paired with documentation that says something.

Documentation passes a small state machine: comment syntax of the languages is taken away (blocks, line
comments, quotes), lines are told apart (tags, remarks to tools, code), what is left is joined to
sentences, and a sentence counts if it has a word that neither the name nor the signature nor mere filler
explains and it isn't a placeholder, a pointer or a remark on authorship.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.extract import extractor_for, pylex
from plumbline.session import spread

_I = re.IGNORECASE
#: Words that say nothing by themselves in documentation.
FILLER = frozenset(
    """a an and are as at be by can could do does done did for from given has have here his if in into is it its itself just may me my of on one or our
    shall should so some such that the their them then there these they this those to too very was we were which will with would you your
    function functions method methods func def class module procedure routine helper helpers implementation implements operation operations
    perform performs execute executes executed run runs call calls called invoke invokes handle handles process processes
    return returns returned returning result results value values output outputs param params parameter parameters arg args argument arguments
    description docstring docs documentation doc comment summary name named object instance type specified provided passed input2 self cls
    todo fixme none null2 nil2 void na tbd xxx hack wip come comes coming soon later pending constructor destructor getter setter accessor mutator ctor stub
    der die das den dem des ein eine einer einem einen und ist sind wird werden noch offen hier später folgt konstruktor methode funktion klasse
    le la les un une des du est sont sera ici et constructeur méthode fonction classe bientôt
    el los las una es son será aquí y constructor método función clase pronto""".split()
)
_PLACEHOLDER = re.compile(
    r"""^\W*(?:to-?do|fix-?me|xxx+|hack|wip)\b | ^\W*(?:n/?a|none|nothing|null|nil|empty|tbd|tba|tbc|foo|bar|test|\.\.\.|…)\W*$
    | \bblah\b | \blorem\s+ipsum\b | auto-?\s?generated\s+(?:method|function|constructor|catch|class|by|stub)
    | \b(?:method|function)\s+stub\b
    | \b(?:add|insert|put|write|provide|enter|fill\s+in|need|needs|missing|no)\s+(?:a\s+|an\s+|the\s+|some\s+|your\s+|more\s+|proper\s+)?(?:short\s+|brief\s+)?(?:description|docstring|documentation|docs?|comment|summary)\b
    | \b(?:description|documentation|docs?|docstring|comment|summary)\s+(?:goes\s+here|here|missing|pending|needed|to\s+follow|follows|to\s+be\s+\w+|will\s+follow|tbd|todo)\b
    | \b(?:no|missing|empty)\s+doc[-\s]?strings?\b | \bdoc[-\s]?strings?\s+(?:is\s+)?(?:missing|pending|empty|todo|tbd)\b
    | \b(?:where|here)\s+(?:is\s+where\s+)?the\s+magic\s+(?:happens|is|lives)\b | \bdoes\s+(?:its|the|some)\s+(?:thing|magic|job|work|stuff)\b | \bmore\s+(?:details?\s+|docs?\s+)?(?:to\s+)?(?:come|follow)\b
    | \b(?:undocumented|not\s+(?:yet\s+)?documented)\b | \bdocument\s+(?:this|me|it)\b
    | \b(?:will|to|should|must)\s+be\s+(?:documented|described|written|filled|added|explained)\b
    | \bwrite\s+(?:the|some|a)?\s*(?:documentation|docs?|description)\b | \bdocstring\s+for\b
    | \bwhat\s+(?:its|the|it'?s)\s+name\s+(?:says|suggests|implies|states)\b | \bnothing\s+(?:more|else)\s+to\s+(?:say|be\s+said|add)\b
    | \b(?:self[- ]explanatory|name\s+says\s+it\s+all)\b
    | \b(?:beschreibung|dokumentation|doku|text)\s+(?:folgt|fehlt|kommt)\b | \bfehlt\s+noch\b.*\b(?:text|beschreibung|doku\w*)\b | \bnoch\s+(?:zu\s+)?(?:beschreiben|dokumentieren)\b
    | ^\W*(?:por\s+hacer|pendiente|sin\s+descripci[oó]n|falta\s+(?:la\s+)?(?:descripci[oó]n|documentaci[oó]n)|à\s+faire|à\s+compléter|a\s+fazer|da\s+fare)\b
    | 待补充 | 待完善 | 待写 | 待办 | 暂无 | 未完成 | 未記入 | 説明なし | 後で書く | 설명\s*없음 | 추후\s*작성""",
    re.X | _I,
)
_TOOL = re.compile(
    r"""^\W*(?:eslint|tslint|jshint|jslint|jscs|prettier|stylelint|istanbul|c8|v8|nyc|webpack\w*|biome|oxlint|deno|rollup|vite|flow|sonar\w*|nosonar|nosec|noqa|flake8|pylint|pyright|mypy|pyre|ruff|black|yapf|isort|fmt|
      type\s*:\s*ignore|pragma|coverage|codespell|cspell|spell-?checker|nolint|golint|staticcheck|lint|go\s*:\s*\w+|\+build|export\s+\w+$|line\s+\S+:\d+|cgo|ts-(?:ignore|nocheck|expect-error|check)|
      vim?\s*:|ex\s*:|-\*-|emacs|coding\s*[:=]|region|endregion|<editor-fold|</editor-fold|@formatter|clang-format|swagger|codegen|language\s*=|jsx\s|@jsx)(?:\b|[-:])
      | ^\W*\#?(?:region|endregion)\b | ^\W*-\*- | ^.*\bvim?:\s*set\b""",
    re.X | _I,
)
_POINTER = re.compile(
    r"""^\W*(?:inherited|inherits|inheritdoc|overridden|overrides|as\s+above|same\s+as\s+above|ditto|ibid)\b[\s\w]{0,30}\W*$
    | ^\W*\{?@inherit-?doc\b | ^\W*(?:inherits?|overrides?|same\s+as|copied\s+from|implements)\s+\S+\W*$
    | ^\W*(?:please\s+)?(?:see|cf|refer\s+to|siehe|vgl|v[ée]ase|voir|consulter|ver|vedi|veja|look\s+at|have\s+a\s+look\s+at)\b\s*(?:also\s+)?(?:\W|(?:the|a|an|our|its|le|la|les|das|die|der|dem|el|los|il|manuel|handbuch|oben|unten|ci-dessus|arriba|base|parent|super|abstract|class|classes|interface|method|function|module|file|docs?|documentation|manual|wiki|readme|spec|tests?|issue|ticket|bug|pr|rfc|section|above|below|there|here|elsewhere|for|more|further|details?|information|info|reference|in|on|at|of|and|to|(?-i:\w*[A-Z_./:\#(]\S*))(?=\W|$))*\W*$
    | ^\W*https?://\S+\W*$""",
    re.X | _I,
)
_RIGHTS = re.compile(
    r"""^\W*@?(?:authors?|maintainers?|owner|since|version|date|copyright|licen[sc]e|revision|modified|last\s+(?:modified|updated|changed)|created|contributors?|credits?)\b\s*(?:by\b|on\b|:|\(c\)|©|[A-Z0-9@<]|the\b|$|\w+\s*\w*\W*$)
    | ^\W*(?:written|added|changed|implemented|ported|reviewed)\s+(?:by|on)\b
    | ^\W*\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\b(?:\W+(?:initial|first|new|last|version|revision|release|created?|added?|changed?|updated?|by|import|commit|draft|\w+\.?)){0,3}\W*$
    | ^\W*\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}\b\W*(?:\w+\W*){0,3}$""",
    re.X | _I,
)
_YEAR = re.compile(r"(?:\(c\)|©)\s*\d{4}")
_BANNER = re.compile(r"^\s*[-=*#~_+/.]{3,}.*[-=*#~_+/.]{3,}\s*$")
_CODE = re.compile(
    r"""^\s*(?:
      (?:return|yield|await|throw|raise|del|assert|break|continue|pass|goto|defer)\b(?:\s*[;:]?\s*$|\s+(?:[-!]?[\w.$\[\]'"]+|.*[()=<>+*/{}\[\];].*)\s*;?\s*$)
      | (?:if|elif|while|for|switch|with|match)\b.*(?:[{:]\s*$|[=<>!]=|[<>]\s*[\w(]|\)\s*[{;]?\s*$).*
      | (?:if|while|for|switch)\b[^.]*:\s*\S+\(.*\)\s*;?\s*$
      | (?:else|try|finally|do)\s*[:{]?\s*$ | (?:except|catch)\b.*[:{]\s*$
      | (?:import\s+[\w.{}*\s,"'/@-]+(?:from\s+\S+)?;?|from\s+[\w.]+\s+import\s+.+|package\s+\w+|export\s+.+[;{])\s*$
      | (?:def|async\s+def|class|func|function|const|let|var|type|interface|struct|enum|public|private|static)\s+[\w$]+.*[{:;=(].*
      | [\w$.\[\]"']+\s*(?:=|:=|\+=|-=|\*=|/=|<<=|\|=|&=|\?\?=)\s*\S.*
      | (?!O\()[\w$]+(?:\.[\w$]+|\[[^\]]*\])*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*[;,{:]?\s*$
      | [\w$.]+(?:\+\+|--)\s*;?\s*$ | [{}()\[\];,]+\s*$ | .*[;{}]\s*$ | </?\w[^>]*>\s*$ | @\w+(?:\.\w+)*\([^)]*\)\s*$
    )""",
    re.X,
)
_TAG = re.compile(
    r"^\s*(?:@|:|\\)(param|parameter|arg|argument|keyword|type|rtype|returns?|retval|throws?|raises?|exception|yields?|template|typeparam|tparam|property|prop)\b:?\s*(?:\{[^}]*\}\s*)?(.*)$", _I
)
_OTHER_TAG = re.compile(r"^\s*\{?@(?:see|link|inherit-?doc|internal|private|public|protected|override|hidden|ignore|api|category|module|namespace|memberof|class|constructor|function|method|name|kind|author|since|version|copyright|license)\b.*$", _I)
_EXAMPLE = re.compile(r"^\s*(?:examples?|usage|beispiel|ejemplo)\s*:?\s*$", _I)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+")
_SIGNS = re.compile(r"\w")


def strip_comment(doc: str) -> list[str]:
    """The lines of a docstring without comment syntax: quotes, block delimiters, leading signs."""
    lines, inside = [], False
    for raw in doc.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        s = raw.strip()
        for q in ('"""', "'''"):
            if s.startswith(q):
                s = s[3:]
            elif s[:1] in "rRuUbBfF" and s[1:4] == q:
                s = s[4:]
            if s.endswith(q):
                s = s[:-3]
        if s.startswith("/*"):
            inside, s = True, s[2:].lstrip("*!")
        if "*/" in s:
            s, inside = s.split("*/")[0].rstrip("*"), False
        s = s.strip()
        if s.startswith("<!--"):
            s = s[4:]
        if s.endswith("-->"):
            s = s[:-3]
        if s.startswith("//"):
            s = s.lstrip("/").lstrip("!")
        elif s.startswith("#") and not re.match(r"#\w", s):
            s = s.lstrip("#").lstrip("!:")
        elif s.startswith("*") and not s.startswith("**"):
            s = s[1:]
        elif s == "**":
            s = ""
        lines.append(s.strip())
    return lines


def _pieces(text: str) -> set[str]:
    return {p.lower() for p in _PIECE.findall(text)}


def _told(word: str, names: set[str]) -> bool:
    """Whether the names tell the word: itself, a plural, a verb form, or several of their pieces run together."""
    if word in names:
        return True
    for end in ("s", "es", "d", "ed", "ing", "er", "ers", "ion"):
        if word.endswith(end):
            stem = word[: -len(end)]
            if stem in names or stem + "e" in names or (len(stem) > 2 and stem[-1] == stem[-2] and stem[:-1] in names):
                return True
    if word.endswith("ies") and word[:-3] + "y" in names or word.endswith("ied") and word[:-3] + "y" in names:
        return True
    return False


#: Words of placeholders: one of them, or few letters, or letters beyond ASCII, must be there before the full pattern is tried.
_HINTS = frozenset(
    """todo to fixme fix xxx hack wip blah lorem stub auto autogenerated generated description docstring documentation doc docs document documented
    undocumented comment summary says said say suggests implies states explanatory fehlt folgt kommt noch hacer pendiente falta sin faire fazer fare
    described written filled added explained magic thing job work stuff string strings come follow na none nothing null nil empty tbd tba tbc foo bar test""".split()
)
_LOWER = re.compile(r"[a-z]+")


def _placeholder(text: str) -> bool:
    low = text.lower()
    if text.isascii() and len(text) > 8 and _HINTS.isdisjoint(_LOWER.findall(low)):
        return False
    return bool(_PLACEHOLDER.search(text))


def _rights(text: str) -> bool:
    low = text.lower()
    return bool(_RIGHTS.match(text)) or any(x in low for x in ("rights reserved", "spdx-license", "licensed under")) or (("(c)" in low or "\u00a9" in low) and bool(_YEAR.search(low)))


def _says(sentence: str, names: set[str]) -> bool:
    if not _SIGNS.search(sentence):
        return False
    for word in _WORD.findall(sentence):
        if word.isascii():
            for p in _PIECE.findall(word):
                p = p.lower()
                if p not in FILLER and not _told(p, names):
                    return True
        elif word.lower() not in names:
            return True
    # costs such as O(1) or O(n log n) have no telling word
    return bool(re.search(r"\bO\([^)]+\)", sentence))


def is_informative(doc: str | None, name: str | None, signature: str | None) -> bool:
    """Whether the documentation tells something that name and signature don't; see the module."""
    if not doc or not doc.strip():
        return False
    names = _pieces(name or "") | _pieces(signature or "")
    whole = re.sub(r"[^a-z]", "", (name or "").lower())
    paragraph: list[str] = []
    blocks: list[str] = []

    def close() -> None:
        if paragraph:
            blocks.append(" ".join(paragraph))
            paragraph.clear()

    example = False
    for s in strip_comment(doc):
        if not s:
            close()
            continue
        if _EXAMPLE.match(s):
            close()
            example = True
            continue
        if _TOOL.match(s) or _OTHER_TAG.match(s) or _BANNER.match(s) or not _SIGNS.search(s):
            close()
            continue
        m = _TAG.match(s)
        if m:
            close()
            rest = m.group(2)
            if m.group(1).lower().startswith(("param", "arg", "key", "prop", "t", "exc", "rai")):
                # the first word is the parameter's own name
                rest = re.sub(r"^\W*[\w$.]+\W*", "", rest, count=1)
            if rest and not _placeholder(rest) and _says(rest, names):
                return True
            continue
        if _CODE.match(s) and not re.match(r"^O\(", s):
            close()
            continue
        paragraph.append(s)
    close()
    for block in blocks:
        if len(re.split(r"(?<=[.!?;。])\s+", block)) == 1 and _placeholder(block):
            continue
        for sentence in re.split(r"(?<=[.!?。！？])\s+", block):
            if not _says(sentence, names) or re.sub(r"[^a-z]", "", sentence.lower()) == whole:
                continue
            if not (_placeholder(sentence) or _POINTER.match(sentence) or _rights(sentence) or _TOOL.match(sentence)):
                return True
    return False


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, name, sig = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("docstring", "name", "signature"))
        yield batch.filter(pa.array([is_informative(*x) for x in zip(doc, name, sig)], pa.bool_()))


def documented_symbols(symbols: DataFrame) -> DataFrame:
    """Functions and methods with a non-null signature and an informative docstring, one row per id:
    symbol_id, file_id, name, kind, lang, start_line, end_line, signature, docstring.

    Null kinds, ids, signatures and docstrings, and blank docstrings, are dropped; rows that arrive twice count once.
    """
    columns = ["id", "file_id", "name", "kind", "lang", "start_line", "end_line", "signature", "docstring"]
    rows = symbols.select(*columns).where(
        F.col("id").isNotNull() & F.col("kind").isin("function", "method") & F.col("signature").isNotNull() & (F.length(F.trim("docstring")) > 0)
    )
    return spread(rows).mapInArrow(_keep, rows.schema).dropDuplicates(["id"]).withColumnRenamed("id", "symbol_id")


def informative_ids(symbols: DataFrame) -> DataFrame:
    """(symbol_id) of :func:`documented_symbols`, without carrying their texts through the shuffle."""
    rows = symbols.select("id", "kind", "name", "signature", "docstring").where(
        F.col("id").isNotNull() & F.col("kind").isin("function", "method") & F.col("signature").isNotNull() & (F.length(F.trim("docstring")) > 0)
    )
    return spread(rows).mapInArrow(_keep, rows.schema).select(F.col("id").alias("symbol_id")).distinct()


def code_pairs(symbols: DataFrame, documents: DataFrame) -> DataFrame:
    """(symbol_id, file_id, kind, signature, docstring, code): documented functions with lines
    start_line to end_line of their file's text.

    Symbols of files without text, or whose lines lie outside it, are left out (there is no code to pair).
    Lines end at LF or CRLF.  A text is joined to its symbols, never gathered with them, so a file with
    a great many symbols spreads over the tasks as AQE splits its partition.
    """
    texts = documents.where(F.col("file_id").isNotNull() & F.col("text").isNotNull()).groupBy("file_id").agg(F.max("text").alias("text"))
    found = documented_symbols(symbols).where("start_line >= 1 AND end_line >= start_line")
    # split before the join: once for each text, not once for each of its symbols
    split = texts.select("file_id", F.split("text", "\r?\n").alias("lines"))
    return (
        found.join(split, "file_id")
        .withColumn("code", F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"))
        .where("code <> ''")
        .select("symbol_id", "file_id", "kind", "signature", "docstring", "code")
    )


_LEXED = "name string, local string, kind string, start_line int, end_line int, signature string, docstring string, code string"


def _lex_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("name", pa.string()), ("local", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("docstring", pa.string()), ("code", pa.string())]))
    for batch in batches:
        lang, text = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lang", "text"))
        found = []
        for x, t in zip(lang, text):
            extractor, rows = extractor_for(x), []
            if extractor is not None:
                try:
                    symbols = extractor("", t).symbols
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    symbols = pylex.extract("", t).symbols if x == "python" else []  # only Python has a parser that can refuse a text
                lines = t.replace("\r\n", "\n").split("\n")
                for d in symbols:
                    if d.kind in ("function", "method") and is_informative(d.docstring, d.name, d.signature):
                        rows.append({"name": d.name, "local": d.local, "kind": d.kind, "start_line": d.start_line, "end_line": d.end_line, "signature": d.signature, "docstring": d.docstring, "code": "\n".join(lines[d.start_line - 1 : d.end_line])})
            found.append(rows)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("file_id")), batch.column(batch.schema.get_field_index("lang")), pa.array(found, kinds)], ["file_id", "lang", "found"])


def lexed_pairs(documents: DataFrame) -> DataFrame:
    """(file_id, lang, name, local, kind, start_line, end_line, signature, docstring, code) of the functions in source texts
    themselves, without a symbols table.

    A string- and comment-aware lexer matches braces to delimit the functions of JavaScript, TypeScript and Go and attaches the
    comment block directly above; Python has its own parser and docstrings, and texts that the parser rejects are delimited by
    a lexer and indentation, so that damage costs the functions it lies in and not the file.  Comments and signatures are whole; the index's limits
    on their length don't hold here.  Functions whose documentation is
    empty or trivial are left out; null texts, null ids and other languages have none.  Texts don't travel.
    """
    texts = documents.where(F.col("file_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("file_id", "lang", "text")
    return spread(texts).mapInArrow(_lex_functions, f"file_id bigint, lang string, found array<struct<{_LEXED.replace(' string', ':string').replace(' int', ':int')}>>").select(
        "file_id", "lang", F.inline("found")
    )
