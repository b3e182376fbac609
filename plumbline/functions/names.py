"""Column expressions over paths, modules and callee names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File suffixes and their languages; the longest suffix wins.
LANGUAGE_OF_SUFFIX = {
    ".py": "python", ".pyi": "python", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".go": "go",
}
#: Callee names that can't be symbols of a workspace.
NOISE_CALLEES = (
    "len print str int float bool list dict set tuple range enumerate zip isinstance issubclass super getattr setattr hasattr open sorted sum min max abs any all map filter"
    " repr type format next iter bytes id round reversed hash vars dir require log warn error info debug push pop join split slice splice forEach reduce toString keys values"
    " entries then catch finally append make new panic recover Printf Println Sprintf Errorf String Error"
).split()
CALL_KINDS = ("calls", "instantiates")
TYPE_KINDS = ("class", "interface", "struct", "enum", "type")
CONTAINER_KINDS = ("class", "interface", "struct", "enum")


def language_of(path: Column) -> Column:
    """Language by suffix; null for other files."""
    out = F.lit(None).cast("string")
    for suffix, lang in sorted(LANGUAGE_OF_SUFFIX.items(), key=lambda x: len(x[0])):
        out = F.when(F.endswith(path, F.lit(suffix)), F.lit(lang)).otherwise(out)
    return out


def is_test_path(path: Column) -> Column:
    """A directory test, spec, __tests__ or fixtures, or a stem test_*, *_test, *.test, *.spec or *_spec."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return path.rlike(r"(^|/)(test|spec|__tests__|fixtures)/") | stem.rlike(r"^test_|_test$|\.test$|\.spec$|_spec$")


def module_key(path: Column, lang: Column) -> Column:
    """The module a file makes: dotted for Python, path without suffix for scripts, directory for Go.

    Leading ``src`` segments are dropped while more than one is left; ``__init__`` and ``index`` stand for their directory.
    """
    bare = F.regexp_replace(path, r"^(src/)+(?=[^/])", "")
    stem = F.regexp_replace(bare, r"(\.d)?\.[^./]*$", "")
    folder = F.when(F.instr(bare, "/") > 0, F.regexp_replace(bare, r"/[^/]*$", "")).otherwise(F.lit("."))
    python = F.translate(F.regexp_replace(stem, r"(?<=.)/__init__$", ""), "/", ".")
    script = F.regexp_replace(stem, r"(?<=.)/index$", "")
    return F.when(lang == "python", python).when(lang == "go", folder).otherwise(script)


def normalise_callee(name: Column) -> Column:
    """A callee as written: cut at type arguments, without white space, one optional mark and outer parentheses."""
    s = F.regexp_replace(F.substring_index(name, "<", 1), r"\s+", "")
    s = F.regexp_replace(s, r"\?$", "")
    return F.regexp_replace(F.regexp_replace(s, r"^\(", ""), r"\)$", "")


def tail_of(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def receiver_of(name: Column) -> Column:
    """Everything before the last dot; null without one."""
    return F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*$", ""))


def local_qualname(qualname: Column) -> Column:
    """What follows the first colon."""
    return qualname.substr(F.instr(qualname, ":") + F.lit(1), F.length(qualname))


def plain_rank(rank: Column) -> Column:
    """Null and NaN ranks are 0, the rank of a symbol that was never ranked."""
    return F.coalesce(F.nanvl(rank, F.lit(0.0)), F.lit(0.0))


def like(column: Column, pattern: str) -> Column:
    """Case-insensitive LIKE in which a backslash is an ordinary character and % and _ of the user's text are live."""
    return column.ilike(pattern.replace("\\", "\\\\"))
