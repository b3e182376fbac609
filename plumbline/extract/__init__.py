"""Definitions, uses and imports of a source file, one extractor per language.

An extractor takes (path, text) and returns :class:`Facts`; :func:`register` adds a language.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

#: Limits of the index tables (:func:`indexed`); extractors return everything.
SIGNATURE_LENGTH = 220
DOCSTRING_LENGTH = 500
MAX_COMMENTS = 12
MAX_REFS = 20_000


@dataclass
class Definition:
    name: str
    local: str  # dotted chain of the enclosing definitions and the name
    kind: str
    start_line: int
    end_line: int
    signature: str
    docstring: str | None
    parent: str | None
    exported: bool
    nearest: str | None = None  # documentation of the last MAX_COMMENTS comments, where there are more


@dataclass
class Facts:
    symbols: list[Definition] = field(default_factory=list)
    refs: list[tuple] = field(default_factory=list)  # (src_local, dst_name, kind, line)
    imports: list[tuple] = field(default_factory=list)  # (raw, module, symbol, alias, line)


Extractor = Callable[[str, str], Facts]
_EXTRACTORS: dict[str, Extractor] = {}


def register(lang: str, extractor: Extractor) -> None:
    """Make ``lang`` extractable; the last registration holds."""
    _EXTRACTORS[lang] = extractor


def extractor_for(lang: str) -> Extractor | None:
    from plumbline.extract import braces, pyfacts  # noqa: F401  they register themselves

    return _EXTRACTORS.get(lang)


def shorten(text: str, size: int) -> str:
    return text if len(text) <= size else text[: size - 1].rstrip() + "…"


def signature_of(source: str) -> str:
    """One line, without what opens the body."""
    return re.sub(r"\s+", " ", source).strip().rstrip("{:=> ").rstrip()


def clean_doc(text: str) -> str | None:
    """Comment signs and indentation away; null if nothing is left."""
    lines = []
    for line in text.splitlines():
        s = line.strip()
        s = re.sub(r"^(/\*+!?|\*/|\*+|//+!?|#+)\s?", "", s)
        lines.append(re.sub(r"\s*\*/$", "", s).rstrip())
    out = "\n".join(lines).strip()
    return out or None


def docs_of(comments: list[str]) -> tuple[str | None, str | None]:
    """``docstring`` and ``nearest`` of a comment block, first comment first."""
    return clean_doc("\n".join(comments)), (clean_doc("\n".join(comments[-MAX_COMMENTS:])) or "") if len(comments) > MAX_COMMENTS else None


def indexed(d: Definition) -> Definition:
    """A definition within the limits of the index tables."""
    doc = d.docstring if d.nearest is None else d.nearest
    return replace(d, signature=shorten(d.signature, SIGNATURE_LENGTH), docstring=shorten(doc, DOCSTRING_LENGTH) if doc else None, nearest=None)


def keep_refs(refs: list[tuple], most: int = MAX_REFS) -> list[tuple]:
    """Each (owner, callee, kind, line) once, of the first ``most`` of a file, without noise callees."""
    from plumbline.functions.names import NOISE_CALLEES

    noise, seen, out = set(NOISE_CALLEES), set(), []
    for src, dst, kind, line in refs[:most]:
        if (src, dst, kind, line) in seen:
            continue
        seen.add((src, dst, kind, line))
        name = re.sub(r"\s+", "", dst.split("<", 1)[0])
        name = re.sub(r"\)$", "", re.sub(r"^\(", "", re.sub(r"\?$", "", name)))
        if name and name.rsplit(".", 1)[-1] not in noise:
            out.append((src, name, kind, line))
    return out


def specific(symbols: list[Definition]) -> list[Definition]:
    """A definition that was recognised twice keeps its most specific kind."""
    weight = {"type": 1, "const": 1, "function": 2, "method": 3, "enum": 4, "interface": 5, "struct": 5, "class": 5}
    best: dict[tuple, Definition] = {}
    for s in symbols:
        key = (s.local, s.start_line, s.end_line)
        if key not in best or weight[s.kind] > weight[best[key].kind]:
            best[key] = s
    return list(best.values())
