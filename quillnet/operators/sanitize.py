"""Repair of malformed markup, by class of problem, until a real parser accepts the file or a bound is met."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 100
FRAGMENTS, AND, TAG_MISMATCH, CUT_OFF, OTHER = "FRAGMENTS", "AND", "TAG_MISMATCH", "CUT_OFF", "OTHER"
_TAG = re.compile(r"(?s:<!--.*?-->|<!\[CDATA\[.*?\]\]>)|<(/?)([A-Za-z_][\w.:-]*)[^<>]*?(/?)>")
_AMP = re.compile(r"&(?!#?\w+;)")
_DOC = re.compile(r"<DOC(?=[\s>]).*?(?=<DOC[\s>]|\Z)", re.S)
_DOC_END = re.compile(r"(?s:.*</DOC\s*>)")
_TAIL = re.compile(r"\s*</ROOT\s*>?\s*\Z")


def find_problem(content: str) -> tuple[str, int, int] | None:
    """(class, line, column) of the first problem, or None if the content is well formed."""
    parser = expat.ParserCreate()
    try:
        parser.Parse(content, True)
        return None
    except expat.ExpatError as e:
        code, at = expat.errors.codes, (e.lineno, e.offset)
        kind = {code[expat.errors.XML_ERROR_JUNK_AFTER_DOC_ELEMENT]: FRAGMENTS, code[expat.errors.XML_ERROR_TAG_MISMATCH]: TAG_MISMATCH, code[expat.errors.XML_ERROR_UNCLOSED_TOKEN]: CUT_OFF}.get(e.code)
        if kind is None and e.code in (code[expat.errors.XML_ERROR_INVALID_TOKEN], code[expat.errors.XML_ERROR_UNDEFINED_ENTITY], code[expat.errors.XML_ERROR_BAD_CHAR_REF]):
            kind = AND if _AMP.search(content) else None
        return (kind or OTHER, *at)


def fix_fragments(content: str) -> str:
    body = content.rstrip()
    return f"<ROOT>{content}</ROOT>{content[len(body):]}"


def fix_and(content: str) -> str:
    return _AMP.sub("&amp;", content)


def fix_tag_mismatch(content: str) -> str:
    """Each closing tag that does not fit gets the name of the element that is open."""
    stack: list[str] = []
    out, at = [], 0
    for m in _TAG.finditer(content):
        if not m[2]:
            continue
        if not m[1]:
            stack += [] if m[3] else [m[2]]
        elif stack:
            name = stack.pop()
            if name != m[2]:
                out += [content[at : m.start()], f"</{name}>"]
                at = m.end()
    return "".join(out) + content[at:]


def fix_cut_off(content: str) -> str:
    body = content.rstrip()
    return f"{body}>{content[len(body):]}"


_FIXES = {FRAGMENTS: fix_fragments, AND: fix_and, TAG_MISMATCH: fix_tag_mismatch, CUT_OFF: fix_cut_off}


def document_spans(content: str) -> list[tuple[int, int]]:
    """Where each document stands, whether the file is well formed or not: from its DOC to the last DOC end before the next."""
    out = []
    for m in _DOC.finditer(content):
        end = _DOC_END.match(m[0])
        out.append((m.start(), m.start() + (end.end() if end else len(_TAIL.sub("", m[0])))))
    return out


def _rounds(content: str, rounds: int) -> tuple[str, str, list[str]]:
    done: list[str] = []
    for _ in range(rounds):
        if (problem := find_problem(content)) is None:
            return content, "clean", done
        fix = _FIXES.get(problem[0])
        new = fix(content) if fix else content
        if new == content:
            return content, "unfixable", done
        content = new
        done.append(problem[0])
    return content, "bound" if find_problem(content) else "clean", done


def repair(content: str, rounds: int = ROUNDS) -> tuple[str, str, list[str]]:
    """Repaired content, status (clean, unfixable or bound), and the classes that were repaired, in order.

    In a file that does not get clean, each of its documents is repaired by itself, and those that do not get clean stay as they are.
    """
    new, status, done = _rounds(content, rounds)
    spans = document_spans(content) if status != "clean" else []
    if len(spans) < 2:
        return new, status, done
    out, done, at = [], [], 0
    for start, stop in spans:
        mended, state, fixed = _rounds(content[start:stop], rounds)
        if state == "clean":
            out += [content[at:start], mended]
            done += fixed
            at = stop
    return "".join(out) + content[at:], status, done


def classify(files: DataFrame) -> DataFrame:
    """path, type, line, col of each file's first problem (nulls: well formed)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [find_problem(c or "") or (None, None, None) for c in f["content"]]
            yield pd.DataFrame({"path": f["path"], "type": [p[0] for p in found], "line": pd.array([p[1] for p in found], "Int32"), "col": pd.array([p[2] for p in found], "Int32")})

    return files.select("path", "content").mapInPandas(run, "path string, type string, line int, col int")


def repair_markup(files: DataFrame, max_rounds: int = ROUNDS) -> DataFrame:
    """path, content, status, repairs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [repair(c or "", max_rounds) for c in f["content"]]
            yield pd.DataFrame({"path": f["path"], "content": [x[0] for x in found], "status": [x[1] for x in found], "repairs": [x[2] for x in found]})

    return files.select("path", "content").mapInPandas(run, "path string, content string, status string, repairs array<string>")


def escape_ampersands(text: Column) -> Column:
    """The AND repair as a column: each ampersand that begins no reference is escaped."""
    return F.regexp_replace(F.regexp_replace(text, "&", "&amp;"), r"&amp;(#?\w+;)", "&$1")


def wrap_fragments(text: Column) -> Column:
    """The FRAGMENTS repair as a column."""
    return F.concat(F.lit("<ROOT>"), text, F.lit("</ROOT>"), F.regexp_extract(text, r"\s*$", 0))
