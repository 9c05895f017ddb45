"""Readers of annotated markup and of coreference files.

Mixed content needs a real parser, so whole files go through expat in Arrow
batches, one file a row.  A broken document becomes a row with ``error``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ESCAPES
from ..operators import sanitize

CORPORATION = "ORGANIZATION:CORPORATION"
DOCS = "path string, doc string, sentences array<array<string>>, entities array<struct<type:string,sentence:int,start:int,stop:int>>, error string"
_NAME = re.compile(r"<DOCNO>([^<]*)</DOCNO>")
_SENTENCE = re.compile(r"\r?\n\s*")


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of every file of a folder but the coreference files."""
    files = spark.read.text(f"{folder}/*", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return files.where(~F.col("path").endswith(".pron"))


class _Document:
    """Sentences of tokens, to which chunks of text are glued."""

    def __init__(self) -> None:
        self.sentences: list[list[str]] = []
        self.entities: list[tuple] = []

    def add(self, chunk: str) -> None:
        if not self.sentences or self.sentences[-1] == [""]:
            chunk = chunk.lstrip("".join(map(chr, range(33))))
        parts = []
        for line in _SENTENCE.split(chunk):
            tokens = line.split(" ")
            for old, new in ESCAPES:
                tokens = [t.replace(old, new) for t in tokens]
            parts.append(tokens)
        if self.sentences:  # the last token goes on
            head = parts.pop(0)
            self.sentences[-1][-1] += head[0]
            self.sentences[-1] += head[1:]
        self.sentences += parts

    def place(self) -> tuple[int, int]:
        return (len(self.sentences) - 1, len(self.sentences[-1]) - 1) if self.sentences else (0, 0)

    def end(self) -> None:
        if not self.sentences or self.sentences.pop() != [""]:
            raise ValueError("text does not end with a line end")
        if any(s == [""] for s in self.sentences):
            raise ValueError("empty sentence")


def parse_markup(content: str) -> list[tuple[str, list, list]]:
    """(name, sentences, entities) of each DOC of a ROOT; entities in order of their ends, ``stop`` counted from the first sentence."""
    out, path, opened = [], [], []
    text: list[str] = []
    name, doc = "", _Document()

    def flush() -> None:
        if text:
            doc.add("".join(text))
            text.clear()

    def start(tag: str, attrs: dict) -> None:
        nonlocal doc, name
        allowed = {0: ("ROOT",), 1: ("DOC",)}.get(len(path), ("DOCNO", "ENAMEX", "TIMEX", "NUMEX"))
        if tag not in allowed or (path and path[-1] == "DOCNO"):
            raise ValueError(f"unexpected {tag}")
        path.append(tag)
        if tag == "DOC":
            doc, name = _Document(), ""
        elif tag == "DOCNO":
            flush()
        elif tag == "ENAMEX":
            flush()
            opened.append((attrs.get("TYPE", ""), *doc.place()))

    def stop(tag: str) -> None:
        nonlocal name
        path.pop()
        if tag == "DOCNO":
            name = "".join(text).strip()
            text.clear()
        elif tag == "ENAMEX":
            kind, sentence, first = opened.pop()
            if kind == CORPORATION:
                flush()
                if not doc.sentences:
                    doc.add("")
                last = sum(map(len, doc.sentences[sentence:]))
                doc.entities.append((kind, sentence, first, last))
        elif tag == "DOC":
            flush()
            doc.end()
            out.append((name, doc.sentences, doc.entities))

    def data(chars: str) -> None:
        if len(path) > 1:
            text.append(chars)
        elif chars.strip():
            raise ValueError("text outside of a document")

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, stop, data
    parser.Parse(content, True)
    return out


def parse_apart(content: str) -> Iterator[tuple[str | None, list | None, list | None, str | None]]:
    """(name, sentences, entities, error) of each document; those of a file that fails as a whole are parsed one by one."""
    try:
        yield from [(*d, None) for d in parse_markup(content)]
        return
    except (expat.ExpatError, ValueError) as e:
        error = str(e)
    failed = False
    for start, stop in sanitize.document_spans(content):
        piece = content[start:stop]
        try:
            yield from [(*d, None) for d in parse_markup(f"<ROOT>{piece}</ROOT>")]
        except (expat.ExpatError, ValueError) as e:
            failed = True
            name = _NAME.search(piece)
            yield name and name[1].strip(), None, None, str(e)
    if not failed:  # what is wrong lies outside of the documents
        yield None, None, None, error


def parse_documents(files: DataFrame) -> DataFrame:
    """One row per document of files (path, content); a document that fails gives a row with ``error``, as does a file without any or with an error outside of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                for name, sentences, entities, error in parse_apart(content or ""):
                    found = None if entities is None else [dict(zip(("type", "sentence", "start", "stop"), e, strict=True)) for e in entities]
                    rows.append((path, name, sentences, found, error))
            yield pd.DataFrame(rows, columns=["path", "doc", "sentences", "entities", "error"])

    return files.select("path", "content").mapInPandas(run, DOCS)


def decode_range(text: Column) -> Column:
    """``S3:2-4`` (1-based, inclusive) as sentence 2, start 1, stop 4; null if malformed."""
    part = lambda k: F.regexp_extract(text, r"^S(\d+):(\d+)-(\d+)$", k).cast("int")
    ok = text.rlike(r"^S\d+:\d+-\d+$")
    return F.when(ok, F.struct((part(1) - 1).alias("sentence"), (part(2) - 1).alias("start"), part(3).alias("stop")))


CHAINS = "doc string, chain int, role string, range string, val string, error string"
_ENTRY = re.compile(r"\s*(Antecedent|Pronoun)\s*->\s*(\S+)\s*->\s?(.*?)\s*$")


_PART = re.compile(r"\s*([()])|\s*([^()\n]*[^()\s][^()\n]*)|\s*\Z")
_REST = re.compile(r"\s*([^\n]*)")


def parse_chains(content: str) -> Iterator[tuple]:
    """(doc, chain, role, range, value) of a coreference file: parentheses around documents and chains, wherever they stand; an entry ends with its line.

    Parentheses that an entry's text does not open close what is around it.
    """
    at, depth, doc, chain = 0, 0, "", -1
    while at < len(content):
        m = _REST.match(content, at) if depth == 2 and not re.match(r"\s*[()]", content[at : at + 4096]) else None
        if m is None:
            m = _PART.match(content, at)
            sign = m[1]
            at = m.end()
            if sign == "(":
                depth += 1
                doc, chain = ("", -1) if depth == 1 else (doc, chain + 1)
                if depth > 2:
                    raise ValueError(f"offset {at}: too deep")
            elif sign == ")":
                depth -= 1
                if depth < 0:
                    raise ValueError(f"offset {at}: nothing to close")
                if depth == 0 and chain < 0:
                    yield doc, None, None, None, None  # a document without chains is kept
            elif m[2] and depth == 1 and not doc:
                doc = m[2].strip()
            elif m[2]:
                raise ValueError(f"offset {at}: stray text")
            continue
        entry, at = m[1].rstrip(), m.end()
        spare = max(entry.count(")") - entry.count("("), 0)
        while spare and entry.endswith(")"):
            entry, spare, at = entry[:-1].rstrip(), spare - 1, at
            depth -= 1
        if not entry:
            continue
        if not (found := _ENTRY.match(entry)):
            raise ValueError(f"offset {at}: no entry")
        if depth < 0:
            raise ValueError(f"offset {at}: nothing to close")
        yield doc, chain, found[1], found[2], found[3]
    if depth:
        raise ValueError("a parenthesis is not closed")


def read_chains(files: DataFrame) -> DataFrame:
    """Entries of coreference files (path, content), with decoded ranges; of a document that comes twice, all entries are kept apart by file order upstream."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for content in frame["content"]:
                try:
                    rows += [(*r, None) for r in parse_chains(content or "")]
                except ValueError as e:
                    rows.append((None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc", "chain", "role", "range", "val", "error"]).astype({"chain": "Int32"})

    return files.select("content").mapInPandas(run, CHAINS).withColumn("span", decode_range(F.col("range")))
