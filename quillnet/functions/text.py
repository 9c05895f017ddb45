"""Column functions for sentences, tokens and company names; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of article, company suffix and sentence end.
ARTICLE = "^([Tt][Hh][Ee] )+(.*)$"
SUFFIX = r"^(.*?)( (, )?(((& ?|and )?[Cc]o(mpany| ?\.)?)|[^ ]{1,5}( ?\.)|[A-Z]{2,5}))+$"
SENTENCE = r"\r?\n\s*"
#: Escapes of tokens, in the order in which they are resolved.
ESCAPES = (("\\*", "*"), ("\\/", "/"), ("-LRB-", "("), ("-RRB-", ")"), ("-LSB-", "["), ("-RSB-", "]"), ("-LCB-", "{"), ("-RCB-", "}"), ("``", '"'), ("''", '"'), ("`", "'"))
#: Punctuation that names lose, in order, with what takes its place.
MARKS = ((",", ""), ("-", ""), ("'", ""), ("/", ""), ("&", " and "))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_sentences(text: Column | str) -> Column:
    return F.split(_c(text), SENTENCE, -1)


def split_tokens(sentence: Column | str) -> Column:
    return F.split(_c(sentence), " ", -1)


def unescape_token(token: Column | str) -> Column:
    out = _c(token)
    for old, new in ESCAPES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def join_slice(tokens: Column | str, start: Column, stop: Column) -> Column:
    """Tokens start..stop-1 (0-based, clamped) joined by spaces."""
    t = _c(tokens)
    size = F.least(stop, F.size(t)) - start
    return F.when(size > 0, F.array_join(F.slice(t, start + 1, F.greatest(size, F.lit(1))), " ")).otherwise(F.lit(""))


def strip_prefix(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), ARTICLE, "$2")


def strip_suffix(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), SUFFIX, "$1")


def strip_punct(name: Column | str, periods: bool = False) -> Column:
    out = _c(name)
    for mark, new in (*MARKS, *(((".", ""),) if periods else ())):
        q = "\\" + mark if mark == "." else mark
        out = F.regexp_replace(F.regexp_replace(out, f" {q}$", new.rstrip()), f"^{q} ", new.lstrip())
        out = F.regexp_replace(out, rf"( |){q}\1", new or "$1")
    return out


def is_important(token: Column | str) -> Column:
    return _c(token).rlike("^[A-Z].*$")


def next_capital(text: Column | str, start: int = 0) -> Column:
    """0-based place of the first capital letter at or after ``start``, or -1."""
    rest = F.substring(_c(text), start + 1, 1 << 30)
    at = F.regexp_instr(rest, F.lit(r"\p{Lu}"))
    return F.when(at > 0, at - 1 + start).otherwise(F.lit(-1))


def fold(surface: Column | str) -> Column:
    return F.lower(_c(surface))
