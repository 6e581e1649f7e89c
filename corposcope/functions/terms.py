"""Search terms and identifier runs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, java_quote, pin

# Words that are never indexed.
STOP_WORDS = [
    "a", "an", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "of", "on",
    "or", "the", "this", "that", "to", "we", "with", "you", "when", "where", "what", "how",
    "why", "find", "focus", "include", "fix", "add", "change", "update", "code", "file",
    "files", "result", "results", "source", "tests", "tool", "tools",
]

# A run of word characters, dots and dashes that starts with a letter or
# underscore and is two long at least once trailing dots and dashes are gone.
TERM_PATTERN = r"[A-Za-z_][A-Za-z0-9_.-]*[A-Za-z0-9_]"

# Characters that continue an identifier (class body of a Java regex).
IDENTIFIER_CLASS = (
    r"_$a-zA-Z0-9\p{IsAlphabetic}\p{N}\x{200C}\x{200D}\x{0300}-\x{036F}\x{1AB0}-\x{1AFF}"
    r"\x{1DC0}-\x{1DFF}\x{20D0}-\x{20FF}\x{FE20}-\x{FE2F}"
)


def query_terms(text: str) -> list[str]:
    """Sorted distinct terms of a request string (driver side)."""
    found = {m.lower() for m in re.findall(TERM_PATTERN, text)}
    return sorted(found - set(STOP_WORDS))


def _terms(c: Column) -> Column:
    # The extracted tokens are pure ASCII, so one lower() over their join is
    # the ASCII fold, and no per-element lambda is needed.
    joined = F.array_join(F.regexp_extract_all(c, F.lit(TERM_PATTERN), F.lit(0)), " ")
    skip = F.array(*[F.lit(w) for w in [*STOP_WORDS, ""]])
    return F.array_except(F.split(F.lower(joined), " "), skip)


def terms(c: Column | str) -> Column:
    return F.sort_array(_terms(col(c)))


def indexed_terms(content: Column, path: Column, symbol_names: Column) -> Column:
    """Terms of content, path and symbol names, plus the parts of compound terms."""

    def with_parts(whole: Column) -> Column:
        compound = F.filter(whole, lambda t: F.rlike(t, F.lit(r"[_.-]")))
        parts = _terms(F.translate(F.array_join(compound, " "), "_.-", "   "))
        return F.sort_array(F.array_union(whole, parts))

    text = F.concat_ws("\n", content, path, F.array_join(symbol_names, "\n"))
    return pin(_terms(text), with_parts)


def term_regex(term: str) -> str:
    """Regex for texts whose indexed terms include ``term`` (one of query_terms).

    A term is a run of word characters, dots and dashes without the digits, dots
    and dashes before its first letter and the dots and dashes after its end.  A
    term without separators may also be a part of a compound one: there, a run
    of letters and digits without its leading digits.
    """
    body = java_quote(term)
    if re.search(r"[_.-]", term):
        return rf"(?i)(?<![A-Za-z0-9_.-])[0-9.-]*{body}[.-]*(?![A-Za-z0-9_.-])"
    return rf"(?i)(?<![A-Za-z0-9])[0-9]*{body}(?![A-Za-z0-9])"
