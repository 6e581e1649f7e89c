"""All literals of a request in one pass over a text (Aho-Corasick), as line numbers."""

from __future__ import annotations

import array
import functools

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _octets(value: str, case_sensitive: bool) -> str:
    """UTF-8, one character per byte; the insensitive form folds A-Z only."""
    raw = value.encode("utf-8", "surrogatepass")
    return (raw if case_sensitive else raw.lower()).decode("latin-1")


@functools.lru_cache(maxsize=8)
def _automaton(patterns: tuple[str, ...], case_sensitive: bool) -> ahocorasick.Automaton:
    """Built once per worker and request; equal patterns share a state."""
    found = ahocorasick.Automaton()
    numbers: dict[str, list[int]] = {}
    for i, p in enumerate(patterns):
        if p and "\n" not in p:
            numbers.setdefault(_octets(p, case_sensitive), []).append(i)
    for octets, own in numbers.items():
        found.add_word(octets, own)
    found.make_automaton()
    return found


def lines_with(content: str, patterns: tuple[str, ...], case_sensitive: bool) -> list[np.ndarray]:
    """For each pattern the numbers of the lines that hold it, ascending.  CR LF ends a
    line like LF; a pattern with an LF is in no line."""
    automaton = _automaton(patterns, case_sensitive)
    ends: list[list[int]] = [[] for _ in patterns]
    text = _octets(content.replace("\r\n", "\n"), case_sensitive)
    if len(automaton):
        for end, own in automaton.iter(text):
            for i in own:
                ends[i].append(end)
    if not any(ends):
        return [np.zeros(0, np.int32)] * len(patterns)
    breaks = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 10)
    return [np.unique(np.searchsorted(breaks, e) + 1).astype(np.int32) for e in ends]


def line_hits(content: Column, patterns: list[str], case_sensitive: bool) -> Column:
    """Array, by pattern, of arrays of line numbers; null content holds nothing.

    The texts of a batch are taken one by one and their line numbers kept in one buffer.
    A test of the result would be pushed below it and compute it a second time,
    which Spark does not do for an expression that is not called deterministic.
    """
    given = tuple(patterns)

    @F.arrow_udf("array<array<int>>")
    def scan(texts: pa.Array) -> pa.Array:
        numbers, ends = array.array("i"), array.array("i", [0])
        for t in texts:
            for lines in lines_with(t.as_py() or "", given, case_sensitive):
                numbers.frombytes(lines.tobytes())
                ends.append(len(numbers))
        by_pattern = pa.ListArray.from_arrays(pa.array(np.asarray(ends, np.int32)), pa.array(np.asarray(numbers, np.int32)))
        rows = np.arange(len(texts) + 1, dtype=np.int32) * len(given)
        return pa.ListArray.from_arrays(pa.array(rows), by_pattern)

    return scan.asNondeterministic()(content)
