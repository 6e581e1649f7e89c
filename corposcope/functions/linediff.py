"""Line diffs of a before/after pair as Arrow UDFs."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAT_TYPE = T.StructType([T.StructField("added", T.IntegerType()), T.StructField("removed", T.IntegerType())])


def _lf_lines(value: str) -> list[str]:
    pieces = value.split("\n")
    out = [p + "\n" for p in pieces[:-1]]
    return out + [pieces[-1]] if pieces[-1] else out


def _text(value) -> str:
    return value if isinstance(value, str) else ""


def _render(path: str, before, after) -> str:
    a, b = _lf_lines(_text(before)), _lf_lines(_text(after))
    out = []

    def put(sign: str, line: str) -> None:
        out.append(sign + line if line.endswith("\n") else f"{sign}{line}\n\\ No newline at end of file\n")

    def span(start: int, end: int) -> str:
        """Lines start..end of a side as a hunk header counts them."""
        return f"{start + 1}" if end - start == 1 else f"{start + (end > start)},{end - start}"

    for group in difflib.SequenceMatcher(None, a, b, autojunk=False).get_grouped_opcodes(3):
        if not out:
            out.append(f"--- a/{path}\n+++ b/{path}\n")
        out.append(f"@@ -{span(group[0][1], group[-1][2])} +{span(group[0][3], group[-1][4])} @@\n")
        for tag, i1, i2, j1, j2 in group:
            if tag == "equal":
                for line in a[i1:i2]:
                    put(" ", line)
                continue
            for line in a[i1:i2]:
                put("-", line)
            for line in b[j1:j2]:
                put("+", line)
    return "".join(out)


@F.pandas_udf(T.StringType())
def unified_diff(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(path, before, after) -> unified diff with three lines of context."""
    for path, before, after in batches:
        yield pd.Series([_render(*row) for row in zip(path, before, after)])


def _stat(before, after) -> tuple[int, int]:
    matcher = difflib.SequenceMatcher(None, _lf_lines(_text(before)), _lf_lines(_text(after)), autojunk=False)
    added = removed = 0
    for tag, i1, i2, j1, j2 in matcher.get_opcodes():
        if tag != "equal":
            removed, added = removed + i2 - i1, added + j2 - j1
    return added, removed


@F.pandas_udf(STAT_TYPE)
def diff_stat(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """(before, after) -> lines added and removed."""
    for before, after in batches:
        yield pd.DataFrame([_stat(*row) for row in zip(before, after)], columns=["added", "removed"])
