"""Nested intervals of one row, sorted once and folded with a stack of open ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def smallest_around(spans: list[tuple[int, int, str]]) -> list[str | None]:
    """For each (start, end, name) the name of the smallest strictly larger interval that
    contains it; of equal ones the smallest name.

    In the order of start, then of size, the intervals that can contain the next one are
    those still open.  Nested intervals leave the answer on top of the stack, so the
    fold is linear after the sort.  Beside each open interval stands the least end up to
    it: where that is no less than the end of the answer, nothing below is smaller.
    """
    out: list[str | None] = [None] * len(spans)
    stack: list[tuple[int, int, str]] = []
    least: list[int] = []
    order = sorted(range(len(spans)), key=lambda i: (spans[i][0], -spans[i][1], spans[i][2]))
    for i in order:
        start, end, _ = spans[i]
        while stack and stack[-1][1] < start:
            stack.pop()
            least.pop()
        best: tuple[int, str] | None = None
        found = (0, 0)
        for k in range(len(stack) - 1, -1, -1):
            a, b, name = stack[k]
            if best is not None and least[k] >= found[1] and (a, b) != found:
                break
            if b >= end and (a < start or b > end) and (best is None or (b - a, name) < best):
                best, found = (b - a, name), (a, b)
        out[i] = best[1] if best else None
        stack.append(spans[i])
        least.append(min(end, least[-1]) if least else end)
    return out


def owner_names(spans: Column) -> Column:
    """Array of ``smallest_around`` over an array of structs (start_line, end_line, name)."""

    @F.pandas_udf("array<string>")
    def fold(rows: pd.Series) -> pd.Series:
        return rows.map(lambda own: smallest_around([(s["start_line"], s["end_line"], s["name"]) for s in own]) if own is not None else None)

    return fold(spans)
