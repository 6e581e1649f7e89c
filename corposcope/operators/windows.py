"""Context windows over matches, built inside one row.

A file's matches, the windows around them and their per-file caps all come from
one row of the corpus, so no exchange is needed before the final top-k.  The
admission limit on file size bounds the work of a row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.sqltext import bind


def merge_lines(matches: str, context: int, count: str) -> Column:
    """Windows (line, start_line, end_line) around ascending match lines.

    ``matches`` and ``count`` name columns.  Two neighbours share a window when
    their ranges touch or overlap; a window keeps the line of its first match.
    """

    def start(m: str) -> str:
        return f"greatest({m} - {context}, 1)"

    def end(m: str) -> str:
        return f"least({m} + {context}, {count})"

    heads = f"filter(m, (x, i) -> i = 0 OR {start('x')} > {end('element_at(m, i)')} + 1)"
    tails = f"filter(m, (x, i) -> i = size(m) - 1 OR {start('element_at(m, i + 2)')} > {end('x')} + 1)"
    rows = (
        f"transform(h, (x, i) -> named_struct('line', x, 'start_line', {start('x')}, "
        f"'end_line', {end('element_at(t, i + 1)')}))"
    )
    return F.expr(bind(matches, "m", bind(heads, "h", bind(tails, "t", rows))))
