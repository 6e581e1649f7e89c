"""Positions in code units: (line, column) of UTF-8, UTF-16 or UTF-32 to characters and back.

Lines and columns start at 0; a line ends before its LF.  A column inside a character or
behind the end of its line is no position (null).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError
from .text import running_offsets

# Charset and bytes of a unit.
ENCODINGS = {"utf-8": ("UTF-8", 1), "utf-16": ("UTF-16BE", 2), "utf-32": ("UTF-32", 4)}


def check_encoding(encoding: str) -> str:
    if encoding not in ENCODINGS:
        raise EngineError("INVALID_REQUEST", "encoding must be utf-8, utf-16 or utf-32", encoding=encoding)
    return encoding


def characters_before(line: Column, column: Column, encoding: str) -> Column:
    """How many characters of ``line`` lie before ``column`` code units."""
    charset, width = ENCODINGS[check_encoding(encoding)]
    if encoding == "utf-32":
        return F.when((column >= 0) & (column <= F.length(line)), column)
    units = F.encode(line, charset)
    lead = F.hex(F.substring(units, column * width + 1, F.lit(1)))
    # Not inside a character: no trail byte, no low surrogate.
    whole = ~lead.between("80", "BF") if encoding == "utf-8" else ~lead.between("DC", "DF")
    inside = (column >= 0) & (column * width <= F.octet_length(units))
    return F.when(inside & whole, F.length(F.decode(F.substring(units, F.lit(1), column * width), charset)))


def units_before(line: Column, characters: Column, encoding: str) -> Column:
    """How many code units the first ``characters`` of ``line`` have."""
    charset, width = ENCODINGS[check_encoding(encoding)]
    head = F.when((characters >= 0) & (characters <= F.length(line)), F.substring(line, F.lit(1), characters))
    return (F.octet_length(F.encode(head, charset)) / width).cast("int")


def line_table(content: str = "content") -> Column:
    """Per line its text and the characters before it, in one pass over the lines."""
    pieces = f"split({content}, '\\n', -1)"
    starts = running_offsets(pieces, "0", "length(x) + 1")
    return F.expr(f"arrays_zip({pieces}, {starts})").cast("array<struct<text:string,start:int>>")
