"""Text-coordinate expressions: lines, slices, byte budgets, line endings.

Everything here is a column expression; nothing leaves the JVM.  A *line* ends
at LF, loses one CR directly before that LF, and a trailing LF opens no extra
line.  Lines are numbered from 1 and ranges include both ends.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_JAVA_META = re.compile(r"([\\.\[\]{}()<>*+\-=!?^$|#&~\s])")

# ESC [ ... final byte, ESC ] ... (BEL | ESC \), or ESC plus one character.
_ANSI = (
    r"(?s)\x1b(?:\[[^@-~]*+(?:[@-~]|\z)"
    r"|\](?:[^\x07\x1b]++|\x1b++[^\\\x1b])*+(?:\x07|\x1b++\\|\x1b*+\z)"
    r"|[^\[\]]|\z)"
)

# Fixed value: text that ends a truncated output.
TRUNCATION_MARKER = "\n… output truncated …"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pin(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once and kept out of the generated
    code of its uses (a one-element transform)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def java_quote(text: str) -> str:
    """Escape ``text`` so that a Java regex matches it literally."""
    return _JAVA_META.sub(r"\\\1", text)


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z only; other scripts stay as they are."""
    return F.translate(col(c), string.ascii_uppercase, string.ascii_lowercase)


def ascii_lower_py(text: str) -> str:
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def contains_literal(c: Column | str, needle: str, case_sensitive: bool) -> Column:
    """Substring test; the insensitive form folds A-Z only.

    Java's ``(?i)`` without ``(?u)`` folds US-ASCII, so the insensitive test
    needs no lower-cased copy of the text.
    """
    if case_sensitive:
        return F.contains(col(c), F.lit(needle))
    return F.rlike(col(c), F.lit("(?i)" + java_quote(needle)))


def parts(c: Column | str) -> Column:
    """LF-separated pieces (CR LF counts as LF); the last may be a non-line."""
    return F.split(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), "\n", -1)


def lines_of(pieces: Column | str, c: Column | str) -> Column:
    """The lines among ``parts``: all but an empty piece after a final LF.

    ``pieces`` should be a column of its own: it is read twice here, and higher
    order functions evaluate their input without common-subexpression reuse.
    """
    pieces, c = col(pieces), col(c)
    extra = F.when(c.endswith("\n") | (c == ""), F.lit(1)).otherwise(F.lit(0))
    return F.slice(pieces, F.lit(1), F.size(pieces) - extra)


def with_lines(df: DataFrame, content: str = "content", name: str = "lines", only: Column | None = None) -> DataFrame:
    """Add the array of lines of ``content``, split once per row.

    With ``only``, rows that fail it get null instead, at the cost of the test.
    """
    pieces = parts(content) if only is None else F.when(only, parts(content))
    df = df.withColumn("_parts", pieces)
    return df.withColumn(name, lines_of("_parts", content)).drop("_parts")


def split_lines(c: Column | str) -> Column:
    """Lines of ``c`` as one expression, for the few rows of a final result."""
    return lines_of(parts(c), c)


def line_count(c: Column | str) -> Column:
    """max(1, number of lines), without splitting."""
    c = col(c)
    breaks = F.octet_length(c) - F.octet_length(F.replace(c, F.lit("\n"), F.lit("")))
    return F.greatest(breaks + F.when(c.endswith("\n"), 0).otherwise(1), F.lit(1))


def join_lines(lines: Column | str, start: Column | int, end: Column | int) -> Column:
    """Lines start..end joined by LF; blank lines at the head are not kept."""
    start = F.lit(start) if isinstance(start, int) else start
    end = F.lit(end) if isinstance(end, int) else end
    first = F.greatest(start, F.lit(1))
    length = F.greatest(end, first) - first + F.lit(1)
    return F.ltrim(F.array_join(F.slice(col(lines), first, length), "\n"), F.lit("\n"))


def running_offsets(items: str, before: str, width: str) -> str:
    """SQL: offset of each item ``x`` = all earlier gaps and widths plus its gap.

    The fold collects offsets as text, because growing an array inside
    ``aggregate`` copies boxed elements at every step.
    """
    return (
        f"aggregate({items}, named_struct('out', '', 'at', 0), "
        f"(acc, x) -> named_struct('out', concat(acc.out, cast(acc.at + {before} AS string), ' '), "
        f"'at', acc.at + {before} + {width}), "
        "acc -> if(acc.out = '', cast(array() AS array<int>), cast(split(rtrim(acc.out), ' ') AS array<int>)))"
    )


def preview(start: str, end: str, content: str = "content") -> str:
    """SQL: lines start..end of ``content``, for a window that lies within it."""
    pieces = f"split(replace({content}, '\\r\\n', '\\n'), '\\n', -1)"
    return f"ltrim('\\n', array_join(slice({pieces}, {start}, {end} - {start} + 1), '\\n'))"


def line_starts(raw_lines: str) -> str:
    """SQL: byte offset of each LF-separated piece (``raw_lines`` keeps CR)."""
    return running_offsets(raw_lines, "0", "octet_length(x) + 1")


def line_ending(c: Column | str) -> Column:
    """none / crlf / lf / mixed; a CR without LF makes the text mixed."""

    def label(t: Column) -> Column:
        n = F.octet_length(t)
        pairs = n - F.octet_length(F.replace(t, F.lit("\r\n"), F.lit("\r")))
        lf = n - F.octet_length(F.replace(t, F.lit("\n"), F.lit("")))
        cr = n - F.octet_length(F.replace(t, F.lit("\r"), F.lit("")))
        return (
            F.when((lf == 0) & (cr == 0), "none")
            .when((lf == pairs) & (cr == pairs), "crlf")
            .when(cr == 0, "lf")
            .otherwise("mixed")
        )

    return pin(col(c), label)


def to_line_ending(text: Column, label: Column) -> Column:
    """Rewrite the line ends of ``text`` to those named by ``label``."""

    def rewrite(x: Column) -> Column:
        lf = F.replace(F.replace(x["text"], F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
        return (
            F.when(x["label"] == "crlf", F.replace(lf, F.lit("\n"), F.lit("\r\n")))
            .when(x["label"] == "lf", lf)
            .otherwise(x["text"])
        )

    return pin(F.struct(text.alias("text"), label.alias("label")), rewrite)


def keep_terminal_newline(selected: Column, replacement: Column) -> Column:
    """End ``replacement`` as ``selected`` ended, unless it is empty or ends in LF."""
    return (
        F.when((replacement == "") | replacement.endswith("\n"), replacement)
        .when(selected.endswith("\r\n"), F.concat(replacement, F.lit("\r\n")))
        .when(selected.endswith("\n"), F.concat(replacement, F.lit("\n")))
        .otherwise(replacement)
    )


def char_boundary(utf8: Column, index: Column) -> Column:
    """Largest character boundary <= ``index`` in UTF-8 bytes ``utf8``."""

    def boundary(x: Column) -> Column:
        u, i = x["u"], x["i"]

        def continuation(j: Column) -> Column:
            return F.hex(F.substring(u, j + F.lit(1), F.lit(1))).between("80", "BF")

        back = (
            F.when(~continuation(i), 0).when(~continuation(i - 1), 1).when(~continuation(i - 2), 2).otherwise(3)
        )
        return F.when(i <= 0, F.lit(0)).when(i >= F.octet_length(u), F.octet_length(u)).otherwise(i - back)

    return pin(F.struct(utf8.alias("u"), index.cast("int").alias("i")), boundary)


def byte_slice(utf8: Column, start: Column, end: Column) -> Column:
    """Decode bytes start..end (0-based, end excluded)."""
    return F.decode(F.substring(utf8, start + F.lit(1), end - start), "UTF-8")


def cap_at_newline(c: Column | str, cap: int) -> Column:
    """At most ``cap`` bytes, cut back to just after the last LF when there is one."""
    c = col(c)
    utf8 = F.encode(c, "UTF-8")
    head = byte_slice(utf8, F.lit(0), char_boundary(utf8, F.lit(cap)))
    at_line = F.regexp_extract(head, r"(?s)^(.*\n)", 1)
    return F.when(F.octet_length(c) <= cap, c).when(at_line != "", at_line).otherwise(head)


def truncate_with_marker(c: Column | str, limit: int) -> Column:
    """At most ``limit`` bytes, ending in the marker when something was cut."""
    c = col(c)
    size = len(TRUNCATION_MARKER.encode())
    marker = TRUNCATION_MARKER if size <= limit else ""
    room = limit - (size if marker else 0)
    utf8 = F.encode(c, "UTF-8")
    head = byte_slice(utf8, F.lit(0), char_boundary(utf8, F.lit(room)))
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.concat(head, F.lit(marker)))


def head_chars(c: Column | str, limit: int) -> Column:
    return F.left(col(c), F.lit(limit))


def tail_chars(c: Column | str, limit: int) -> Column:
    return F.right(col(c), F.lit(limit))


def strip_ansi(c: Column | str) -> Column:
    return F.regexp_replace(col(c), _ANSI, "")


def base64url(c: Column | str) -> Column:
    """URL-safe base64 without padding or line breaks."""
    return F.translate(F.base64(F.encode(col(c), "UTF-8")), "+/=\r\n", "-_")


def from_base64url(c: Column | str) -> Column:
    c = F.translate(col(c), "-_", "+/")
    pad = F.pmod(-F.length(c), F.lit(4))
    return F.decode(F.unbase64(F.concat(c, F.repeat(F.lit("="), pad))), "UTF-8")


def count_literal(c: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a non-empty ``needle``."""
    removed = F.octet_length(c) - F.octet_length(F.replace(c, needle, F.lit("")))
    return (removed / F.octet_length(needle)).cast("int")


def utf16_length(c: Column | str) -> Column:
    """UTF-16 code units: characters plus one for each above U+FFFF."""
    c = col(c)
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def utf16_prefix_chars(c: Column | str, units: Column) -> Column:
    """Characters covered by ``units`` UTF-16 units; null when that splits one
    character or lies past the end of the line."""
    c = col(c)
    prefix = F.aggregate(
        F.split(c, ""),
        F.struct(F.lit(0).alias("units"), F.lit(0).alias("chars")),
        lambda acc, ch: F.when(acc["units"] >= units, acc).otherwise(
            F.struct(
                (acc["units"] + utf16_length(ch)).alias("units"),
                (acc["chars"] + F.length(ch)).alias("chars"),
            )
        ),
    )
    return F.when(prefix["units"] == units, prefix["chars"])


def percent_encode(c: Column | str, keep_separators: bool = True) -> Column:
    """RFC 3986 percent encoding; optionally keeps ``/`` and ``:``."""
    out = F.url_encode(col(c))
    fixes = [("+", "%20"), ("*", "%2A"), ("%7E", "~")]
    if keep_separators:
        fixes += [("%2F", "/"), ("%3A", ":")]
    for old, new in fixes:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def file_uri(path: Column | str) -> Column:
    return F.concat(F.lit("file:///"), percent_encode(F.ltrim(col(path), F.lit("/"))))


def uri_to_path(uri: Column | str) -> Column:
    """Path of a file URI; null for another scheme or a broken escape."""
    uri = col(uri)
    raw = F.substr(uri, F.lit(8))
    broken = F.rlike(raw, F.lit(r"%(?![0-9A-Fa-f]{2})"))
    decoded = F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return F.when(uri.startswith("file://") & ~broken, decoded)
