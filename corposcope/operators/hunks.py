"""Unified-diff and status-text parsing, one input text per row.

A diff or status text is parsed inside its own row and exploded at the end, so
a table of many such texts needs no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.rows import unnest
from ..functions.sqltext import bind, lit

_FILE_START = r"(?md)^(?=diff --git )"
_HUNK_START = r"(?md)^(?=@@ )"
_NEW_PATH = r"(?md)^\+\+\+ b/(.*)$"
_RANGES = r"^@@\s+(\S+)(?:\s+(\S+))?"


def _number(field: str, part: int, default: str) -> str:
    """SQL: start (part 0) or count (part 1) of a range such as ``-12,5``."""
    body = f"regexp_replace({field}, '^[-+]+', '')"
    if part == 0:
        return f"coalesce(try_cast(split({body}, ',', 2)[0] AS int), 0)"
    return f"if({body} LIKE '%,%', coalesce(try_cast(split({body}, ',', 2)[1] AS int), {default}), 1)"


def parse(diffs: DataFrame, keys: list[str], diff: str = "diff") -> DataFrame:
    """Hunks of each diff text: position, path, ranges, text and id.

    The text of a hunk repeats its file header.  The path is the last ``+++ b/``
    line seen in that file so far.  A range without count counts one line.
    """
    last_path = bind(f"regexp_extract_all(p, {lit(_NEW_PATH)}, 1)", "f", "get(f, size(f) - 1)")
    # Up to each piece, which piece had a path last: one fold, collected as text.
    last_given = (
        "cast(split(rtrim(aggregate(c, named_struct('out', '', 'last', -1, 'i', 0), (acc, x) -> named_struct("
        "'out', concat(acc.out, cast(if(x IS NULL, acc.last, acc.i) AS string), ' '), 'last', if(x IS NULL, acc.last, acc.i), "
        "'i', acc.i + 1)).out), ' ') AS array<int>)"
    )
    hunk = (
        f"named_struct('path', regexp_replace(coalesce(get(c, get(n, i + 1)), ''), {lit(chr(92) + 's+$')}, ''), "
        f"'old', regexp_extract(p, {lit(_RANGES)}, 1), 'new', regexp_extract(p, {lit(_RANGES)}, 2), "
        "'text', concat(head, p))"
    )
    section = bind(
        f"split(s, {lit(_HUNK_START)}, -1)", "a",
        bind(
            "if(startswith(a[0], '@@ '), concat(array(''), a), a)", "q",
            bind(
                f"transform(q, p -> {last_path})", "c",
                bind(
                    last_given, "n",
                    bind("q[0]", "head", f"transform(slice(q, 2, size(q)), (p, i) -> {hunk})"),
                ),
            ),
        ),
    )
    found = f"flatten(transform(split({diff}, {lit(_FILE_START)}, -1), s -> {section}))"
    rows = unnest(diffs, F.expr(found), "h", *keys, position="hunk_no")
    missing = F.col("h.new") == ""
    parsed = rows.select(
        *keys, "hunk_no", F.col("h.path").alias("path"),
        F.expr(_number("h.old", 0, "1")).alias("old_start"), F.expr(_number("h.old", 1, "1")).alias("old_count"),
        F.when(missing, 0).otherwise(F.expr(_number("h.new", 0, "1"))).alias("new_start"),
        F.when(missing, 0).otherwise(F.expr(_number("h.new", 1, "1"))).alias("new_count"),
        F.col("h.text").alias("text"),
    )
    return parsed.withColumn("id", hunk_id(F.col("path"), F.col("old_start"), F.col("new_start"), F.col("text")))


def hunk_id(path: Column, old_start: Column, new_start: Column, body: Column) -> Column:
    zero = F.lit(b"\0")
    return F.sha2(
        F.concat(
            F.encode(path, "UTF-8"), zero, F.encode(old_start.cast("string"), "UTF-8"), zero,
            F.encode(new_start.cast("string"), "UTF-8"), zero, F.encode(body, "UTF-8"),
        ),
        256,
    )


def overlaps(start: Column | int, end: Column | int) -> Column:
    """The old or the new side of a hunk (when not empty) meets start..end."""
    lo, hi = (F.lit(v) if isinstance(v, int) else v for v in (start, end))

    def side(first: str, count: str) -> Column:
        return (F.col(count) > 0) & (F.col(first) <= hi) & (F.col(first) + F.col(count) - 1 >= lo)

    return side("old_start", "old_count") | side("new_start", "new_count")


def for_symbol(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Hunks that meet the span of a symbol in the same file (keys: path)."""
    spans = symbols.select("path", F.col("name").alias("symbol"), "start_line", "end_line")
    return hunks.join(spans, "path").filter(overlaps(F.col("start_line"), F.col("end_line")))


def paginate(hunks: DataFrame, keys: list[str], max_chars: int) -> DataFrame:
    """Page number of each hunk, packed in order up to ``max_chars`` bytes.

    A hunk that does not fit opens the next page; one larger than the limit gets
    a page of its own and is never cut.  Only sizes are gathered per diff; the
    hunks of one diff came from one row, which bounds the group.
    """
    sizes = hunks.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("hunk_no", F.octet_length("text").alias("size")))).alias("h")
    )
    step = (
        f"if(acc.used > 0 AND acc.used + x.size > {max_chars}, "
        "named_struct('out', concat(acc.out, cast(acc.page + 1 AS string), ' '), 'page', acc.page + 1, 'used', x.size), "
        "named_struct('out', concat(acc.out, cast(acc.page AS string), ' '), 'page', acc.page, 'used', acc.used + x.size))"
    )
    fold = f"aggregate(h, named_struct('out', '', 'page', 0, 'used', 0), (acc, x) -> {step}).out"
    pages = F.expr(f"cast(split(rtrim({fold}), ' ') AS array<int>)")
    return unnest(sizes.select(*keys, "h", pages.alias("pages")), "h", "x", *keys, "pages", position="i").select(
        *keys, F.col("x.hunk_no").alias("hunk_no"), F.col("x.size").alias("size"),
        F.expr("get(pages, i)").alias("page"),
    )


def untracked_patch(path: Column, content: Column) -> Column:
    """A new-file patch for text that is not under version control."""
    header = F.concat(
        F.lit("diff --git a/"), path, F.lit(" b/"), path,
        F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), path, F.lit("\n"),
    )
    added = F.array_join(F.transform(text.split_lines(content), lambda l: F.concat(F.lit("+"), l, F.lit("\n"))), "")
    tail = F.when(content.endswith("\n"), "").otherwise("\\ No newline at end of file\n")
    return F.concat(header, added, tail)


def parse_status(texts: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """Rows (keys, path, dirty, staged, unstaged, untracked, partially_staged).

    Records are NUL-separated.  A rename record takes the next record as its old
    path, which is dirty only; a record so taken is not read as a record.
    """
    # In a run of records that look like renames, every second one is a path.
    taken = (
        "aggregate(r, named_struct('out', '', 'take', false), (acc, x) -> named_struct("
        "'out', concat(acc.out, if(acc.take, '1', '0')), 'take', NOT acc.take AND substr(x, 1, 1) = '2')).out"
    )

    def path_after(n: int) -> str:
        return f"replace(regexp_extract(x, {lit('(?s)^(?:[^ ]* ){' + str(n) + '}(.*)$')}, 1), {lit(chr(92))}, '/')"

    def entry(path: str, staged: str, unstaged: str, untracked: str) -> str:
        return f"named_struct('path', {path}, 'staged', {staged}, 'unstaged', {unstaged}, 'untracked', {untracked})"

    x_flag, y_flag = "substr(x, 3, 1) NOT IN ('.', '')", "substr(x, 4, 1) NOT IN ('.', '')"
    record = (
        f"CASE WHEN substr(k, i + 1, 1) = '1' THEN {entry('replace(x, ' + lit(chr(92)) + ', ' + lit('/') + ')', 'false', 'false', 'false')} "
        f"WHEN substr(x, 1, 1) = '1' THEN {entry(path_after(8), x_flag, y_flag, 'false')} "
        f"WHEN substr(x, 1, 1) = '2' THEN {entry(path_after(9), x_flag, y_flag, 'false')} "
        f"WHEN substr(x, 1, 1) = 'u' THEN {entry(path_after(10), 'true', 'true', 'false')} "
        f"WHEN startswith(x, '? ') THEN {entry('replace(substr(x, 3), ' + lit(chr(92)) + ', ' + lit('/') + ')', 'false', 'false', 'true')} END"
    )
    rows = bind(
        f"filter(split({raw}, '\\\\x00', -1), x -> x <> '')", "r",
        bind(taken, "k", f"filter(array_compact(transform(r, (x, i) -> {record})), e -> e.path <> '')"),
    )
    entries = unnest(texts, F.expr(rows), "e", *keys)
    flags = entries.groupBy(*keys, F.col("e.path").alias("path")).agg(
        F.bool_or("e.staged").alias("staged"), F.bool_or("e.unstaged").alias("unstaged"),
        F.bool_or("e.untracked").alias("untracked"),
    )
    return flags.withColumn("partially_staged", F.col("staged") & F.col("unstaged"))


def status_header(texts: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """Head commit and branch; empty for an unborn or detached state."""

    def header(name: str, none: str) -> Column:
        value = F.regexp_extract(F.col(raw), rf"(?:^|\x00)# branch\.{name} ([^\x00]*)", 1)
        return F.when(value == none, "").otherwise(value)

    return texts.select(*keys, header("oid", "(initial)").alias("head"), header("head", "(detached)").alias("branch"))


def parse_log(logs: DataFrame, raw: str = "raw") -> DataFrame:
    """Commit rows from tab-separated log lines."""
    fields = F.split("line", "\t", 4)
    return unnest(logs, text.split_lines(raw), "line").select(
        F.get(fields, F.lit(0)).alias("commit"), F.get(fields, F.lit(1)).alias("date"),
        F.get(fields, F.lit(2)).alias("author"), F.get(fields, F.lit(3)).alias("subject"),
    )
