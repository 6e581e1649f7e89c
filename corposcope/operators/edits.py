"""Edit planning: change rows become (path, before, after) plan rows or errors.

Nothing is written to the corpus; the result is the plan.  Changes that stand
alone are column expressions over one row.  Only a transaction whose changes
build on each other is folded in order, one request at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import handles, linediff, paths, positions, syntax, text
from ..functions.rows import attach, is_small, unnest
from ..functions.sqltext import bind

PLAN_SCHEMA = T.StructType(
    [
        T.StructField("txn", T.StringType()), T.StructField("path", T.StringType()),
        T.StructField("before", T.StringType()), T.StructField("after", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

# Positions of an insert relative to its anchor symbol.
INSERT_POSITIONS = ["before", "after", "inside_start", "inside_end"]


def matching_needle(content: Column, selected: Column, old: Column, expected: Column) -> Column:
    """The form of ``old`` to look for: with the file's own line ends when that
    form occurs exactly as often as expected, else as given."""
    adapted = text.to_line_ending(old, text.line_ending(content))

    def pick(x: Column) -> Column:
        fits = text.count_literal(x["selected"], x["adapted"]) == x["expected"]
        return F.when((x["adapted"] != x["old"]) & fits, x["adapted"]).otherwise(x["old"])

    return text.pin(
        F.struct(selected.alias("selected"), old.alias("old"), adapted.alias("adapted"), expected.alias("expected")), pick
    )


def replace_exact(
    files: DataFrame, old: Column, new: Column, expected: Column | int = 1, expected_hash: Column | None = None
) -> DataFrame:
    """Replace every occurrence of ``old``, provided there are exactly ``expected``."""
    expected = F.lit(expected) if isinstance(expected, int) else expected
    df = files.withColumns({"_old": old, "_new": new, "_expected": expected})
    df = df.withColumn("_needle", matching_needle(F.col("content"), F.col("content"), F.col("_old"), F.col("_expected")))
    df = df.withColumn("actual", text.count_literal(F.col("content"), F.col("_needle")))
    adapted = text.to_line_ending(F.col("_new"), text.line_ending("content"))
    replacement = text.keep_terminal_newline(F.col("_needle"), adapted)
    error = F.when(F.col("actual") != F.col("_expected"), "EXACT_MATCH_COUNT")
    if expected_hash is not None:
        error = F.when(~handles.content_hash("content").eqNullSafe(expected_hash), "STALE_FILE").otherwise(error)
    return df.withColumn("error", error).select(
        "path", "actual", "error", F.col("content").alias("before"),
        F.when(F.col("error").isNull(), F.replace("content", F.col("_needle"), replacement)).alias("after"),
    )


def replace_lines(files: DataFrame, start: Column, end: Column, new: Column) -> DataFrame:
    """Replace whole lines start..end, line ends included; reversed ranges fail."""
    df = files.withColumns({"_a": start.cast("int"), "_b": end.cast("int"), "_new": new})
    cut = bind(
        "split(content, '\\\\n', -1)", "p",
        "named_struct('head', array_join(transform(slice(p, 1, least(greatest(_a - 1, 0), size(p) - 1)), x -> concat(x, '\\n')), ''), "
        "'tail', if(_b >= size(p), '', array_join(slice(p, _b + 1, size(p)), '\\n')), "
        "'selected', concat(array_join(slice(p, greatest(_a, 1), _b - greatest(_a, 1) + 1), '\\n'), if(_b < size(p), '\\n', '')))",
    )
    valid = F.col("_a") <= F.col("_b")
    df = df.withColumn("_cut", F.when(valid, F.expr(cut)))
    adapted = text.to_line_ending(F.col("_new"), text.line_ending("content"))
    replacement = text.keep_terminal_newline(F.col("_cut.selected"), adapted)
    return df.select(
        "path", F.when(~valid, "INVALID_HANDLE_RANGE").alias("error"), F.col("content").alias("before"),
        F.when(valid, F.concat("_cut.head", replacement, "_cut.tail")).alias("after"),
    )


def insert_at_symbol(files: DataFrame, anchor: Column, position: str, content: Column) -> DataFrame:
    """Insert before or after the first symbol named ``anchor``, or just inside it."""
    line = {"before": "s.start_line", "after": "s.end_line + 1", "inside_start": "s.start_line + 1", "inside_end": "s.end_line"}[position]
    df = files.withColumns({"_anchor": anchor, "_new": content})
    df = df.withColumn("s", F.get(F.filter("symbols", lambda x: x["name"] == F.col("_anchor")), F.lit(0)))
    df = df.withColumn("_at", F.expr(line))
    split = bind(
        "split(content, '\\\\n', -1)", "p",
        "named_struct('head', array_join(transform(slice(p, 1, least(_at - 1, size(p) - 1)), x -> concat(x, '\\n')), ''), "
        "'tail', if(_at > size(p), p[size(p) - 1], array_join(slice(p, _at, size(p)), '\\n')))",
    )
    # Past the last LF the insertion point is the end of the text.
    df = df.withColumn("_cut", F.when(F.col("s").isNotNull(), F.expr(split)))
    adapted = text.to_line_ending(F.col("_new"), text.line_ending("content"))
    at_end = F.expr("_at > length(content) - length(replace(content, '\\n', '')) + 1")
    after = F.when(at_end, F.concat("content", adapted)).otherwise(F.concat("_cut.head", adapted, "_cut.tail"))
    return df.select(
        "path", F.when(F.col("s").isNull(), "SYMBOL_NOT_FOUND").alias("error"),
        F.col("content").alias("before"), F.when(F.col("s").isNotNull(), after).alias("after"),
    )


def create(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (path, content, overwrite): new files, or overwritten ones that
    keep the line ends of what they replace."""
    df = attach(wanted, files, F.col("content").alias("before"))
    exists = F.col("before").isNotNull()
    refused = exists & ~F.col("overwrite")
    body = F.when(exists, text.to_line_ending(F.col("content"), text.line_ending("before"))).otherwise(F.col("content"))
    return df.select("path", F.when(refused, "PATH_EXISTS").alias("error"), "before", F.when(~refused, body).alias("after"))


def rename(files: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves`` (path, to): two plan rows each, or PATH_NOT_FOUND / PATH_EXISTS."""
    known = files.select(F.col("path").alias("to"), F.lit(True).alias("taken"))
    df = attach(attach(moves, files, "content"), known, "taken", on="to") if is_small(moves) else attach(moves, files, "content").join(known, "to", "left")
    error = F.when(F.col("content").isNull(), "PATH_NOT_FOUND").when(F.col("taken"), "PATH_EXISTS")
    none = F.lit(None).cast("string")
    rows = F.array(
        F.struct(F.col("path"), F.col("content").alias("before"), none.alias("after")),
        F.struct(F.col("to").alias("path"), none.alias("before"), F.col("content").alias("after")),
    )
    first = F.slice(rows, F.lit(1), F.when(error.isNull(), F.lit(2)).otherwise(F.lit(1)))
    return unnest(df, first, "r", error.alias("error")).select("r.path", "error", "r.before", "r.after")


def overlapping(files: DataFrame, needles: Column) -> DataFrame:
    """Whether the exact matches of several needles in one file overlap.

    Matches are half-open character ranges of the original text, gathered and
    sorted inside the row; neighbours suffice, since a range that reaches past
    its successor already overlaps it.
    """
    quoted = "concat('\\\\Q', replace(n, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E')"
    ranges = bind(
        "content", "c",
        "array_sort(flatten(transform(_needles, n -> "
        + bind(
            text.running_offsets(
                "slice(split(c, concat('\\\\Q', n, '\\\\E'), -1), 1, size(split(c, concat('\\\\Q', n, '\\\\E'), -1)) - 1)",
                "length(x)", "length(n)",
            ),
            "offs", "transform(offs, a -> named_struct('a', a, 'b', a + length(n)))",
        )
        + ")))",
    )
    # A neighbour test needs each end against the next start only: the ranges of
    # one needle never overlap, and equal starts sort together.
    clash = "exists(transform(r, (x, i) -> coalesce(x.b > get(r, i + 1).a, false)), y -> y)"
    df = files.withColumn("_needles", needles).withColumn("_ranges", F.expr(ranges))
    return df.select(
        "path", F.size("_ranges").alias("edits"),
        F.when(F.expr(bind("_ranges", "r", clash)), "OVERLAPPING_EDITS").otherwise("").alias("error"),
    )


def check_preconditions(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Error code per change: a missing or failed guard, else empty.

    ``changes``: path, kind, overwrite, has_snapshot, expected_hash.
    """
    df = attach(changes, files, handles.content_hash("content").alias("actual_hash"))
    exists = F.col("actual_hash").isNotNull()
    edits_existing = (F.col("kind") != "create") | exists
    error = (
        F.when(edits_existing & ~F.col("has_snapshot") & F.col("expected_hash").isNull(), "MISSING_PRECONDITION")
        .when(F.col("expected_hash").isNotNull() & ~F.col("expected_hash").eqNullSafe(F.col("actual_hash")), "STALE_FILE")
        .when((F.col("kind") == "create") & exists & ~F.col("overwrite"), "PATH_EXISTS")
        .when((F.col("kind") != "create") & ~exists, "PATH_NOT_FOUND")
        .otherwise("")
    )
    return df.select(*changes.columns, "actual_hash", error.alias("error"))


def handle_order_conflicts(changes: DataFrame) -> DataFrame:
    """Files where a handle edit is not the only change of its transaction."""
    counts = changes.groupBy("txn", "path").agg(
        F.count("*").alias("changes"), F.bool_or(F.col("handle").isNotNull()).alias("has_handle")
    )
    return counts.filter(F.col("has_handle") & (F.col("changes") > 1)).select(
        "txn", "path", F.lit("AMBIGUOUS_HANDLE_EDIT_ORDER").alias("error")
    )


def rename_identifier(files: DataFrame, old: str, new: str) -> DataFrame:
    """Whole-file replacements that rename every exact occurrence of ``old``."""
    from ..functions.terms import IDENTIFIER_CLASS

    bounded = f"(?<![{IDENTIFIER_CLASS}]){text.java_quote(old)}(?![{IDENTIFIER_CLASS}])"
    safe = new.replace("\\", "\\\\").replace("$", "\\$")
    hits = files.filter(F.contains("content", F.lit(old)))
    after = F.regexp_replace("content", bounded, safe)
    return hits.withColumn("after", after).filter(F.col("after") != F.col("content")).select(
        "path", handles.content_hash("content").alias("expected_hash"),
        F.regexp_count("content", F.lit(bounded)).alias("edits"), F.col("content").alias("before"), "after",
    )


def compile_text_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply positional edits (path, start, end, text; 0-based characters) per file.

    Overlaps give an error row.  The edits of a file are sorted in its group,
    whose size the file itself bounds once overlaps are refused.
    """
    grouped = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("e"))
    return _compiled(grouped.join(files.select("path", "content"), "path").withColumn("_error", F.lit(None).cast("string")))


def compile_located_edits(files: DataFrame, edits: DataFrame, encoding: str = "utf-16") -> DataFrame:
    """Apply edits (path, start_line, start_column, end_line, end_column, text) per file, whose
    columns count code units of ``encoding`` from 0.

    The edits of a file meet its table of lines in one row.  A line outside the file is
    INVALID_LSP_EDIT, a column inside a character or behind its line INVALID_LSP_POSITION;
    the first edit by position with an error gives the error of the file.  A path
    without a file is PATH_NOT_FOUND.
    """
    place = F.struct("start_line", "start_column", "end_line", "end_column", "text")
    grouped = edits.groupBy("path").agg(F.array_sort(F.collect_list(place)).alias("_asked"))
    df = grouped.join(files.select("path", "content"), "path", "left").withColumn("_lines", positions.line_table())

    def located(line: Column, column: Column) -> Column:
        at = F.when(line >= 0, F.get("_lines", line))
        return F.struct((at.isNull() | (F.col("content") == "")).alias("outside"), (at["start"] + positions.characters_before(at["text"], column, encoding)).alias("at"))

    def edit(e: Column) -> Column:
        return text.pin(
            F.struct(located(e["start_line"], e["start_column"]).alias("a"), located(e["end_line"], e["end_column"]).alias("b")),
            lambda p: F.struct(
                p["a"]["at"].alias("start"), p["b"]["at"].alias("end"), e["text"].alias("text"),
                F.when(p["a"]["outside"] | p["b"]["outside"], "INVALID_LSP_EDIT").when(p["a"]["at"].isNull() | p["b"]["at"].isNull(), "INVALID_LSP_POSITION").alias("error"),
            ),
        )

    df = df.withColumn("_placed", F.transform("_asked", edit))
    first = F.get(F.filter(F.transform("_placed", lambda p: p["error"]), lambda x: x.isNotNull()), F.lit(0))
    df = df.withColumn("_error", F.when(F.col("content").isNull(), "PATH_NOT_FOUND").otherwise(first))
    # A stable order: of two edits at one place the one that was asked for first.
    ordered = F.array_sort(F.transform("_placed", lambda p, i: F.struct(p["start"], p["end"], i.alias("i"), p["text"])))
    return _compiled(df.withColumn("e", F.transform(ordered, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["text"].alias("text")))))


def _compiled(df: DataFrame) -> DataFrame:
    """``e`` (start, end, text; sorted) applied to ``content`` unless there is an ``_error``."""
    clash = F.expr("exists(transform(e, (x, i) -> coalesce(x.end > get(e, i + 1).start, false)), y -> y)")
    applied = F.expr(
        "aggregate(e, named_struct('out', '', 'at', 0), (acc, x) -> named_struct("
        "'out', concat(acc.out, substr(content, acc.at + 1, x.start - acc.at), x.text), 'at', x.end), "
        "acc -> concat(acc.out, substr(content, acc.at + 1)))"
    )
    df = df.withColumn("error", F.coalesce(F.col("_error"), F.when(clash, F.lit("OVERLAPPING_LSP_EDITS"))))
    return df.select(
        "path", "error", F.size("e").alias("edits"), handles.content_hash("content").alias("expected_hash"),
        F.col("content").alias("before"), F.when(F.col("error").isNull(), applied).alias("after"),
    )


def with_diff(plan: DataFrame) -> DataFrame:
    """Add the unified diff and the added / removed line counts of each plan row."""
    stat = linediff.diff_stat("before", "after")
    return plan.withColumn("diff", linediff.unified_diff("path", "before", "after")).withColumn("_stat", stat).select(
        *plan.columns, "diff", F.col("_stat.added").alias("added"), F.col("_stat.removed").alias("removed")
    )


def shape_diff(planned: DataFrame, detail: str, cap: int) -> DataFrame:
    """compact drops the diff, debug keeps it whole, standard cuts it at a line."""
    if detail == "compact":
        return planned.withColumns({"diff": F.lit(None).cast("string"), "truncated": F.lit(False), "omitted": F.lit(True)})
    long = F.octet_length("diff") > cap if detail == "standard" and cap > 0 else F.lit(False)
    shown = F.when(long, text.cap_at_newline("diff", cap)).otherwise(F.col("diff"))
    return planned.withColumns({"truncated": long, "omitted": F.lit(False), "diff": shown})


def syntax_gate(plan: DataFrame) -> DataFrame:
    """checked / skipped / SYNTAX_ERROR for each planned text; deletions have none.

    A text that its parser can neither accept nor refuse, for its depth, is skipped.
    """
    rows = plan.filter(F.col("after").isNotNull())
    broken = syntax.parse_has_error(paths.language("path"), F.col("after"))
    return rows.withColumn("_broken", broken).select(
        "path",
        F.when(F.col("_broken").isNull(), "skipped").when(F.col("_broken"), "SYNTAX_ERROR").otherwise("checked").alias("syntax_check"),
    )


def diagnostics(files: DataFrame) -> DataFrame:
    """One syntax-error row per file that does not parse."""
    broken = syntax.parse_has_error(paths.language("path"), F.col("content"))
    return files.withColumn("_broken", broken).filter(F.col("_broken")).select(
        "path", F.lit("error").alias("severity"), F.lit("syntax error").alias("message")
    )


def plan_transactions(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Fold each transaction's changes in order of ``seq`` into plan rows.

    ``changes``: txn, seq, kind, path, to, old_text, new_text, expected and, if
    created files may replace existing ones, overwrite.  A later
    change sees the text an earlier one left, also across a rename, so a
    transaction is one group; it is one request, which its sender bounds.  The
    first error voids the transaction.
    """
    # A path and its text meet once; whether a target is taken is asked without any text,
    # and only for changes that have one, as all nulls of a join key meet in one task.
    touched = changes.select("txn", "path").distinct()
    texts = touched.join(files.select("path", "content"), "path")
    aimed = changes.filter(F.col("to").isNotNull())
    taken = files.select(F.col("path").alias("to")).distinct().withColumn("to_exists", F.lit(True))
    steps = aimed.join(taken, "to", "left").unionByName(changes.filter(F.col("to").isNull()), allowMissingColumns=True)
    # The texts of a transaction come before its changes.
    rows = texts.withColumn("_step", F.lit(0)).unionByName(steps.withColumn("_step", F.lit(1)), allowMissingColumns=True)
    # One hash partition holds whole transactions, sorted; a partition is streamed
    # batch by batch, and only the transaction being read is in memory.
    ordered = rows.repartition("txn").sortWithinPartitions("txn", "_step", "seq")
    return ordered.mapInArrow(_fold_partition, PLAN_SCHEMA)


# So many rows or characters are handed back at a time.
MOST_ROWS, MOST_CHARACTERS = 1000, 8 << 20


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, so that a batch is never a second time in memory as Python objects."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def _fold_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = pa.schema([(name, pa.string()) for name in PLAN_SCHEMA.names])
    out: list[list] = []
    held = 0
    for txn, rows in itertools.groupby(_records(batches), key=lambda r: r["txn"]):
        for row in _fold_transaction(txn, rows):
            out.append(row)
            held += sum(len(x) for x in row if x is not None)
            if len(out) >= MOST_ROWS or held >= MOST_CHARACTERS:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], schema=types)
                out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], schema=types)


def with_line_ends(value: str, like: str) -> str:
    """``value`` with the line ends of ``like``, if those are of one kind."""
    pairs = like.count("\r\n")
    lf, cr = like.count("\n") - pairs, like.count("\r") - pairs
    plain = value.replace("\r\n", "\n").replace("\r", "\n")
    if pairs and not lf and not cr:
        return plain.replace("\n", "\r\n")
    return plain if lf and not pairs and not cr else value


def _replaced(before: str, old: str, new: str, expected: int) -> str | None:
    """All occurrences replaced if there are ``expected`` of them, else None.  A needle
    rewritten to the file's line ends goes before the needle as given."""
    needle = with_line_ends(old, before)
    if needle == old or before.count(needle) != expected:
        needle = old
    if before.count(needle) != expected:
        return None
    new = with_line_ends(new, before)
    if new and not new.endswith("\n") and needle.endswith("\n"):
        new += "\r\n" if needle.endswith("\r\n") else "\n"
    return before.replace(needle, new)


def _fold_transaction(txn: str, rows) -> list[list]:
    """Plan rows of one transaction, whose texts (``_step`` 0) come before its changes."""
    plan: dict[str, list] = {}
    stored: dict[str, str] = {}
    for row in rows:
        path, error = row["path"], None
        if row["_step"] == 0:
            stored[path] = row["content"]
            continue
        before = plan[path][1] if path in plan else stored.get(path)
        updates: dict[str, tuple] = {}
        if row["kind"] != "create" and before is None:
            error = "PATH_NOT_FOUND"
        elif row["kind"] == "replace":
            after = _replaced(before, row["old_text"], row["new_text"], row["expected"])
            error = "EXACT_MATCH_COUNT" if after is None else None
            updates[path] = (before, after)
        elif row["kind"] == "create":
            allowed = before is None or row.get("overwrite") is True
            error = None if allowed else "PATH_EXISTS"
            updates[path] = (before, row["new_text"] if before is None else with_line_ends(row["new_text"], before))
        elif row["kind"] == "delete":
            updates[path] = (before, None)
        elif row["kind"] == "rename":
            to = row["to"]
            # A path that a change before has freed still counts as taken.
            taken = row["to_exists"] is True or (to in plan and plan[to][1] is not None)
            error = "PATH_EXISTS" if taken else None
            updates[path], updates[to] = (before, None), (None, before)
        else:
            error = "INVALID_CHANGE_KIND"
        if error:
            return [[txn, path, None, None, error]]
        for name, (old, new) in updates.items():
            plan[name] = [plan[name][0] if name in plan else old, new]
    return [[txn, path, before, after, None] for path, (before, after) in sorted(plan.items())]
