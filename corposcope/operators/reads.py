"""Point and range reads with byte budgets and resumable cursors.

Every function maps a DataFrame of files (or of requests joined to files) to
rows of text; a request that cannot be served yields a row with ``error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import handles, paths, text
from ..functions.rows import attach, unnest
from ..functions.sqltext import bind, lit
from ..session import written

# Read budgets in bytes and surrounding lines.
DEFAULT_BUDGET = 30_000
MAX_BUDGET = 200_000
MAX_SURROUNDING = 200

# Line starts that count as imports.
IMPORT_PREFIXES = ["use ", "pub use ", "extern crate ", "import ", "from ", "package "]


# What a compact read keeps.
COMPACT_FIELDS = [
    "kind", "path", "hash", "content", "line_ending", "run_id", "status", "exit_code", "output", "output_truncated",
    "language", "document_type", "line_count", "size", "modified_ns", "imports",
]


def compact(rows: DataFrame) -> DataFrame:
    """The columns of a read that a compact reply keeps, and its error if it can have one.

    Offsets, handles and continuations are then never computed.
    """
    return rows.select(*[c for c in rows.columns if c in COMPACT_FIELDS or c == "error"])


def budget(max_chars: int | None) -> int:
    return min(DEFAULT_BUDGET if max_chars is None else max_chars, MAX_BUDGET)


def _page(df: DataFrame, body: Column, offset: Column, limit: int | None) -> DataFrame:
    """Cut ``body`` to ``limit`` bytes (None: all) from ``offset``, at character boundaries."""
    df = df.withColumn("_utf8", F.encode(body, "UTF-8")).withColumn("_total", F.octet_length("_utf8"))
    df = df.withColumn("offset", text.char_boundary(F.col("_utf8"), F.least(offset, F.col("_total"))))
    end = F.col("_total") if limit is None else text.char_boundary(F.col("_utf8"), F.least(F.col("offset") + limit, F.col("_total")))
    df = df.withColumn("next_offset", end)
    return df.withColumn("text", text.byte_slice(F.col("_utf8"), F.col("offset"), F.col("next_offset")))


def read_range(
    files: DataFrame, start: Column | int | None = None, end: Column | int | None = None, *,
    offset: Column | int = 0, max_chars: int | None = None, workspace: str = "main",
) -> DataFrame:
    """A file or a clamped line range of it, with its handle and continuation.

    A start past the end of the file means its last line.  The budget counts
    bytes; a cut read carries the token that resumes it in the same scope.
    """
    limit = budget(max_chars)
    whole = start is None and end is None
    first = F.greatest(_column(start if start is not None else 1), F.lit(1))
    last = F.greatest(_column(end) if end is not None else F.lit(2**31 - 1), first)
    df = text.with_lines(files).withColumn("line_count", text.line_count("content"))
    if whole:
        df = df.withColumns({"start_line": F.lit(1), "end_line": F.col("line_count")})
        body, scope = F.col("content"), handles.full_scope()
    else:
        df = df.withColumn("start_line", F.least(first, F.col("line_count")).cast("int"))
        df = df.withColumn("end_line", F.least(F.greatest(last, F.col("start_line")), F.col("line_count")).cast("int"))
        body, scope = text.join_lines("lines", F.col("start_line"), F.col("end_line")), handles.line_scope(first, last)
    df = _page(df, body, _column(offset), limit).withColumn("hash", handles.content_hash("content"))
    token = handles.fetch_token(workspace, F.col("path"), F.col("next_offset"), F.col("hash"), scope)
    return df.select(
        "path", "hash", text.line_ending("content").alias("line_ending"), "start_line", "end_line",
        handles.range_handle(workspace, F.col("path"), F.col("start_line"), F.col("end_line"), F.col("hash")).alias("handle"),
        F.col("text").alias("content"), "offset", F.col("_total").alias("total_chars"), "next_offset",
        F.when(F.col("next_offset") < F.col("_total"), token).alias("continuation"),
    )


def _column(value: Column | int) -> Column:
    return F.lit(value) if isinstance(value, int) else value


def read_paths(files: DataFrame, requested: DataFrame, **options) -> DataFrame:
    """Requested paths; those not indexed give an error row."""
    joined = attach(requested.select("path"), files, "content")
    ok = read_range(joined.filter(F.col("content").isNotNull()), **options).withColumn("error", F.lit(None).cast("string"))
    bad = joined.filter(F.col("content").isNull()).select("path", F.lit("PATH_NOT_INDEXED").alias("error"))
    return ok.unionByName(bad, allowMissingColumns=True)


def read_handles(files: DataFrame, tokens: DataFrame, *, workspace: str = "main", max_chars: int | None = None, whole: bool = False) -> DataFrame:
    """Serve ``handle`` tokens; a changed file or another workspace is an error.

    A read above the budget carries its continuation; ``whole`` gives the text that a
    reader has who follows the continuations to the end.
    """
    asked = tokens.select("handle", handles.decode_range("handle").alias("r")).select(
        "handle", F.col("r.w").alias("workspace"), F.col("r.p").alias("path"), F.col("r.a").alias("a"),
        F.col("r.b").alias("b"), F.col("r.h").alias("expected"),
    )
    joined = attach(asked, files, "content")
    error = (
        F.when(F.coalesce(F.col("workspace"), F.lit("")) != workspace, "INVALID_HANDLE")
        .when(F.col("content").isNull(), "STALE_HANDLE")
        .when(handles.content_hash("content") != F.col("expected"), "STALE_HANDLE")
    )
    return _serve(joined.withColumn("error", error), workspace, None if whole else budget(max_chars), key="handle")


def read_continuations(files: DataFrame, tokens: DataFrame, *, workspace: str = "main", max_chars: int | None = None) -> DataFrame:
    """Resume ``continuation`` tokens in their own scope; ``next`` resumes what is left."""
    asked = tokens.select("continuation", handles.decode_fetch("continuation").alias("r")).select(
        "continuation", F.col("r.workspace_id").alias("workspace"), F.col("r.path").alias("path"),
        F.when(F.col("r.scope.kind") == "lines", F.col("r.scope.start_line")).alias("a"),
        F.when(F.col("r.scope.kind") == "lines", F.col("r.scope.end_line")).alias("b"),
        F.col("r.content_hash").alias("expected"), F.col("r.offset").alias("from_offset"),
    )
    joined = attach(asked, files, "content")
    error = (
        F.when(F.coalesce(F.col("workspace"), F.lit("")) != workspace, "INVALID_CONTINUATION")
        .when(F.col("content").isNull(), "STALE_CONTINUATION")
        .when(handles.content_hash("content") != F.col("expected"), "STALE_CONTINUATION")
    )
    return _serve(joined.withColumn("error", error), workspace, budget(max_chars), key="continuation")


def _serve(df: DataFrame, workspace: str, limit: int | None, key: str) -> DataFrame:
    """Rows of ``key`` with their text from its offset on, ``limit`` bytes at most if there is one."""
    offset = F.col("from_offset") if "from_offset" in df.columns else F.lit(0)
    df = text.with_lines(df).withColumn("line_count", text.line_count("content"))
    df = df.withColumn("start_line", F.least(F.greatest(F.coalesce("a", F.lit(1)), F.lit(1)), F.col("line_count")))
    df = df.withColumn("end_line", F.least(F.greatest(F.coalesce("b", F.col("line_count")), F.col("start_line")), F.col("line_count")))
    ranged = text.join_lines("lines", F.col("start_line").cast("int"), F.col("end_line").cast("int"))
    body = F.when(F.col("error").isNotNull(), F.lit("")).when(F.col("a").isNull(), F.col("content")).otherwise(ranged)
    df = _page(df, body, offset.cast("int"), limit)
    served = F.col("error").isNull()
    scope = F.when(F.col("a").isNull(), handles.full_scope()).otherwise(handles.line_scope(F.col("a"), F.col("b")))
    # The hash of a file that is served is the one that was expected.
    token = handles.fetch_token(workspace, F.col("path"), F.col("next_offset"), F.col("expected"), scope)
    return df.select(
        key, "path", "error",
        F.when(served, F.col("start_line")).alias("start_line"), F.when(served, F.col("end_line")).alias("end_line"),
        F.when(served, F.col("text")).alias("content"), F.when(served, F.col("offset")).alias("offset"),
        F.when(served, F.col("next_offset")).alias("next_offset"), F.when(served, F.col("_total")).alias("total_chars"),
        F.when(served & (F.col("next_offset") < F.col("_total")), token).alias("next" if key == "continuation" else "continuation"),
    )


def read_symbols(files: DataFrame, name: str, *, surrounding: int = 0, path: str | None = None) -> DataFrame:
    """Text of every declaration of ``name`` with its surrounding lines."""
    around = min(surrounding, MAX_SURROUNDING)
    scoped = files if path is None else files.filter(F.col("path") == paths.normalize_path(path))
    named = scoped.filter(F.contains("content", F.lit(name)) | F.contains("path", F.lit(name)))
    hits = unnest(named, F.filter("symbols", lambda s: s["name"] == name), "s", "path", "lines", "line_count")
    start = F.greatest(F.col("s.start_line") - around, F.lit(1))
    end = F.least(F.col("s.end_line") + around, F.col("line_count"))
    return hits.select(
        "path", "s.name", "s.kind", start.alias("start_line"), end.alias("end_line"),
        text.join_lines("lines", start, end).alias("content"),
    )


def import_prelude(files: DataFrame, before: Column) -> DataFrame:
    """Import-like lines above line ``before``."""
    lead = F.regexp_replace("text", r"^\s+", "")
    test = None
    for prefix in IMPORT_PREFIXES:
        hit = lead.startswith(prefix)
        test = hit if test is None else test | hit
    numbered = unnest(text.with_lines(files), "lines", "text", "path", before.alias("before"), position="i")
    return numbered.filter((F.col("i") + 1 < F.col("before")) & test).select("path", (F.col("i") + 1).alias("line"), "text")


def metadata(described: DataFrame) -> DataFrame:
    return described.select("path", "hash", "size", "language", "document_type", "line_count")


def share_budget(files: DataFrame, max_chars: int) -> DataFrame:
    """Several reads under one byte budget, in the order of ``seq`` per ``request``.

    A read starts with what the earlier reads of its request left over.  The sizes are
    dealt into ranges of (request, seq) and summed per range; what the ranges before
    have used is carried to each range of a request, so one request fills many tasks.
    Reads of one ``seq`` follow in path order.
    """
    from pyspark.sql import Window as W

    limit = F.lit(budget(max_chars))
    sized = files.select("request", "seq", "path", F.octet_length("content").alias("total"))
    rows = written(sized.repartitionByRange("request", "seq", "path").withColumn("_range", F.spark_partition_id()), "read-ranges")
    before = W.partitionBy("request").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("request", "_range").agg(F.sum("total").alias("_sum"))
    carried = sums.select("request", "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    earlier = W.partitionBy("request", "_range").orderBy("seq", "path").rowsBetween(W.unboundedPreceding, -1)
    # A null request is one like any other.
    both = rows.alias("r").join(carried.alias("c"), F.expr("r._range = c._range AND r.request <=> c.request"))
    joined = both.select("r.*", "c._carry").withColumn("_used", F.col("_carry") + F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    left = F.greatest(limit - F.col("_used"), F.lit(0))
    return joined.select("request", "seq", "path", "total", F.least("total", left).alias("granted")).filter((F.col("granted") > 0) | (F.col("total") == 0))


def pages_of(files: DataFrame, max_chars: int) -> DataFrame:
    """Every page of a full read, offsets as a chain of continuations gives them."""
    limit = budget(max_chars)

    def cont(i: str) -> str:
        return f"hex(substring(u, {i} + 1, 1)) BETWEEN '80' AND 'BF'"

    def boundary(i: str) -> str:
        return f"({i} - CASE WHEN NOT ({cont(i)}) THEN 0 WHEN NOT ({cont(i + ' - 1')}) THEN 1 WHEN NOT ({cont(i + ' - 2')}) THEN 2 ELSE 3 END)"

    step = f"if(acc.at >= octet_length(u), acc, named_struct('out', concat(acc.out, cast(acc.at AS string), ' '), 'at', if(acc.at + {limit} >= octet_length(u), octet_length(u), {boundary(f'(acc.at + {limit})')})))"
    # Boundaries back up at most 3 bytes, so a page advances by limit - 3 or more.
    turns = f"sequence(0, cast(octet_length(u) / {max(limit - 3, 1)} AS int))"
    fold = f"aggregate({turns}, named_struct('out', '', 'at', 0), (acc, i) -> {step}).out"
    offsets = bind("encode(content, 'UTF-8')", "u", f"if(octet_length(u) = 0, '0', rtrim({fold}))")
    df = files.select("path", F.encode("content", "UTF-8").alias("_utf8"), F.expr(f"cast(split({offsets}, {lit(' ')}) AS array<int>)").alias("_offsets"))
    rows = unnest(df, "_offsets", "offset", "path", "_utf8", "_offsets", position="page")
    end = F.coalesce(F.get("_offsets", F.col("page") + 1), F.octet_length("_utf8"))
    return rows.select("path", "page", "offset", end.alias("next_offset"), text.byte_slice(F.col("_utf8"), F.col("offset"), end).alias("content"))
