"""Line search with merged context windows and fair merging across files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..errors import EngineError
from ..functions import handles, paths, terms, text
from ..functions.ambiguity import is_ambiguous
from ..functions.multipattern import line_hits
from ..functions.rows import unnest, winners
from .windows import merge_lines

# Limits of a search request.
DEFAULT_RESULTS = 20
PROTOCOL_MAX_RESULTS = 200
DEFAULT_CONTEXT = 2
MAX_CONTEXT = 20
PER_FILE_CAP = 8


# The ASCII classes of the dialect, as first and last characters of their ranges.
POSIX = {
    "alnum": "09AZaz", "alpha": "AZaz", "ascii": "\0\x7f", "blank": "\t\t  ", "cntrl": "\0\x1f\x7f\x7f", "digit": "09",
    "graph": "!~", "lower": "az", "print": " ~", "punct": "!/:@[`{~", "space": "\t\r  ", "upper": "AZ", "word": "09AZ__az", "xdigit": "09AFaf",
}


def posix_members(name: str, negated: bool) -> str:
    """The ranges of a class (or of all other characters) for use inside a Java class."""
    pairs = [(ord(a), ord(b)) for a, b in zip(POSIX[name][::2], POSIX[name][1::2])]
    if negated:
        edges = [-1, *(x for pair in pairs for x in pair), 0x110000]
        pairs = [(a + 1, b - 1) for a, b in zip(edges[::2], edges[1::2]) if a + 1 < b]
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in pairs)


def _unnamed(pattern: str) -> str:
    """Named groups as plain ones: no result depends on a group."""
    return re.sub(r"(?<!\\)((?:\\\\)*)\(\?P?<[A-Za-z_]\w*>", r"\1(", pattern)


def check_regex(pattern: str) -> str:
    """Reject what a linear-time regex dialect has no meaning for."""
    for construct, what in (
        (r"\(\?(?:[=!]|<[=!])", "look-around"),
        (r"\\[1-9k]", "back-reference"),
        (r"\(\?>|[*+?]\+|\{\d+(?:,\d*)?\}\+", "atomic group or possessive quantifier"),
        (r"\\[GZQE]", "anchor or quote unknown to the dialect"),
    ):
        if re.search(construct, re.sub(r"\\[xpP]\{[^}]*\}", "x", re.sub(r"\\\\", "", pattern))):
            raise EngineError("INVALID_REGEX", f"{what} is not supported", query_length=len(pattern))
    unknown = set(re.findall(r"\[:\^?(\w+):\]", pattern)) - POSIX.keys()
    if unknown:
        raise EngineError("INVALID_REGEX", f"unknown class {sorted(unknown)[0]}", query_length=len(pattern))
    try:
        re.compile(re.sub(r"\\[pP](\{\w+\}|\w)|\\z|\\x\{[0-9A-Fa-f]+\}|\[:\^?\w+:\]", "x", _unnamed(pattern)))
    except re.error as error:
        raise EngineError("INVALID_REGEX", str(error), query_length=len(pattern)) from error
    try:
        ambiguous = is_ambiguous(_unnamed(pattern), ignore_case=True)
    except (re.error, OverflowError, RecursionError) as error:
        raise EngineError("INVALID_REGEX", str(error), query_length=len(pattern)) from error
    if ambiguous:
        raise EngineError("INVALID_REGEX", "a repeat can read one text in two ways", query_length=len(pattern))
    return pattern


def java_regex(pattern: str, case_sensitive: bool) -> str:
    """Unicode classes, LF as the only line end, optional Unicode folding."""
    classes = re.sub(r"\[:(\^?)(\w+):\]", lambda m: posix_members(m[2], bool(m[1])), _unnamed(pattern))
    return ("(?dU)" if case_sensitive else "(?diuU)") + classes


def line_matcher(pattern: str, syntax: str, case_sensitive: bool):
    if syntax == "literal":
        return lambda c: text.contains_literal(c, pattern, case_sensitive)
    if syntax == "regex":
        compiled = java_regex(check_regex(pattern), case_sensitive)
        return lambda c: F.rlike(c, F.lit(compiled))
    raise EngineError("INVALID_OPERATION_FIELD", "syntax must be literal or regex", field="syntax")


def possible(corpus: DataFrame, pattern: str, syntax: str, case_sensitive: bool, prune: str) -> Column:
    """The needle somewhere in the text, and one of its terms among the file's.

    The second test is part of the meaning: a needle that is only the inside of
    a longer term finds nothing.  ``prune="none"`` gives the plain substring
    search, and a needle without terms (short or stop words) sees every file.
    """
    if syntax != "literal":
        return F.lit(True)
    if "\n" in pattern:
        return F.lit(False)
    inside = text.contains_literal("content", pattern, case_sensitive)
    wanted = terms.query_terms(pattern) if prune == "terms" else []
    return inside & has_term(corpus, wanted) if wanted else inside


def has_term(corpus: DataFrame, wanted: list[str]) -> Column:
    """Any wanted term among the indexed terms of the row.

    A stored term column answers directly.  Without one, each term is looked for
    by regex, which stops at its first hit; building all terms of a file to test
    for one of them costs several times the scan.
    """
    if "indexed_terms" in corpus.columns:
        return F.arrays_overlap("indexed_terms", F.array(*map(F.lit, wanted)))
    sources = [F.col("content"), F.col("path")]
    if "symbols" in corpus.columns:
        sources.append(F.array_join(F.transform("symbols", lambda s: s["name"]), "\n"))
    found = None
    for source in sources:
        for term in wanted:
            hit = F.rlike(source, F.lit(terms.term_regex(term)))
            found = hit if found is None else found | hit
    return found


def match_windows(files: DataFrame, matcher, context: int, only: Column | None = None) -> DataFrame:
    """One row per file with all of its windows; null where ``only`` fails.

    The file-level test guards the split instead of filtering rows.  A filter
    would be moved below any exchange that spreads a small input over the cores,
    and the text tests would then run on the few tasks of the scan.
    """
    numbered = F.transform("lines", lambda line, i: F.when(matcher(line), i + 1))
    return (
        text.with_lines(files, only=only)
        .withColumns({"_hits": F.array_compact(numbered), "_count": text.line_count("content")})
        .withColumn("_windows", merge_lines("_hits", context, "_count"))
    )


def _windows(
    corpus: DataFrame, pattern: str, syntax: str, scope: list[str] | None, case_sensitive: bool, prune: str, context: int
) -> DataFrame:
    if pattern == "":
        raise EngineError("INVALID_REQUEST", "a text search needs a pattern")
    return match_windows(
        corpus.filter(paths.in_scope("path", scope)), line_matcher(pattern, syntax, case_sensitive),
        min(context, MAX_CONTEXT), possible(corpus, pattern, syntax, case_sensitive, prune),
    )


def _capped(windows: DataFrame, scope: list[str] | None, limit: int) -> DataFrame:
    cap = limit if paths.scope_size(scope) == 1 else min(limit, PER_FILE_CAP)
    return unnest(windows, F.slice("_windows", F.lit(1), F.lit(cap)), "_window", "*", position="_turn")


def clamp_limit(max_results: int, configured: int = PROTOCOL_MAX_RESULTS) -> int:
    return max(1, min(max_results, PROTOCOL_MAX_RESULTS, configured))


def search_text(
    corpus: DataFrame,
    pattern: str,
    *,
    syntax: str = "literal",
    scope: list[str] | None = None,
    max_results: int = DEFAULT_RESULTS,
    context: int = DEFAULT_CONTEXT,
    case_sensitive: bool = False,
    prune: str = "terms",
    workspace: str = "main",
    push: bool = False,
) -> DataFrame:
    """Matching windows, one per file and turn, files in path order.

    The top-k is over (turn, path) and the window's lines; no text takes part in it.
    The texts of the final rows (at most 200) are fetched for them alone (``push``: see
    ``rows.winners``), and so are preview, hash and handle.
    """
    limit = clamp_limit(max_results)
    windows = _windows(corpus, pattern, syntax, scope, case_sensitive, prune, context)
    top = (
        _capped(windows.select("path", "_windows"), scope, limit)
        .select("path", "_turn", "_window")
        .orderBy("_turn", "path")
        .limit(limit)
    )
    found = winners(top, corpus, "content", push=push)
    return found.select(
        "_turn", "path",
        F.col("_window.line").alias("line"),
        F.col("_window.start_line").alias("start_line"),
        F.col("_window.end_line").alias("end_line"),
        text.join_lines(
            text.split_lines("content"), F.col("_window.start_line"), F.col("_window.end_line")
        ).alias("preview"),
        handles.range_handle(
            workspace, F.col("path"), F.col("_window.start_line"), F.col("_window.end_line"),
            handles.content_hash("content"),
        ).alias("handle"),
        F.lit(syntax).alias("match_type"),
        F.lit(1.0).alias("score"),
        F.lit(f"{syntax}_match").alias("reason"),
    ).orderBy("_turn", "path").limit(limit).drop("_turn")


def search_stats(
    corpus: DataFrame,
    pattern: str,
    *,
    syntax: str = "literal",
    scope: list[str] | None = None,
    max_results: int = DEFAULT_RESULTS,
    context: int = DEFAULT_CONTEXT,
    case_sensitive: bool = False,
    prune: str = "terms",
) -> DataFrame:
    """Window totals before caps, rows returned, and whether results were cut."""
    limit = clamp_limit(max_results)
    cap = limit if paths.scope_size(scope) == 1 else min(limit, PER_FILE_CAP)
    windows = _windows(corpus, pattern, syntax, scope, case_sensitive, prune, context)
    # A file that the needle test rules out has no windows, which is null.
    per_file = windows.select(F.coalesce(F.size("_windows"), F.lit(0)).alias("n"))
    totals = per_file.agg(
        F.count_if(F.col("n") > 0).alias("matched_files"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_windows"),
        F.coalesce(F.sum(F.least("n", F.lit(cap))), F.lit(0)).alias("kept"),
    )
    return totals.select(
        "matched_files",
        "total_windows",
        F.least("kept", F.lit(limit)).alias("result_count"),
        (F.col("total_windows") > F.least("kept", F.lit(limit))).alias("truncated"),
    )


def search_many(
    corpus: DataFrame,
    patterns: list[str],
    *,
    syntax: str = "literal",
    scope: list[str] | None = None,
    max_results: int = DEFAULT_RESULTS,
    context: int = DEFAULT_CONTEXT,
    case_sensitive: bool = False,
    prune: str = "terms",
    workspace: str = "main",
) -> DataFrame:
    """Several patterns in one scan; each keeps its own limit, order and error.

    All literals of the request are one automaton, which reads a text once whatever
    their number; regexes become one window column each.  ``row_number() <= limit`` is
    planned as a group limit, which trims every task to ``limit`` rows per pattern before
    the exchange.  Texts are fetched for the winners alone.  A pattern that is no
    pattern gives one row with ``error`` and no window.
    """
    limit = clamp_limit(max_results)
    context = min(context, MAX_CONTEXT)
    cap = limit if paths.scope_size(scope) == 1 else min(limit, PER_FILE_CAP)
    if not patterns:
        raise EngineError("INVALID_REQUEST", "queries cannot be empty")
    failed: list[tuple[int, str, str]] = []
    valid: list[tuple[int, str]] = []
    for i, pattern in enumerate(patterns):
        try:
            if pattern == "":
                raise EngineError("INVALID_REQUEST", "a text search needs a pattern")
            line_matcher(pattern, syntax, case_sensitive)
            valid.append((i, pattern))
        except EngineError as error:
            failed.append((i, pattern, error.code))
    schema = "query_index INT, query STRING, error STRING"
    errors = corpus.sparkSession.createDataFrame(failed, schema)
    files = corpus.filter(paths.in_scope("path", scope))
    none = F.array().cast("array<int>")
    if syntax == "literal":
        files = files.withColumn("_found", line_hits(F.col("content"), [p for _, p in valid], case_sensitive))
        files = files.filter(F.exists("_found", lambda f: F.size(f) > 0)) if valid else files.filter(F.lit(False))
        # The needle is in the text; what is left to ask is whether one of its terms is indexed.
        wanted = [terms.query_terms(p) if prune == "terms" else [] for _, p in valid]
        allowed = [has_term(corpus, w) if w else F.lit(True) for w in wanted]
        hits = {i: F.when((F.size(F.get("_found", F.lit(k))) > 0) & allowed[k], F.get("_found", F.lit(k))).otherwise(none) for k, (i, _) in enumerate(valid)}
    else:
        files = text.with_lines(files)
        hits = {i: F.array_compact(_numbered(line_matcher(p, syntax, case_sensitive))) for i, p in valid}
    files = files.withColumns({**{f"_hits{i}": h for i, h in hits.items()}, "_count": text.line_count("content")})
    entry = lambda i, q: F.struct(F.lit(i).alias("query_index"), F.lit(q).alias("query"), F.slice(merge_lines(f"_hits{i}", context, "_count"), F.lit(1), F.lit(cap)).alias("windows"))
    if not valid:
        top = corpus.sparkSession.createDataFrame([], "path STRING, query_index INT, query STRING, turn INT, line INT, start_line INT, end_line INT, rank INT")
    else:
        entries = F.array(*[entry(i, q) for i, q in valid])
        per_file = unnest(files, entries, "e", "path").select("path", "e.*")
        windows = unnest(per_file, "windows", "w", "path", "query_index", "query", position="turn").select("path", "query_index", "query", "turn", "w.*")
        order = W.partitionBy("query_index").orderBy("turn", "path")
        top = windows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    # At most ``limit`` rows for each pattern of the request.
    found = winners(top, corpus, "content").select(
        "path", "query_index", "query", "turn", "line", "start_line", "end_line", "rank",
        text.join_lines(text.split_lines("content"), F.col("start_line"), F.col("end_line")).alias("preview"),
        handles.range_handle(workspace, F.col("path"), F.col("start_line"), F.col("end_line"), handles.content_hash("content")).alias("handle"),
        F.lit(syntax).alias("match_type"), F.lit(1.0).alias("score"), F.lit(f"{syntax}_match").alias("reason"), F.lit(None).cast("string").alias("error"),
    )
    return found.unionByName(errors, allowMissingColumns=True)


def _numbered(matcher) -> Column:
    return F.transform("lines", lambda line, j: F.when(matcher(line), j + 1))
