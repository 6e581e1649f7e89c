"""Symbol tables: extraction, ranked search, outlines, positions, containment.

Symbols live as an array in the row of their file.  Containment questions (owner,
enclosing symbol, symbol at a line) are asked inside that row, so no interval
join and no exchange is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import handles, paths, syntax, text
from ..functions.intervals import owner_names
from ..functions.rows import attach, unnest, winners
from ..functions.sqltext import bind, lit
from .search import DEFAULT_RESULTS, clamp_limit

HEADING_PATTERN = r"^(\p{Lu}\p{L}*)"
STEM_PATTERN = r"([^/]*?)(?:\.[^./]*)?$"


def _signature(line: str) -> str:
    return f"left(regexp_replace({line}, {lit(r'^' + chr(92) + 's+|' + chr(92) + 's+$')}, ''), 300)"


def prose_symbols(lines: str = "lines", path: str = "path", line_count: str = "line_count") -> Column:
    """Outline of plain text: the document, then each line led by a capital.

    A heading lasts until the line before the next one; the document symbol is
    named by the file stem and spans everything.
    """
    stem = f"regexp_extract({path}, {lit(STEM_PATTERN)}, 1)"
    heads = (
        f"filter(transform({lines}, (l, i) -> named_struct('line', i + 1, "
        f"'name', regexp_extract(l, {lit(HEADING_PATTERN)}, 1), 'text', l)), x -> x.name <> '')"
    )
    headings = bind(
        heads, "h",
        "transform(h, (x, i) -> named_struct('name', x.name, 'kind', 'heading', 'start_line', x.line, "
        f"'end_line', coalesce(get(h, i + 1).line - 1, {line_count}), 'signature', {_signature('x.text')}))",
    )
    whole = (
        f"named_struct('name', {stem}, 'kind', 'document', 'start_line', 1, 'end_line', {line_count}, "
        f"'signature', {_signature(f'coalesce(get({lines}, 0), {lit(str())})')})"
    )
    return F.expr(f"concat(array({whole}), {headings})")


def with_symbols(corpus: DataFrame, extractor: str = "prose") -> DataFrame:
    """Add ``lines``, ``line_count`` and ``symbols``."""
    files = text.with_lines(corpus).withColumn("line_count", text.line_count("content"))
    if extractor == "prose":
        return files.withColumn("symbols", prose_symbols())
    return files.withColumn("symbols", syntax.code_symbols(paths.language("path"), F.col("content")))


def symbol_rows(files: DataFrame) -> DataFrame:
    """One row per symbol with its ordinal in the file."""
    return unnest(files, "symbols", "s", "path", position="ordinal").select("path", "ordinal", "s.*")


def qualified_parts(name: str) -> tuple[str, str] | None:
    """Split at the last ``.`` or ``::``; None when either side is empty."""
    at, width = max((name.rfind("."), 1), (name.rfind("::"), 2))
    if at < 0:
        return None
    owner, leaf = name[:at], name[at + width:]
    return (owner, leaf) if owner and leaf else None


def qualified_match(symbols: str, symbol: str, requested: str) -> str:
    """SQL: equal name, or the leaf of a qualified name inside a larger owner."""
    exact = f"{symbol}.name = {lit(requested)}"
    parts = qualified_parts(requested)
    if parts is None:
        return exact
    owner = (qualified_parts(parts[0]) or ("", parts[0]))[1]
    contained = (
        f"exists({symbols}, o -> o.name = {lit(owner)} AND o.start_line <= {symbol}.start_line "
        f"AND o.end_line >= {symbol}.end_line AND (o.start_line < {symbol}.start_line OR o.end_line > {symbol}.end_line))"
    )
    return f"{exact} OR ({symbol}.name = {lit(parts[1])} AND {contained})"


def find_symbol(
    files: DataFrame, query: str, *, scope: list[str] | None = None,
    max_results: int = DEFAULT_RESULTS, workspace: str = "main", push: bool = False,
) -> DataFrame:
    """Symbols whose name contains the query, exact before prefix before inner.

    Always folds ASCII case.  Every name occurs in the text or the path of its
    file, so files without the query are dropped before their symbols are built.
    The top-k holds no texts; those of the winners are fetched (``push``: see ``rows.winners``).
    """
    limit = clamp_limit(max_results)
    needle = text.ascii_lower_py(query)
    name = text.ascii_lower("s.name")
    rank = F.when(name == needle, 0).when(name.startswith(needle), 1).otherwise(2)
    holds = text.contains_literal("content", needle, False) | text.contains_literal("path", needle, False)
    named = files.filter(paths.in_scope("path", scope)).filter(holds)
    rows = (
        unnest(named, "symbols", "s", "path", position="ordinal")
        .filter(F.contains(name, F.lit(needle)))
        .select("path", "ordinal", "s", rank.alias("rank"))
        .orderBy("rank", "path", "s.start_line", "ordinal")
        .limit(limit)
    )
    order = ["rank", "path", "start_line", "ordinal"]
    return winners(rows, files, "content", push=push).select(
        "rank", "path", "s.name", "s.kind", "s.start_line", "s.end_line", "s.signature",
        F.when(F.col("rank") == 0, "exact_symbol").when(F.col("rank") == 1, "prefix_symbol")
        .otherwise("contains_symbol").alias("match_type"),
        F.when(F.col("rank") == 0, 1.0).when(F.col("rank") == 1, 0.8).otherwise(0.6).alias("score"),
        handles.range_handle(
            workspace, F.col("path"), F.col("s.start_line"), F.col("s.end_line"),
            handles.content_hash("content"),
        ).alias("handle"), "ordinal",
    ).orderBy(*order).limit(limit).drop("ordinal")


def outline(files: DataFrame, requested: DataFrame) -> DataFrame:
    """Symbols of each requested path; an unknown path yields one error row."""
    found = attach(requested, files, "symbols", F.lit(True).alias("indexed"))
    return found.select(
        "path",
        F.when(F.col("indexed").isNull(), "PATH_NOT_INDEXED").alias("error"),
        F.posexplode_outer("symbols").alias("ordinal", "s"),
    ).select("path", "error", "ordinal", "s.*")


def enclosing_symbol(symbols: str, name: str, line: str) -> str:
    """SQL: name of the smallest symbol around ``line``; null when that symbol is
    the one called ``name`` and starts there (its own declaration)."""
    ranked = (
        f"array_min(transform(filter({symbols}, s -> s.start_line <= {line} AND s.end_line >= {line}), "
        "(s, i) -> named_struct('span', s.end_line - s.start_line, 'i', i, 'name', s.name, 'start', s.start_line)))"
    )
    return bind(ranked, "e", f"if(e.name = {name} AND e.start = {line}, NULL, e.name)")


def at_position(symbols: Column, line: Column) -> Column:
    """The symbol a (path, line) request means: one that starts there, else the
    smallest around it, then by start, end and name."""
    ranked = F.transform(
        symbols,
        lambda s: F.struct(
            (s["start_line"] != line).alias("elsewhere"), (s["end_line"] - s["start_line"]).alias("span"),
            s["start_line"].alias("start_line"), s["end_line"].alias("end_line"),
            s["name"].alias("name"), s["kind"].alias("kind"),
        ),
    )
    return F.array_min(F.filter(ranked, lambda s: (s["start_line"] <= line) & (s["end_line"] >= line)))


def resolve_positions(files: DataFrame, line: Column) -> DataFrame:
    """For each file row and its requested line, the symbol there or an error."""
    hit = files.select("path", line.cast("int").alias("line"), at_position(F.col("symbols"), line).alias("s"))
    return hit.select(
        "path", "line", "s.name", "s.kind", "s.start_line", "s.end_line",
        F.when(F.col("s").isNull(), "SYMBOL_NOT_FOUND").otherwise("").alias("error"),
    )


def definition_at(files: DataFrame, line: Column) -> DataFrame:
    """First symbol in source order around the line (the outermost one)."""
    first = F.get(
        F.filter("symbols", lambda s: (s["start_line"] <= line) & (s["end_line"] >= line)), F.lit(0)
    )
    return files.select("path", line.cast("int").alias("line"), first.alias("s")).select(
        "path", "line", "s.name", "s.kind", "s.start_line", "s.end_line"
    )


def owners(files: DataFrame) -> DataFrame:
    """Each symbol with the smallest strictly larger symbol around it, by one sorted
    fold over the symbols of a file (``functions.intervals``)."""
    spans = F.transform("symbols", lambda s: F.struct(s["start_line"].alias("start_line"), s["end_line"].alias("end_line"), s["name"].alias("name")))
    named = files.select("path", "symbols", owner_names(spans).alias("_owners"))
    return unnest(named, "symbols", "s", "path", "_owners", position="ordinal").select(
        "path", "ordinal", "s.name", "s.start_line", "s.end_line", F.get("_owners", F.col("ordinal")).alias("owner")
    )
