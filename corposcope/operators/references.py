"""Exact-identifier references: occurrences, roles, windows, fair merging."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import handles, paths, syntax, text
from ..functions.rows import attach, unnest, winners
from ..functions.sqltext import bind, choose, in_list, lit
from ..functions.terms import IDENTIFIER_CLASS
from .search import clamp_limit
from .symbols import enclosing_symbol, qualified_match, qualified_parts

# Limits of a reference request.
MAX_PER_WINDOW = 3
MAX_PER_FILE = 3
MAX_CANDIDATES = 20

# Rank and score of each role.
KIND_PRIORITY = {"declaration": 0, "call": 1, "write": 2, "type": 3, "import": 4, "read": 5, "other": 6}
KIND_SCORE = {"declaration": 1.0, "call": 1.0, "write": 0.9, "type": 0.85, "import": 0.75, "read": 0.65, "other": 0.5}

SPOT = "STRUCT<line: INT, column: INT, start_byte: INT, end_byte: INT, role: STRING, evidence: STRING, enclosing: STRING>"
WINDOW = (
    "STRUCT<line: INT, start_line: INT, end_line: INT, kind: STRING, evidence: STRING, "
    f"enclosing: STRING, occurrences: ARRAY<{SPOT}>>"
)


@dataclass(frozen=True)
class Target:
    """One resolved declaration."""

    name: str
    kind: str
    path: str
    start_line: int
    end_line: int
    start_byte: int | None = None
    end_byte: int | None = None


def _is_identifier_char(ch: str) -> bool:
    """The characters of ``terms.IDENTIFIER_CLASS``."""
    if ch in "_$\u200c\u200d" or ch.isalnum():
        return True
    return any(a <= ch <= b for a, b in ("\u0300\u036f", "\u1ab0\u1aff", "\u1dc0\u1dff", "\u20d0\u20ff", "\ufe20\ufe2f"))


def is_identifier(name: str) -> bool:
    """Whether the exact occurrences of a name are the identifier runs equal to it."""
    return bool(name) and all(map(_is_identifier_char, name))


def _line_occurrences(line: str, name: str) -> str:
    """SQL: array of (column, byte) of whole-identifier matches of ``name``.

    Raw matches do not overlap; each is then kept only when neither neighbour
    continues an identifier.  One fold over the pieces between raw matches; a
    final LF ends the last piece, so an empty piece always lies between matches.
    """
    size, width = len(name.encode()), len(name)
    head, tail = (str(_is_identifier_char(c)).lower() for c in (name[0], name[-1]))
    spot = "struct<column: int, byte: int>"
    zero = (
        f"named_struct('out', cast(array() AS array<{spot}>), 'chars', 0, 'bytes', 0, "
        f"'pending', cast(NULL AS {spot}), 'blocked', false)"
    )
    joins_next = f"if(p = '', {head}, p RLIKE {lit(f'^[{IDENTIFIER_CLASS}]')})"
    joins_prev = f"if(p = '', {tail} AND acc.pending IS NOT NULL, p RLIKE {lit(f'[{IDENTIFIER_CLASS}]' + chr(92) + 'z')})"
    step = (
        f"named_struct('out', if(acc.pending IS NOT NULL AND NOT acc.blocked AND NOT {joins_next}, "
        "concat(acc.out, array(acc.pending)), acc.out), "
        f"'chars', acc.chars + length(p) + {width}, 'bytes', acc.bytes + octet_length(p) + {size}, "
        "'pending', named_struct('column', acc.chars + length(p) + 1, 'byte', acc.bytes + octet_length(p)), "
        f"'blocked', {joins_prev})"
    )
    return f"aggregate(split(concat({line}, '\\n'), {lit(text.java_quote(name))}, -1), {zero}, (acc, p) -> {step}).out"


def occurrences(name: str, content: str = "content") -> str:
    """SQL: array of (line, column, start_byte, end_byte) in text order."""
    size = len(name.encode())
    numbered = bind(
        f"split({content}, '\\n', -1)", "r",
        bind(
            text.line_starts("r"), "b",
            "transform(r, (t, i) -> named_struct('line', i + 1, 'text', t, 'start', get(b, i)))",
        ),
    )
    return (
        f"flatten(transform(filter({numbered}, z -> contains(z.text, {lit(name)})), "
        f"z -> transform({_line_occurrences('z.text', name)}, o -> named_struct('line', z.line, 'column', o.column, "
        f"'start_byte', z.start + o.byte, 'end_byte', z.start + o.byte + {size}))))"
    )


def _spots(name: str) -> str:
    """SQL: occurrences with role, evidence and enclosing symbol, given the columns
    content, symbols and _marks."""
    spot = bind(
        "get(filter(b.marks, m -> m.start_byte = o.start_byte), 0)", "m",
        "named_struct('line', o.line, 'column', o.column, 'start_byte', o.start_byte, 'end_byte', o.end_byte, "
        "'role', coalesce(m.role, 'other'), 'evidence', if(m IS NULL, 'lexical', 'syntactic'), "
        f"'enclosing', coalesce(m.enclosing, {enclosing_symbol('b.symbols', lit(name), 'o.line')}))",
    )
    spots = bind(
        "named_struct('symbols', symbols, 'marks', _marks)", "b", f"transform({occurrences(name)}, o -> {spot})"
    )
    return f"cast({spots} AS array<{SPOT}>)"


def _with_marks(files: DataFrame, name: str, parsed: bool) -> DataFrame:
    """Add ``_marks``: what a parser says about ``name``, or nothing without one."""
    if not parsed:
        return files.selectExpr("*", f"cast(array() AS {syntax.MARKS_TYPE.simpleString()}) AS _marks")
    return files.withColumn("_marks", syntax.role_marks(name)(paths.language("path"), F.col("content")))


def with_occurrences(files: DataFrame, name: str, parsed: bool = False) -> DataFrame:
    """Files holding ``name`` with ``spots``: position, role, evidence, enclosing.

    Without a parser every role is ``other``; with one, a syntactic mark at the
    same bytes gives role and enclosing symbol but never removes a hit.
    """
    hits = _with_marks(files.where(f"contains(content, {lit(name)})"), name, parsed)
    return hits.selectExpr("* EXCEPT (_marks)", f"{_spots(name)} AS spots")


def occurrence_rows(files: DataFrame, name: str, parsed: bool = False) -> DataFrame:
    return unnest(with_occurrences(files, name, parsed), "spots", "o", "path").select("path", "o.*")


def definitions(
    files: DataFrame, selector: str, path: str | None = None, line: int | None = None, parsed: bool = False
) -> DataFrame:
    """Declarations the selector can mean, each with its declaring occurrence."""
    selector = selector.strip()
    if not selector:
        raise EngineError("INVALID_REQUEST", "a reference query needs a symbol")
    leaf = (qualified_parts(selector) or ("", selector))[1]
    # A full name equal to the selector is also accepted, whatever its form.
    wanted = f"x.name IN {in_list(sorted({selector, leaf}))}" + ("" if line is None else f" AND x.start_line = {int(line)}")
    tests = [f"(contains(path, {lit(leaf)}) OR contains(content, {lit(leaf)}))"]
    if path is not None:
        tests.append(f"path = {lit(paths.normalize_path(path))}")
    rows = (
        files.where(" AND ".join(tests))
        .selectExpr("path", "content", "symbols", f"explode_outer(filter(symbols, x -> {wanted})) AS s")
        .where(f"s IS NOT NULL AND ({qualified_match('symbols', 's', selector)})")
    )
    declared = "filter(inside, o -> exists(_marks, m -> m.start_byte = o.start_byte AND m.role = 'declaration'))"
    return (
        _with_marks(rows, leaf, parsed)
        .selectExpr("path", "s", "_marks", f"filter({occurrences(leaf)}, o -> o.line >= s.start_line AND o.line <= s.end_line) AS inside")
        .selectExpr("path", "s.*", f"coalesce(get({declared}, 0), get(inside, 0)) AS picked")
        .selectExpr("* EXCEPT (picked)", "picked.start_byte", "picked.end_byte")
    )


def resolve_symbol(
    files: DataFrame, selector: str, path: str | None = None, line: int | None = None, parsed: bool = False
) -> Target:
    """The one declaration meant; the driver sees at most 21 candidate rows."""
    found = (
        definitions(files, selector, path, line, parsed)
        .orderBy("path", "start_line", "end_line")
        .limit(MAX_CANDIDATES + 1)
        .collect()
    )
    if not found:
        raise EngineError("SYMBOL_NOT_FOUND", "no indexed declaration", symbol=selector)
    if len(found) > 1:
        raise EngineError(
            "AMBIGUOUS_SYMBOL", "several declarations; give path and line", symbol=selector,
            candidates=[r.asDict() for r in found[:MAX_CANDIDATES]],
        )
    row = found[0]
    return Target(row["name"], row["kind"], row["path"], row["start_line"], row["end_line"], row["start_byte"], row["end_byte"])


def fold_windows(spots: str, context: int, line_count: str) -> str:
    """SQL: windows over ordered occurrences, at most three occurrences in each.

    A window takes the role, evidence and enclosing symbol of its best-ranked
    occurrence and keeps the line of its first.
    """
    start, end = f"greatest(o.line - {context}, 1)", f"least(o.line + {context}, {line_count})"
    better = f"{choose('o.role', KIND_PRIORITY, 6)} < {choose('w.kind', KIND_PRIORITY, 6)}"
    extended = (
        f"named_struct('line', w.line, 'start_line', w.start_line, 'end_line', greatest(w.end_line, {end}), "
        f"'kind', if({better}, o.role, w.kind), 'evidence', if({better}, o.evidence, w.evidence), "
        f"'enclosing', if({better}, o.enclosing, w.enclosing), 'occurrences', concat(w.occurrences, array(o)))"
    )
    fresh = (
        f"named_struct('line', o.line, 'start_line', {start}, 'end_line', {end}, 'kind', o.role, "
        "'evidence', o.evidence, 'enclosing', o.enclosing, 'occurrences', array(o))"
    )
    joins = f"w IS NOT NULL AND {start} <= w.end_line + 1 AND size(w.occurrences) < {MAX_PER_WINDOW}"
    step = bind(
        "acc.open", "w",
        f"if({joins}, named_struct('done', acc.done, 'open', cast({extended} AS {WINDOW})), "
        "named_struct('done', if(w IS NOT NULL, concat(acc.done, array(w)), acc.done), "
        f"'open', cast({fresh} AS {WINDOW})))",
    )
    zero = f"named_struct('done', cast(array() AS array<{WINDOW}>), 'open', cast(NULL AS {WINDOW}))"
    finish = "acc -> if(acc.open IS NOT NULL, concat(acc.done, array(acc.open)), acc.done)"
    return f"aggregate({spots}, {zero}, (acc, o) -> {step}, {finish})"


def _in_scope(files: DataFrame, reference_scope: str, scope: list[str] | None) -> DataFrame:
    if scope:
        files = files.filter(paths.in_scope("path", scope))
    if reference_scope in ("", "all"):
        return files
    return files.filter(paths.in_reference_scope(reference_scope, "path", paths.document_type("path")))


def reference_windows(
    files: DataFrame, target: Target, *, reference_scope: str = "all", scope: list[str] | None = None,
    kinds: list[str] | None = None, context: int = 2, parsed: bool = False,
) -> DataFrame:
    """One row per file: its remaining occurrences and all of their windows."""
    unknown = set(kinds or []) - set(KIND_PRIORITY)
    if unknown:
        raise EngineError("INVALID_REQUEST", "unsupported reference kind", kinds=sorted(unknown))
    if reference_scope not in ("all", "tests", "production"):
        raise EngineError("INVALID_REQUEST", "reference scope must be all, production or tests")
    tests = []
    if target.start_byte is not None:
        tests.append(f"NOT (path = {lit(target.path)} AND o.start_byte = {target.start_byte})")
    if kinds:
        tests.append(f"o.role IN {in_list(kinds)}")
    hits = with_occurrences(_in_scope(files, reference_scope, scope), target.name, parsed)
    kept = f"filter(spots, o -> {' AND '.join(tests) or 'true'})"
    return hits.selectExpr("path", "content", "line_count", f"{kept} AS _kept").selectExpr(
        "path", "content", "size(_kept) AS occurrence_count", f"{fold_windows('_kept', context, 'line_count')} AS windows"
    )


def find_references(
    files: DataFrame, target: Target, *, reference_scope: str = "all", scope: list[str] | None = None,
    kinds: list[str] | None = None, context: int = 2, max_results: int = 20, parsed: bool = False,
    workspace: str = "main", push: bool = False,
) -> DataFrame:
    """Reference windows, best role first in a file, then in turn across files.

    Every file in scope is looked at: term pruning never hides a reference.  The
    declaration itself is listed only when that kind is asked for.
    """
    limit = clamp_limit(max_results)
    cap = max(1, min(limit, MAX_PER_FILE))
    per_file = reference_windows(
        files, target, reference_scope=reference_scope, scope=scope, kinds=kinds, context=context, parsed=parsed
    )
    ranked = (
        f"slice(array_sort(transform(windows, (w, i) -> named_struct('p', {choose('w.kind', KIND_PRIORITY, 6)}, "
        f"'l', w.line, 'i', i, 'w', w))), 1, {cap})"
    )
    rows = (
        per_file.selectExpr("path", f"{ranked} AS ranked")
        .selectExpr("path", "get(ranked, 0).p AS group_priority", "posexplode_outer(ranked) AS (turn, r)")
        .where("r IS NOT NULL")
        .selectExpr("path", "group_priority", "turn", "1 AS after_declaration", "r.w AS w", "'reference' AS match_type")
    )
    if kinds and "declaration" in kinds:
        rows = rows.unionByName(_declaration_group(files, target, reference_scope, scope, parsed))
    # No text takes part in the top-k; those of the winners are fetched.
    order = ["turn", "group_priority", "after_declaration", "path"]
    found = winners(rows.orderBy(*order).limit(limit), files, "content", push=push)
    return found.selectExpr(
        "turn", "group_priority", "after_declaration", "path", "w.line", "w.start_line", "w.end_line", "w.kind AS reference_kind",
        "w.evidence AS classification_evidence", "w.enclosing AS enclosing_symbol",
        "size(w.occurrences) AS occurrences",
        "array_join(transform(w.occurrences, o -> concat_ws(':', o.line, o.column, o.start_byte)), ' ') AS positions",
        f"{text.preview('w.start_line', 'w.end_line')} AS preview",
        f"{handles.range_handle_sql(workspace, 'w.start_line', 'w.end_line')} AS handle",
        "match_type",
        f"{choose('w.kind', KIND_SCORE, 0.5)} AS score",
        "if(match_type = 'declaration', 'declaration_match', concat(w.kind, '_reference')) AS reason",
    ).orderBy(*order).limit(limit).drop("turn", "group_priority", "after_declaration")


def _declaration_group(files: DataFrame, target: Target, reference_scope: str, scope, parsed: bool) -> DataFrame:
    own = _in_scope(files, reference_scope, scope).where(f"path = {lit(target.path)}")
    picked = "get(picked, 0)"
    wanted = "false" if target.start_byte is None else f"o.start_byte = {target.start_byte}"
    return _with_marks(own, target.name, parsed).selectExpr(
        "path", "content", f"filter({_spots(target.name)}, o -> {wanted}) AS picked"
    ).selectExpr(
        "path", "0 AS group_priority", "0 AS turn", "0 AS after_declaration",
        f"cast(named_struct('line', coalesce({picked}.line, {target.start_line}), 'start_line', {target.start_line}, "
        f"'end_line', {target.end_line}, 'kind', 'declaration', 'evidence', 'syntactic', "
        f"'enclosing', {picked}.enclosing, 'occurrences', picked) AS {WINDOW}) AS w",
        "'declaration' AS match_type",
    )


def reference_summary(
    files: DataFrame, target: Target, *, reference_scope: str = "all", scope: list[str] | None = None,
    kinds: list[str] | None = None, context: int = 2, max_results: int = 20, parsed: bool = False,
) -> DataFrame:
    """Occurrence and window totals, rows returned, and whether any were cut."""
    limit = clamp_limit(max_results)
    cap = max(1, min(limit, MAX_PER_FILE))
    per_file = reference_windows(
        files, target, reference_scope=reference_scope, scope=scope, kinds=kinds, context=context, parsed=parsed
    ).select("occurrence_count", F.size("windows").alias("n"))
    totals = per_file.agg(
        F.coalesce(F.sum("occurrence_count"), F.lit(0)).alias("occurrence_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_windows"),
        F.coalesce(F.sum(F.least("n", F.lit(cap))), F.lit(0)).alias("kept"),
    )
    kept = F.least("kept", F.lit(limit))
    return totals.select(
        "occurrence_count", "total_windows", kept.alias("result_count"), (F.col("total_windows") > kept).alias("truncated")
    )


def scanned_scope(corpus: DataFrame, reference_scope: str, scope: list[str] | None = None) -> DataFrame:
    """Files and bytes a reference query looks at."""
    return _in_scope(corpus, reference_scope, scope).agg(
        F.count("*").alias("file_count"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("byte_count")
    )


def identifiers(corpus: DataFrame) -> DataFrame:
    """Every identifier run with line and column: references as an equi-join.

    For a name made of identifier characters, its exact occurrences are the runs
    equal to it, so references to all symbols are one join on ``token``.
    """
    lines = unnest(text.with_lines(corpus.select("path", "content")), "lines", "text", "path", position="index")
    run = f"[{IDENTIFIER_CLASS}]+"
    placed = F.expr(
        bind(
            f"regexp_extract_all(text, {lit(run)}, 0)", "tokens",
            bind(
                text.running_offsets(
                    f"transform(split(text, {lit(run)}, -1), (g, i) -> named_struct('gap', length(g), "
                    "'width', coalesce(length(get(tokens, i)), 0)))",
                    "x.gap", "x.width",
                ),
                "offsets",
                "transform(tokens, (t, i) -> named_struct('token', t, 'column', get(offsets, i) + 1))",
            ),
        )
    )
    return unnest(lines, placed, "t", "path", (F.col("index") + 1).alias("line")).select(
        "path", "line", "t.token", "t.column"
    )


def files_with_identifier(files: DataFrame, identifier_rows: DataFrame, name: str) -> DataFrame:
    """Files that a stored identifier table lists for ``name``.

    The table is sorted by token, so the filter reads few row groups; the files
    found are then scanned exactly.  Valid for names of identifier characters,
    whose occurrences are exactly the runs in the table.
    """
    hits = identifier_rows.filter(F.col("token") == name).select("path").distinct()
    return files.join(hits, "path", "left_semi")


def reference_counts(files: DataFrame) -> DataFrame:
    """For every declared name, its declarations and its exact occurrences.

    One scan and one exchange: declared names travel with the tokens, marked by a
    leading NUL that no identifier holds.  Both are counted per task first, so a
    token that fills a third of the corpus is shuffled as one row per task.
    """
    run = lit(f"[{IDENTIFIER_CLASS}]+")
    both = f"concat(regexp_extract_all(content, {run}, 0), transform(symbols, s -> concat('\\0', s.name)))"
    marked = unnest(files, F.expr(both), "t").selectExpr(
        "if(startswith(t, '\\0'), substr(t, 2), t) AS name", "startswith(t, '\\0') AS declared"
    )
    counts = marked.groupBy("name").agg(
        F.count_if("declared").alias("declarations"), F.count_if(~F.col("declared")).alias("occurrences")
    )
    return counts.filter(F.col("declarations") > 0)


def semantic_references(
    corpus: DataFrame, locations: DataFrame, *, target_path: str | None = None, target_line: int | None = None,
    target_column: int | None = None, max_results: int = 20, workspace: str = "main",
) -> DataFrame:
    """Locations from an outside resolver: dedup, drop the target, top-k, attach text.

    ``locations`` has path, start_line, start_column, end_line, end_column.  The
    limited rows (at most 200) are broadcast to the corpus.
    """
    limit = clamp_limit(max_results)
    keys = ["path", "start_line", "start_column", "end_line", "end_column"]
    rows = locations.select(*keys).dropDuplicates()
    if target_path is not None:
        rows = rows.filter(
            ~(
                (F.col("path") == target_path) & (F.col("start_line") == target_line)
                & (F.col("start_column") == target_column)
            )
        )
    top = rows.orderBy(*keys).limit(limit)
    found = attach(top, corpus, "content")
    return found.select(
        *keys,
        F.when(
            F.col("content").isNotNull(),
            text.join_lines(text.split_lines("content"), F.col("start_line"), F.col("end_line")),
        ).alias("preview"),
        F.when(
            F.col("content").isNotNull(),
            handles.range_handle(workspace, F.col("path"), F.col("start_line"), F.col("end_line"), handles.content_hash("content")),
        ).alias("handle"),
    )
