"""Symbols, positions, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import EngineError
from ..operators import references, symbols
from ..sources import corpus
from .base import BASE, CORPUS, SYMBOLS, TOKENS, document_type_sql, handle_sql, preview_sql, query, with_ctes

TABLE = with_ctes(*BASE, SYMBOLS)


def _files(spark, sf):
    return symbols.with_symbols(corpus.documents(spark, sf))


@query("symbol_table", TABLE + "SELECT path, ordinal, name, kind, start_line, end_line, signature FROM symbols")
def symbol_table(spark, sf):
    return symbols.symbol_rows(_files(spark, sf))


@query("find_symbol_ranked", TABLE + f"""SELECT rank, s.path, name, kind, start_line, end_line, signature,
  (['exact_symbol', 'prefix_symbol', 'contains_symbol'])[rank + 1] AS match_type, ([1.0, 0.8, 0.6])[rank + 1]::DOUBLE AS score,
  {handle_sql('s.path', 'start_line', 'end_line', 'sha256(content)')} AS handle
FROM (SELECT *, CASE WHEN lower(name) = 'er' THEN 0 WHEN prefix(lower(name), 'er') THEN 1 ELSE 2 END AS rank
      FROM symbols WHERE contains(lower(name), 'er')) s JOIN corpus ON corpus.path = s.path
ORDER BY rank, s.path, start_line, ordinal LIMIT 60""")
def find_symbol_ranked(spark, sf):
    return symbols.find_symbol(_files(spark, sf), "ER", max_results=60)


OUTLINE = """wanted AS (SELECT path FROM corpus WHERE prefix(path, 'docs/') UNION ALL SELECT 'missing/' || region.r_name || '.rs' FROM region)"""


@query("outline_partial", with_ctes(*BASE, SYMBOLS, OUTLINE) + """SELECT w.path, CASE WHEN c.path IS NULL THEN 'PATH_NOT_INDEXED' END AS error,
  name, kind FROM wanted w LEFT JOIN corpus c ON c.path = w.path LEFT JOIN symbols s ON s.path = w.path""")
def outline_partial(spark, sf):
    known = corpus.document_paths(spark, sf).filter(F.col("path").startswith("docs/")).select("path")
    region = spark.read.parquet(f"{sf}/region.parquet")
    missing = region.select(F.concat(F.lit("missing/"), "r_name", F.lit(".rs")).alias("path"))
    return symbols.outline(_files(spark, sf), known.unionByName(missing)).select("path", "error", "name", "kind")


POSITION = "asked AS (SELECT parts.path, lc, 1 + doc_id % (lc + 1) AS line FROM parts JOIN corpus USING (path))"


@query("resolve_position", with_ctes(*BASE, SYMBOLS, POSITION) + """SELECT path, line, coalesce(name, '') AS name, coalesce(kind, '') AS kind,
  CASE WHEN name IS NULL THEN 'SYMBOL_NOT_FOUND' ELSE '' END AS error FROM (
  SELECT a.path, a.line, s.name, s.kind, row_number() OVER (PARTITION BY a.path
    ORDER BY s.start_line <> a.line, s.end_line - s.start_line, s.start_line, s.end_line, s.name) AS rn
  FROM asked a LEFT JOIN symbols s ON s.path = a.path AND s.start_line <= a.line AND s.end_line >= a.line) WHERE rn = 1""")
def resolve_position(spark, sf):
    files = _files(spark, sf)
    line = F.col("doc_id") % (F.col("line_count") + 1) + 1
    found = symbols.resolve_positions(files, line)
    return found.select("path", "line", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("kind", F.lit("")).alias("kind"), "error")


@query("definition_at", with_ctes(*BASE, SYMBOLS, POSITION) + """SELECT path, line, coalesce(name, '') AS name FROM (
  SELECT a.path, a.line, s.name, row_number() OVER (PARTITION BY a.path ORDER BY s.ordinal) AS rn
  FROM asked a LEFT JOIN symbols s ON s.path = a.path AND s.start_line <= a.line AND s.end_line >= a.line) WHERE rn = 1""")
def definition_at(spark, sf):
    files = _files(spark, sf)
    found = symbols.definition_at(files, F.col("doc_id") % (F.col("line_count") + 1) + 1)
    return found.select("path", "line", F.coalesce("name", F.lit("")).alias("name"))


@query("symbol_owners", TABLE + """SELECT path, ordinal, name, coalesce(owner, '') AS owner FROM (
  SELECT s.path, s.ordinal, s.name, o.name AS owner, row_number() OVER (PARTITION BY s.path, s.ordinal ORDER BY o.end_line - o.start_line, o.name) AS rn
  FROM symbols s LEFT JOIN symbols o ON o.path = s.path AND o.start_line <= s.start_line AND o.end_line >= s.end_line
    AND (o.start_line < s.start_line OR o.end_line > s.end_line)) WHERE rn = 1""")
def symbol_owners(spark, sf):
    return symbols.owners(_files(spark, sf)).select("path", "ordinal", "name", F.coalesce("owner", F.lit("")).alias("owner"))


@query("qualified_symbol", TABLE + """SELECT s.path, s.name, s.start_line FROM symbols s WHERE s.name = 'Die' AND EXISTS (
  SELECT 1 FROM symbols o WHERE o.path = s.path AND o.name = 'doc_71' AND o.start_line <= s.start_line AND o.end_line >= s.end_line
    AND (o.start_line < s.start_line OR o.end_line > s.end_line))""")
def qualified_symbol(spark, sf):
    return references.definitions(_files(spark, sf), "doc_71::Die").select("path", "name", "start_line")


SPOTS = """line_bytes AS (
  SELECT path, line, text, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM lines),
spots AS (
  SELECT t.path, t.line, t.col, b.start + strlen(left(b.text, (t.col - 1)::BIGINT)) AS start_byte
  FROM tokens t JOIN line_bytes b ON b.path = t.path AND b.line = t.line WHERE t.token = '{name}'),
around AS (
  SELECT p.*, s.name AS sym, s.start_line AS sym_start, row_number() OVER (PARTITION BY p.path, p.start_byte ORDER BY s.end_line - s.start_line, s.ordinal) AS rn
  FROM spots p LEFT JOIN symbols s ON s.path = p.path AND s.start_line <= p.line AND s.end_line >= p.line),
placed AS (SELECT path, line, col, start_byte, CASE WHEN sym = '{name}' AND sym_start = line THEN NULL ELSE sym END AS enclosing FROM around WHERE rn = 1)"""


@query("occurrences_lexical", with_ctes(*BASE, SYMBOLS, TOKENS, SPOTS.format(name="Le")) + "SELECT path, line, col, start_byte FROM placed")
def occurrences_lexical(spark, sf):
    rows = references.occurrence_rows(_files(spark, sf), "Le")
    return rows.select("path", "line", F.col("column").alias("col"), "start_byte")


@query("enclosing_symbol", with_ctes(*BASE, SYMBOLS, TOKENS, SPOTS.format(name="la")) + "SELECT path, start_byte, coalesce(enclosing, '') AS enclosing FROM placed")
def enclosing_symbol(spark, sf):
    rows = references.occurrence_rows(_files(spark, sf), "la")
    return rows.select("path", "start_byte", F.coalesce("enclosing", F.lit("")).alias("enclosing"))


def reference_ctes(name: str, context: int, scope: str) -> list[str]:
    """Windows of all occurrences but the first declaration's own."""
    return [
        *BASE, SYMBOLS, TOKENS, SPOTS.format(name=name),
        f"target AS (SELECT path, start_line FROM symbols WHERE name = '{name}' ORDER BY path, start_line LIMIT 1)",
        "own AS (SELECT p.path, min(p.start_byte) AS start_byte FROM placed p JOIN target t ON t.path = p.path AND p.line >= t.start_line GROUP BY p.path)",
        f"kept AS (SELECT p.*, lc FROM placed p JOIN parts USING (path) ANTI JOIN own ON own.path = p.path AND own.start_byte = p.start_byte WHERE {scope})",
        f"ranged AS (SELECT *, greatest(line - {context}, 1) AS s, least(line + {context}, lc) AS e FROM kept)",
        "opened AS (SELECT *, CASE WHEN s <= lag(e) OVER (PARTITION BY path ORDER BY start_byte) + 1 THEN 0 ELSE 1 END AS opens FROM ranged)",
        "island AS (SELECT *, sum(opens) OVER (PARTITION BY path ORDER BY start_byte) AS g FROM opened)",
        "chunked AS (SELECT *, (row_number() OVER (PARTITION BY path, g ORDER BY start_byte) - 1) // 3 AS c FROM island)",
        """refs AS (SELECT path, min(line) AS line, min(s) AS start_line, max(e) AS end_line, count(*) AS occurrences, arg_min(coalesce(enclosing, ''), start_byte) AS enclosing_symbol,
            string_agg(line || ':' || col::BIGINT || ':' || start_byte::BIGINT, ' ' ORDER BY start_byte) AS positions, min(start_byte) AS first_byte FROM chunked GROUP BY path, g, c)""",
        "turned AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, first_byte) - 1 AS turn FROM refs)",
    ]


def references_sql(name: str, context: int, limit: int, scope: str = "TRUE") -> str:
    return with_ctes(*reference_ctes(name, context, scope), f"""picked AS (
  SELECT * FROM turned WHERE turn < 3 ORDER BY turn, path LIMIT {limit})""") + f"""SELECT path, line, start_line, end_line,
  'other' AS reference_kind, 'lexical' AS classification_evidence, enclosing_symbol, occurrences, positions,
  {preview_sql()} AS preview, {handle_sql('path', 'start_line', 'end_line', 'sha256(content)')} AS handle,
  'reference' AS match_type, 0.5::DOUBLE AS score, 'other_reference' AS reason FROM picked JOIN parts USING (path)"""


def totals_sql(name: str, context: int, limit: int, scope: str = "TRUE") -> str:
    return with_ctes(*reference_ctes(name, context, scope), "per_file AS (SELECT path, sum(occurrences) AS o, count(*) AS n FROM refs GROUP BY path)") + f"""
SELECT sum(o)::BIGINT AS occurrence_count, sum(n)::BIGINT AS total_windows, least(sum(least(n, 3)), {limit})::BIGINT AS result_count,
  sum(n) > least(sum(least(n, 3)), {limit}) AS truncated FROM per_file"""


PRODUCTION = f"{document_type_sql()} = 'source' AND NOT prefix(path, 'docs/') AND NOT prefix(path, 'examples/')"
TESTS = f"{document_type_sql()} = 'test'"


def _first_target(files, name):
    """The first declaration in path order, resolved by its path and line."""
    row = references.definitions(files, name).orderBy("path", "start_line").limit(1).collect()
    if not row:
        raise EngineError("SYMBOL_NOT_FOUND", "no indexed declaration", symbol=name)
    r = row[0]
    return references.Target(r["name"], r["kind"], r["path"], r["start_line"], r["end_line"], r["start_byte"], r["end_byte"])


def _references(files, **options):
    found = references.find_references(files, _first_target(files, "Le"), **options)
    return found.withColumn("enclosing_symbol", F.coalesce("enclosing_symbol", F.lit("")))


@query("references_lexical", references_sql("Le", 1, 50))
def references_lexical(spark, sf):
    return _references(_files(spark, sf), context=1, max_results=50)


@query("references_scope_tests", references_sql("Le", 0, 40, TESTS))
def references_scope_tests(spark, sf):
    return _references(_files(spark, sf), context=0, max_results=40, reference_scope="tests")


@query("references_scope_production", references_sql("Le", 2, 40, PRODUCTION))
def references_scope_production(spark, sf):
    return _references(_files(spark, sf), context=2, max_results=40, reference_scope="production")


@query("references_totals", totals_sql("Le", 1, 50))
def references_totals(spark, sf):
    files = _files(spark, sf)
    return references.reference_summary(files, _first_target(files, "Le"), context=1, max_results=50)


@query("scanned_scope", with_ctes(CORPUS) + f"SELECT count(*) AS file_count, sum(strlen(content)) AS byte_count FROM corpus WHERE {PRODUCTION}")
def scanned_scope(spark, sf):
    return references.scanned_scope(corpus.documents(spark, sf), "production")


@query("identifiers", with_ctes(*BASE, TOKENS) + """SELECT path, line, count(*) AS tokens, sum(col * length(token))::BIGINT AS weight, sum(unicode(token))::BIGINT AS heads
FROM tokens GROUP BY path, line""")
def identifiers(spark, sf):
    rows = references.identifiers(corpus.documents(spark, sf))
    return rows.groupBy("path", "line").agg(
        F.count("*").alias("tokens"), F.sum(F.col("column") * F.length("token")).alias("weight"), F.sum(F.ascii("token")).alias("heads")
    )


@query("reference_counts", with_ctes(*BASE, SYMBOLS, TOKENS) + """SELECT d.name, declarations, coalesce(occurrences, 0) AS occurrences
FROM (SELECT name, count(*) AS declarations FROM symbols GROUP BY name) d
LEFT JOIN (SELECT token, count(*) AS occurrences FROM tokens GROUP BY token) u ON u.token = d.name""")
def reference_counts(spark, sf):
    return references.reference_counts(_files(spark, sf))


@query("semantic_dedup", with_ctes(*BASE, SYMBOLS, TOKENS, SPOTS.format(name="la"), """locations AS (
  SELECT DISTINCT path, line AS start_line, col AS start_column, line AS end_line, col + 2 AS end_column FROM placed
  UNION SELECT 'gone/' || r_name, 1, 1, 1, 3 FROM region)""", """picked AS (
  SELECT * FROM locations WHERE NOT (path = 'docs/src1/en/doc_21.txt' AND start_line = 1 AND start_column = 1)
  ORDER BY path, start_line, start_column, end_line, end_column LIMIT 100)""") + f"""SELECT k.path, start_line, start_column::BIGINT AS start_column, end_line,
  end_column::BIGINT AS end_column, {preview_sql()} AS preview, {handle_sql('k.path', 'start_line', 'end_line', 'sha256(content)')} AS handle
FROM picked k LEFT JOIN parts ON parts.path = k.path""")
def semantic_dedup(spark, sf):
    files = _files(spark, sf)
    spots = references.occurrence_rows(files, "la")
    located = spots.select(
        "path", F.col("line").alias("start_line"), F.col("column").alias("start_column"),
        F.col("line").alias("end_line"), (F.col("column") + 2).alias("end_column"),
    )
    region = spark.read.parquet(f"{sf}/region.parquet")
    gone = region.select(F.concat(F.lit("gone/"), "r_name").alias("path"), *[F.lit(v).alias(n) for n, v in
                         (("start_line", 1), ("start_column", 1), ("end_line", 1), ("end_column", 3))])
    # The same location reported twice counts once.
    return references.semantic_references(
        corpus.documents(spark, sf).select("path", "content"), located.unionByName(located).unionByName(gone),
        target_path="docs/src1/en/doc_21.txt", target_line=1, target_column=1, max_results=100,
    )


@query("read_symbol", TABLE + """SELECT s.path, name, kind, greatest(start_line - 1, 1) AS start_line, least(end_line + 1, lc) AS end_line,
  ltrim(array_to_string(ls[greatest(start_line - 1, 1):least(end_line + 1, lc)], chr(10)), chr(10)) AS content
FROM symbols s JOIN parts USING (path) WHERE name = 'Le'""")
def read_symbol(spark, sf):
    from ..operators import reads

    return reads.read_symbols(_files(spark, sf), "Le", surrounding=1)
