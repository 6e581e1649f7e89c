"""Hunks, status texts, logs.  Inputs are derived from the documents: one diff
and one status text per document, built from its lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import linediff, text
from ..functions.sqltext import lit
from ..operators import hunks, symbols
from ..sources import corpus
from .base import BASE, SYMBOLS, query, with_ctes


def _diffs(spark, sf):
    """Each document as a diff that doubles every line, then adds a second file."""
    files = text.with_lines(corpus.documents(spark, sf))
    header = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n"))
    body = F.expr(
        "array_join(transform(lines, (l, i) -> concat('@@ -', i + 1, ' +', i + 1, ',2 @@ ctx\\n-', l, '\\n+', l, '!\\n+\\n')), '')"
    )
    second = F.concat(
        F.lit("diff --git a/"), "path", F.lit(".new b/"), "path", F.lit(".new\nnew file mode 100644\n--- /dev/null\n+++ b/"), "path",
        F.lit(".new\n@@ -0,0 +1 @@\n+new\n"),
    )
    return files.select("doc_id", F.concat(header, body, second).alias("diff"))


HUNKS = """headed AS (SELECT doc_id, path, lc, ls, 'diff --git a/' || path || ' b/' || path || chr(10) || '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) AS head
  FROM parts JOIN corpus USING (path)),
hunks AS (
  SELECT doc_id, line - 1 AS hunk_no, path, line AS old_start, 1 AS old_count, line AS new_start, 2 AS new_count,
    head || '@@ -' || line || ' +' || line || ',2 @@ ctx' || chr(10) || '-' || text || chr(10) || '+' || text || '!' || chr(10) || '+' || chr(10) AS text
  FROM lines JOIN headed USING (path)
  UNION ALL
  SELECT doc_id, len(ls), path || '.new', 0, 0, 1, 1, 'diff --git a/' || path || '.new b/' || path || '.new' || chr(10) || 'new file mode 100644' || chr(10)
    || '--- /dev/null' || chr(10) || '+++ b/' || path || '.new' || chr(10) || '@@ -0,0 +1 @@' || chr(10) || '+new' || chr(10) FROM headed)"""

ID = "sha256(encode(path) || '\\x00'::BLOB || encode(old_start::VARCHAR) || '\\x00'::BLOB || encode(new_start::VARCHAR) || '\\x00'::BLOB || encode(text))"


@query("hunks_parse", with_ctes(*BASE, HUNKS) + f"SELECT doc_id, hunk_no, path, old_start, old_count, new_start, new_count, text, {ID} AS id FROM hunks")
def hunks_parse(spark, sf):
    return hunks.parse(_diffs(spark, sf), ["doc_id"])


@query("hunks_overlap", with_ctes(*BASE, HUNKS) + """SELECT doc_id, hunk_no, path FROM hunks
WHERE (old_count > 0 AND old_start <= 5 AND old_start + old_count - 1 >= 3) OR (new_count > 0 AND new_start <= 5 AND new_start + new_count - 1 >= 3)""")
def hunks_overlap(spark, sf):
    return hunks.parse(_diffs(spark, sf), ["doc_id"]).filter(hunks.overlaps(3, 5)).select("doc_id", "hunk_no", "path")


@query("hunks_for_symbol", with_ctes(*BASE, SYMBOLS, HUNKS) + """SELECT h.path, s.name AS symbol, s.start_line, hunk_no FROM hunks h JOIN symbols s ON s.path = h.path
WHERE s.kind = 'heading' AND ((old_count > 0 AND old_start <= s.end_line AND old_start + old_count - 1 >= s.start_line)
  OR (new_count > 0 AND new_start <= s.end_line AND new_start + new_count - 1 >= s.start_line))""")
def hunks_for_symbol(spark, sf):
    rows = symbols.symbol_rows(symbols.with_symbols(corpus.documents(spark, sf))).filter(F.col("kind") == "heading")
    parsed = hunks.parse(_diffs(spark, sf), ["doc_id"])
    return hunks.for_symbol(parsed, rows).select("path", "symbol", "start_line", "hunk_no")


@query("hunks_page", with_ctes(*BASE, HUNKS).replace("WITH", "WITH RECURSIVE", 1) + """, sized AS (SELECT doc_id, hunk_no, strlen(text) AS size FROM hunks),
packed AS (
  SELECT doc_id, hunk_no, size, 0 AS page, size AS used FROM sized WHERE hunk_no = 0
  UNION ALL
  SELECT s.doc_id, s.hunk_no, s.size, CASE WHEN used + s.size > 2000 THEN page + 1 ELSE page END, CASE WHEN used + s.size > 2000 THEN s.size ELSE used + s.size END
  FROM packed p JOIN sized s ON s.doc_id = p.doc_id AND s.hunk_no = p.hunk_no + 1)
SELECT doc_id, hunk_no, size, page FROM packed""")
def hunks_page(spark, sf):
    return hunks.paginate(hunks.parse(_diffs(spark, sf), ["doc_id"]), ["doc_id"], 2000)


@query("untracked_patch", with_ctes(*BASE) + """SELECT path, 'diff --git a/' || path || ' b/' || path || chr(10) || 'new file mode 100644' || chr(10) || '--- /dev/null' || chr(10)
  || '+++ b/' || path || chr(10) || array_to_string(list_transform(ls, lambda l: '+' || l || chr(10)), '')
  || CASE WHEN suffix(content, chr(10)) THEN '' ELSE '\\ No newline at end of file' || chr(10) END AS patch FROM parts""".replace("\\\\", "\\"))
def untracked_patch(spark, sf):
    return corpus.documents(spark, sf).select("path", hunks.untracked_patch(F.col("path"), F.col("content")).alias("patch"))


# Status texts: one record per line, its kind by line number, its path by length.
# The old path of a rename looks like a rename record itself.
def _status_texts(spark, sf):
    files = text.with_lines(corpus.documents(spark, sf))
    tail = "N... 100644 100644 100644 aaa bbb "
    name = "concat('a b/', length(l), '.rs')"
    record = (
        f"CASE i % 5 WHEN 0 THEN concat('1 .M {tail}', {name}) WHEN 1 THEN concat('2 R. {tail}R100 ', {name}, {lit(chr(0))}, '2 old/', length(l)) "
        f"WHEN 2 THEN concat('u UU N... 100644 100644 100644 100644 aaa bbb ccc ', {name}) WHEN 3 THEN concat('? ', {name}) ELSE concat('1 MM {tail}', {name}) END"
    )
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# branch.oid c"), "doc_id", F.lit("\0# branch.head main/"), "doc_id", F.lit("\0"))).otherwise(
        F.lit("# branch.oid (initial)\0# branch.head (detached)\0")
    )
    return files.select("doc_id", F.concat(head, F.expr(f"array_join(transform(lines, (l, i) -> {record}), {lit(chr(0))})"), F.lit("\0")).alias("raw"))


@query("porcelain_status", with_ctes(*BASE, """flags AS (
  SELECT doc_id, 'a b/' || length(text) || '.rs' AS path, k IN (1, 2, 4) AS staged, k IN (0, 2, 4) AS unstaged, k = 3 AS untracked
  FROM (SELECT doc_id, text, (line - 1) % 5 AS k FROM lines JOIN corpus USING (path))
  UNION ALL
  SELECT doc_id, '2 old/' || length(text), FALSE, FALSE, FALSE FROM lines JOIN corpus USING (path) WHERE (line - 1) % 5 = 1)""") + """
SELECT doc_id, path, bool_or(staged) AS staged, bool_or(unstaged) AS unstaged, bool_or(untracked) AS untracked,
  bool_or(staged) AND bool_or(unstaged) AS partially_staged FROM flags GROUP BY doc_id, path""")
def porcelain_status(spark, sf):
    return hunks.parse_status(_status_texts(spark, sf), ["doc_id"])


@query("porcelain_header", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'c' || doc_id ELSE '' END AS head,
  CASE WHEN doc_id % 2 = 0 THEN 'main/' || doc_id ELSE '' END AS branch FROM documents""")
def porcelain_header(spark, sf):
    return hunks.status_header(_status_texts(spark, sf), ["doc_id"])


@query("log_rows", with_ctes(*BASE) + """SELECT 'h' || line || '-' || doc_id AS commit, '2024-01-01T00:00:00+00:00' AS date, 'author ' || (line % 3) AS author, text AS subject
FROM lines JOIN corpus USING (path)""")
def log_rows(spark, sf):
    files = text.with_lines(corpus.documents(spark, sf))
    raw = F.expr(
        "array_join(transform(lines, (l, i) -> concat_ws('\\t', concat('h', i + 1, '-', doc_id), '2024-01-01T00:00:00+00:00', concat('author ', (i + 1) % 3), l)), '\\n')"
    )
    logs = files.filter(F.size("lines") > 0).select(F.concat(raw, F.lit("\n")).alias("raw"))
    return hunks.parse_log(logs)


# Each changed line becomes one that exists nowhere else, so the shortest edit
# script removes and adds exactly those lines.
@query("diff_stat", with_ctes(*BASE) + """SELECT p.path, coalesce(n, 0) AS added, coalesce(n, 0) AS removed FROM parts p
LEFT JOIN (SELECT path, count(*) AS n FROM lines WHERE regexp_matches(text, '^(La|The)( |$)') GROUP BY path) USING (path)""")
def diff_stat(spark, sf):
    """Line totals of an edit that changes every line led by "La" or "The"."""
    edited = F.regexp_replace("content", r"(?md)^(?:La|The)(?= |$)", "X")
    files = corpus.documents(spark, sf)
    stat = linediff.diff_stat("content", edited)
    return files.select("path", stat.alias("s")).select("path", "s.added", "s.removed")


@query("unified_diff")
def unified_diff(spark, sf):
    edited = F.regexp_replace("content", r"(?md)^(?:La|The)(?= |$)", "X")
    return corpus.documents(spark, sf).select("path", linediff.unified_diff("path", "content", edited).alias("diff"))
