"""Edit plans.  The changes are derived from the documents and their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import handles, positions
from ..operators import edit_requests, edits, symbols
from ..sources import corpus
from .base import BASE, CORPUS, RUN, SYMBOLS, query, with_ctes

FIRST_WORD = r"^(\p{L}+)"
TWO_WORDS = r"^(\p{L}+ \p{L}+)"
# Stands for the needle where a text has none: it occurs nowhere.
NO_NEEDLE = "zzqq"


def _needle(pattern: str):
    found = F.regexp_extract("content", pattern, 1)
    return F.when(found == "", NO_NEEDLE).otherwise(found)


def needle_sql(pattern: str) -> str:
    return f"coalesce(nullif(regexp_extract(content, '{pattern}', 1), ''), '{NO_NEEDLE}')"


@query("edit_exact_count", with_ctes(CORPUS, f"asked AS (SELECT path, content, {needle_sql(FIRST_WORD)} AS old, 1 + doc_id % 3 AS expected FROM corpus)") + """
SELECT path, actual, CASE WHEN actual <> expected THEN 'EXACT_MATCH_COUNT' ELSE '' END AS error,
  CASE WHEN actual = expected THEN sha256(replace(content, old, 'REPLACED')) ELSE '' END AS after_hash
FROM (SELECT *, (strlen(content) - strlen(replace(content, old, ''))) // strlen(old) AS actual FROM asked)""")
def edit_exact_count(spark, sf):
    files = corpus.documents(spark, sf).withColumn("old", _needle(FIRST_WORD))
    plan = edits.replace_exact(files, F.col("old"), F.lit("REPLACED"), (F.col("doc_id") % 3 + 1).cast("int"))
    return plan.select(
        "path", "actual", F.coalesce("error", F.lit("")).alias("error"),
        F.coalesce(handles.content_hash("after"), F.lit("")).alias("after_hash"),
    )


@query("edit_replace_crlf", with_ctes(CORPUS) + """SELECT path, CASE WHEN n = 1 THEN '' ELSE 'EXACT_MATCH_COUNT' END AS error,
  CASE WHEN n = 1 THEN sha256(replace(replace(content, chr(10), chr(13) || chr(10)), two, 'A' || chr(13) || chr(10) || 'B' || chr(13) || chr(10))) ELSE '' END AS after_hash
FROM (SELECT path, content, string_split(content, chr(10))[1] || chr(13) || chr(10) AS two,
        (strlen(c) - strlen(replace(c, string_split(content, chr(10))[1] || chr(13) || chr(10), ''))) // (strlen(string_split(content, chr(10))[1]) + 2) AS n
      FROM (SELECT path, content, replace(content, chr(10), chr(13) || chr(10)) AS c FROM corpus))""")
def edit_replace_crlf(spark, sf):
    """LF needles against CR LF files: the needle and the new text take CR LF."""
    files = corpus.documents(spark, sf).withColumn("content", F.replace("content", F.lit("\n"), F.lit("\r\n")))
    first = F.concat(F.regexp_extract("content", r"^([^\r\n]*)", 1), F.lit("\n"))
    plan = edits.replace_exact(files, first, F.lit("A\nB"))
    return plan.select("path", F.coalesce("error", F.lit("")).alias("error"), F.coalesce(handles.content_hash("after"), F.lit("")).alias("after_hash"))


@query("edit_replace_lines", with_ctes(*BASE) + """SELECT path, sha256(array_to_string(ls2[1:1], chr(10)) || CASE WHEN len(ls2) > 1 THEN chr(10) ELSE '' END || mid || rest) AS after_hash
FROM (SELECT path, string_split(content, chr(10)) AS ls2,
  CASE WHEN len(string_split(content, chr(10))) <= 1 THEN 'NEW' WHEN len(string_split(content, chr(10))) > 3 THEN 'NEW' || chr(10) ELSE
    CASE WHEN suffix(content, chr(10)) THEN 'NEW' || chr(10) ELSE 'NEW' END END AS mid,
  CASE WHEN len(string_split(content, chr(10))) > 3 THEN array_to_string(string_split(content, chr(10))[4:], chr(10)) ELSE '' END AS rest FROM parts)
WHERE len(ls2) > 1""")
def edit_replace_lines(spark, sf):
    files = corpus.documents(spark, sf).filter(F.contains("content", F.lit("\n")))
    plan = edits.replace_lines(files, F.lit(2), F.lit(3), F.lit("NEW"))
    return plan.select("path", handles.content_hash("after").alias("after_hash"))


INSERT = with_ctes(*BASE, SYMBOLS, "anchors AS (SELECT path, min(start_line) AS a FROM symbols WHERE name = 'Le' GROUP BY path)")


@query("edit_insert_before", INSERT + """SELECT p.path, CASE WHEN a IS NULL THEN 'SYMBOL_NOT_FOUND' ELSE '' END AS error,
  CASE WHEN a IS NULL THEN '' ELSE sha256(array_to_string(list_concat(x[1:a - 1], ['INSERTED'], x[a:]), chr(10))) END AS after_hash
FROM (SELECT path, string_split(content, chr(10)) AS x FROM parts) p LEFT JOIN anchors USING (path)""")
def edit_insert_before(spark, sf):
    files = symbols.with_symbols(corpus.documents(spark, sf))
    plan = edits.insert_at_symbol(files, F.lit("Le"), "before", F.lit("INSERTED\n"))
    return plan.select("path", F.coalesce("error", F.lit("")).alias("error"), F.coalesce(handles.content_hash("after"), F.lit("")).alias("after_hash"))


@query("edit_insert_after", with_ctes(*BASE, SYMBOLS, "anchors AS (SELECT path, arg_min(end_line, start_line) AS b FROM symbols WHERE name = 'Le' GROUP BY path)") + """
SELECT path, CASE WHEN b IS NULL THEN 'SYMBOL_NOT_FOUND' ELSE '' END AS error, CASE WHEN b IS NULL THEN '' WHEN b >= len(x) THEN sha256(content || 'INSERTED' || chr(10))
  ELSE sha256(array_to_string(list_concat(x[1:b], ['INSERTED'], x[b + 1:]), chr(10))) END AS after_hash
FROM (SELECT path, content, string_split(content, chr(10)) AS x FROM parts) LEFT JOIN anchors USING (path)""")
def edit_insert_after(spark, sf):
    files = symbols.with_symbols(corpus.documents(spark, sf))
    plan = edits.insert_at_symbol(files, F.lit("Le"), "after", F.lit("INSERTED\n"))
    return plan.select("path", F.coalesce("error", F.lit("")).alias("error"), F.coalesce(handles.content_hash("after"), F.lit("")).alias("after_hash"))


@query("edit_plan_create", with_ctes(CORPUS, """wanted AS (SELECT path, 'new text' AS content, quality = 1 AS overwrite FROM corpus JOIN labels USING (doc_id)
  UNION ALL SELECT 'fresh/' || n_name || '.md', n_name, FALSE FROM nation)""") + """SELECT w.path, CASE WHEN c.path IS NOT NULL AND NOT overwrite THEN 'PATH_EXISTS' ELSE '' END AS error,
  CASE WHEN c.path IS NOT NULL AND NOT overwrite THEN '' ELSE w.content END AS after FROM wanted w LEFT JOIN corpus c ON c.path = w.path""")
def edit_plan_create(spark, sf):
    files = corpus.documents(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    wanted = files.select("doc_id", "path").join(labels, "doc_id").select("path", F.lit("new text").alias("content"), (F.col("quality") == 1).alias("overwrite"))
    nation = spark.read.parquet(f"{sf}/nation.parquet").select(
        F.concat(F.lit("fresh/"), "n_name", F.lit(".md")).alias("path"), F.col("n_name").alias("content"), F.lit(False).alias("overwrite")
    )
    plan = edits.create(files, wanted.unionByName(nation))
    return plan.select("path", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("after", F.lit("")).alias("after"))


MOVES = """moves AS (SELECT path, CASE WHEN toxic = 1 THEN 'src/src0/fr/doc_0.py' ELSE 'moved/' || path END AS "to" FROM corpus JOIN labels USING (doc_id)
  UNION ALL SELECT 'absent/' || r_name, 'moved/' || r_name FROM region),
judged AS (SELECT m.*, c.content, CASE WHEN c.path IS NULL THEN 'PATH_NOT_FOUND' WHEN t.path IS NOT NULL THEN 'PATH_EXISTS' ELSE '' END AS error
  FROM moves m LEFT JOIN corpus c ON c.path = m.path LEFT JOIN corpus t ON t.path = m."to")"""


@query("edit_plan_rename", with_ctes(CORPUS, MOVES) + """SELECT path, error, coalesce(sha256(content), '') AS before_hash, '' AS after_hash FROM judged
UNION ALL SELECT "to", error, '', sha256(content) FROM judged WHERE error = ''""")
def edit_plan_rename(spark, sf):
    files = corpus.documents(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    moves = files.select("doc_id", "path").join(labels, "doc_id").select(
        "path", F.when(F.col("toxic") == 1, "src/src0/fr/doc_0.py").otherwise(F.concat(F.lit("moved/"), "path")).alias("to")
    )
    region = spark.read.parquet(f"{sf}/region.parquet").select(
        F.concat(F.lit("absent/"), "r_name").alias("path"), F.concat(F.lit("moved/"), "r_name").alias("to")
    )
    plan = edits.rename(files, moves.unionByName(region))
    none = F.lit("")
    return plan.select(
        "path", F.coalesce("error", none).alias("error"), F.coalesce(handles.content_hash("before"), none).alias("before_hash"),
        F.coalesce(handles.content_hash("after"), none).alias("after_hash"),
    )


@query("edit_overlap", with_ctes(CORPUS, f"""needles AS (SELECT path, content, unnest([w, w2]) AS n, unnest([1, 2]) AS i FROM (
  SELECT path, content, {needle_sql(FIRST_WORD)} AS w, {needle_sql(TWO_WORDS)} AS w2 FROM corpus)),
pieces AS (SELECT path, n, i, string_split(content, n) AS p FROM needles),
ranges AS (SELECT path, i, k, n, sum(length(piece)) OVER (PARTITION BY path, i ORDER BY k) + (k - 1) * length(n) AS a FROM (
  SELECT path, n, i, unnest(p[1:len(p) - 1]) AS piece, generate_subscripts(p[1:len(p) - 1], 1) AS k FROM pieces)),
spans AS (SELECT path, a, a + length(n) AS b, i, k FROM ranges)""") + """SELECT path, coalesce(edits, 0) AS edits, CASE WHEN clashes THEN 'OVERLAPPING_EDITS' ELSE '' END AS error FROM corpus LEFT JOIN (
  SELECT path, count(*) AS edits, bool_or(clash) AS clashes FROM (
  SELECT s.path, s.i, s.k, bool_or(o.path IS NOT NULL) AS clash FROM spans s LEFT JOIN spans o ON o.path = s.path AND s.a < o.b AND o.a < s.b AND (o.i, o.k) <> (s.i, s.k)
  GROUP BY s.path, s.i, s.k) GROUP BY path) USING (path)""")
def edit_overlap(spark, sf):
    files = corpus.documents(spark, sf)
    return edits.overlapping(files, F.array(_needle(FIRST_WORD), _needle(TWO_WORDS)))


@query("edit_preconditions", with_ctes(CORPUS, """changes AS (
  SELECT path, (['replace', 'create', 'delete', 'rename'])[1 + doc_id % 4] AS kind, quality = 1 AS overwrite, toxic = 1 AS has_snapshot,
    CASE WHEN doc_id % 3 = 0 THEN sha256(content) WHEN doc_id % 3 = 1 THEN 'stale' END AS expected_hash FROM corpus JOIN labels USING (doc_id)
  UNION ALL SELECT 'absent/' || n_name, (['replace', 'create'])[1 + n_nationkey % 2], FALSE, TRUE, NULL FROM nation)""") + """
SELECT c.path, kind, CASE WHEN (kind <> 'create' OR f.path IS NOT NULL) AND NOT has_snapshot AND expected_hash IS NULL THEN 'MISSING_PRECONDITION'
  WHEN expected_hash IS NOT NULL AND expected_hash IS DISTINCT FROM sha256(f.content) THEN 'STALE_FILE'
  WHEN kind = 'create' AND f.path IS NOT NULL AND NOT overwrite THEN 'PATH_EXISTS'
  WHEN kind <> 'create' AND f.path IS NULL THEN 'PATH_NOT_FOUND' ELSE '' END AS error
FROM changes c LEFT JOIN corpus f ON f.path = c.path""")
def edit_preconditions(spark, sf):
    files = corpus.documents(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    joined = files.join(labels, "doc_id")
    kinds = F.array(*[F.lit(k) for k in ("replace", "create", "delete", "rename")])
    third = F.col("doc_id") % 3
    changes = joined.select(
        "path", F.get(kinds, (F.col("doc_id") % 4).cast("int")).alias("kind"), (F.col("quality") == 1).alias("overwrite"),
        (F.col("toxic") == 1).alias("has_snapshot"),
        F.when(third == 0, handles.content_hash("content")).when(third == 1, F.lit("stale")).alias("expected_hash"),
    )
    nation = spark.read.parquet(f"{sf}/nation.parquet").select(
        F.concat(F.lit("absent/"), "n_name").alias("path"), F.when(F.col("n_nationkey") % 2 == 0, "replace").otherwise("create").alias("kind"),
        F.lit(False).alias("overwrite"), F.lit(True).alias("has_snapshot"), F.lit(None).cast("string").alias("expected_hash"),
    )
    return edits.check_preconditions(changes.unionByName(nation), files).select("path", "kind", "error")


@query("edit_handle_order", """SELECT o_custkey::VARCHAR AS txn, 'part/' || l_partkey AS path, 'AMBIGUOUS_HANDLE_EDIT_ORDER' AS error
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey HAVING count(*) > 1 AND bool_or(l_returnflag = 'R')""")
def edit_handle_order(spark, sf):
    """Order lines as changes: the customer is the transaction, the part the file."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_returnflag")
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    changes = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").cast("string").alias("txn"), F.concat(F.lit("part/"), "l_partkey").alias("path"),
        F.when(F.col("l_returnflag") == "R", F.lit("range:x")).alias("handle"),
    )
    return edits.handle_order_conflicts(changes)


@query("rename_preview", with_ctes(CORPUS) + f"""SELECT path, sha256(content) AS expected_hash, edits, sha256(array_to_string(list_transform(range(1, len(gaps) + 1),
    lambda i: gaps[i] || CASE WHEN i <= len(runs) THEN CASE WHEN runs[i] = 'la' THEN 'LA_2' ELSE runs[i] END ELSE '' END), '')) AS after_hash
FROM (SELECT path, content, regexp_split_to_array(content, '{RUN}') AS gaps, regexp_extract_all(content, '{RUN}') AS runs,
        len(list_filter(regexp_extract_all(content, '{RUN}'), lambda r: r = 'la')) AS edits FROM corpus) WHERE edits > 0""")
def rename_preview(spark, sf):
    plan = edits.rename_identifier(corpus.documents(spark, sf), "la", "LA_2")
    return plan.select("path", "expected_hash", "edits", handles.content_hash("after").alias("after_hash"))


@query("compile_text_edits", with_ctes(CORPUS) + """SELECT path, CASE WHEN doc_id % 5 = 0 AND length(content) > 8 THEN 'OVERLAPPING_LSP_EDITS' ELSE '' END AS error,
  CASE WHEN doc_id % 5 = 0 AND length(content) > 8 THEN '' ELSE sha256('<' || substr(content, 3, 4) || '>' || substr(content, 9)) END AS after_hash
FROM corpus WHERE length(content) > 8""")
def compile_text_edits(spark, sf):
    """Two edits per file, out of order; every fifth file gets them overlapping."""
    files = corpus.documents(spark, sf).filter(F.length("content") > 8)
    first_end = F.when(F.col("doc_id") % 5 == 0, 7).otherwise(2)
    asked = files.select("path", F.explode(F.array(
        F.struct(F.lit(6).alias("start"), F.lit(8).alias("end"), F.lit(">").alias("text")),
        F.struct(F.lit(0).alias("start"), first_end.alias("end"), F.lit("<").alias("text")),
    )).alias("e")).select("path", "e.*")
    plan = edits.compile_text_edits(files, asked)
    return plan.select("path", F.coalesce("error", F.lit("")).alias("error"), F.coalesce(handles.content_hash("after"), F.lit("")).alias("after_hash"))


@query("located_edits", with_ctes(CORPUS, "wide AS (SELECT doc_id, path, replace(content, 'e', '😀') AS content FROM corpus)",
    "led AS (SELECT *, string_split(content, chr(10))[1] AS first FROM wide)",
    "asked AS (SELECT *, 3 + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS s FROM led WHERE length(first) >= 8)") + """
SELECT path, CASE WHEN doc_id % 4 = 0 AND substr(first, 4, 1) = '😀' THEN 'INVALID_LSP_POSITION' WHEN doc_id % 7 = 1 THEN 'INVALID_LSP_EDIT' ELSE '' END AS error,
  CASE WHEN (doc_id % 4 = 0 AND substr(first, 4, 1) = '😀') OR doc_id % 7 = 1 THEN ''
    ELSE sha256(left(content, s) || '<>' || substr(content, 6, 1) || '|' || substr(content, 7)) END AS after_hash
FROM asked""")
def located_edits(spark, sf):
    """Two edits by UTF-16 columns on lines with astral characters; some columns split one, some lines are none."""
    files = corpus.documents(spark, sf).withColumn("content", F.replace("content", F.lit("e"), F.lit("😀")))
    line = F.element_at(F.split("content", "\n", -1), 1)
    before = lambda n: positions.units_before(line, F.lit(n), "utf-16")
    start = before(3) + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)
    last = F.when(F.col("doc_id") % 7 == 1, 10**6).otherwise(0)

    def edit(a, row, b, text):
        return F.struct(F.lit(0).alias("start_line"), a.alias("start_column"), row.alias("end_line"), b.alias("end_column"), F.lit(text).alias("text"))

    asked = files.filter(F.length(line) >= 8).select("path", F.explode(F.array(edit(before(6), last, before(6), "|"), edit(start, F.lit(0), before(5), "<>"))).alias("e")).select("path", "e.*")
    plan = edits.compile_located_edits(files, asked)
    return plan.select("path", F.coalesce("error", F.lit("")).alias("error"), F.coalesce(handles.content_hash("after"), F.lit("")).alias("after_hash"))


@query("edit_transactions", with_ctes(CORPUS, """facts AS (SELECT doc_id, path, content, (strlen(content) - strlen(replace(content, 'la', ''))) // 2 AS n FROM corpus)""") + """
SELECT doc_id::VARCHAR AS txn, path, CASE WHEN doc_id % 3 = 0 THEN 'EXACT_MATCH_COUNT' ELSE '' END AS error, CASE WHEN doc_id % 3 = 0 THEN '' ELSE sha256(content) END AS before_hash,
  '' AS after_hash FROM facts
UNION ALL
SELECT doc_id::VARCHAR, 'moved/' || path, '', '', sha256(replace(content, 'la', 'LA') || '') FROM facts WHERE doc_id % 3 <> 0""")
def edit_transactions(spark, sf):
    """Replace, rename, then replace in the renamed file; every third one miscounts."""
    files = corpus.documents(spark, sf)
    n = ((F.octet_length("content") - F.octet_length(F.replace("content", F.lit("la"), F.lit("")))) / 2).cast("int")
    moved = F.concat(F.lit("moved/"), "path")
    none = F.lit(None).cast("string")

    def step(seq, kind, path, to, old, new, expected):
        return F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), path.alias("path"), to.alias("to"),
                        old.alias("old_text"), new.alias("new_text"), expected.alias("expected"))

    changes = files.select(F.col("doc_id").cast("string").alias("txn"), F.explode(F.array(
        step(1, "replace", F.col("path"), none, F.lit("la"), F.lit("L@"), F.when(F.col("doc_id") % 3 == 0, n + 1).otherwise(n)),
        step(2, "rename", F.col("path"), moved, none, none, F.lit(0)),
        step(3, "replace", moved, none, F.lit("L@"), F.lit("LA"), n),
    )).alias("c")).select("txn", "c.*")
    plan = edits.plan_transactions(changes, files.select("path", "content"))
    return plan.select(
        "txn", "path", F.coalesce("error", F.lit("")).alias("error"), F.coalesce(handles.content_hash("before"), F.lit("")).alias("before_hash"),
        F.coalesce(handles.content_hash("after"), F.lit("")).alias("after_hash"),
    )


def _planned(changes, files):
    plan = edits.plan_transactions(changes, files)
    return plan.select("txn", "path", F.coalesce("error", F.lit("")).alias("error"), F.coalesce(handles.content_hash("after"), F.lit("")).alias("after_hash"))


@query("edit_transactions_crlf", with_ctes(CORPUS, "crlf AS (SELECT doc_id, path, replace(content, chr(10), chr(13) || chr(10)) AS content FROM corpus)") + """
SELECT doc_id::VARCHAR AS txn, path, '' AS error, sha256(replace(content, '.' || chr(13) || chr(10), '!' || chr(13) || chr(10))) AS after_hash FROM crlf""")
def edit_transactions_crlf(spark, sf):
    """A needle with LF line ends in files with CR LF line ends."""
    files = corpus.documents(spark, sf)
    n = ((F.octet_length("content") - F.octet_length(F.replace("content", F.lit(".\n"), F.lit("")))) / 2).cast("int")
    changes = files.select(
        F.col("doc_id").cast("string").alias("txn"), F.lit(1).alias("seq"), F.lit("replace").alias("kind"), "path", F.lit(None).cast("string").alias("to"),
        F.lit(".\n").alias("old_text"), F.lit("!\n").alias("new_text"), n.alias("expected"),
    )
    return _planned(changes, files.select("path", F.replace("content", F.lit("\n"), F.lit("\r\n")).alias("content")))


@query("edit_transactions_conflicts", with_ctes(CORPUS) + """
SELECT doc_id::VARCHAR AS txn, CASE WHEN doc_id % 3 = 2 THEN 'new/' || path ELSE path END AS path,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'PATH_EXISTS' END AS error, CASE WHEN doc_id % 3 = 0 THEN sha256('fresh') ELSE '' END AS after_hash FROM corpus""")
def edit_transactions_conflicts(spark, sf):
    """Create with and without overwrite; rename to a path that the same transaction freed."""
    files = corpus.documents(spark, sf)
    none = F.lit(None).cast("string")
    fresh = F.concat(F.lit("new/"), "path")

    def step(seq, kind, path, to, new, overwrite):
        return F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), path.alias("path"), to.alias("to"), none.alias("old_text"),
                        new.alias("new_text"), F.lit(0).alias("expected"), F.lit(overwrite).alias("overwrite"))

    rows = F.when(F.col("doc_id") % 3 == 0, F.array(step(1, "create", F.col("path"), none, F.lit("fresh"), True)))
    rows = rows.when(F.col("doc_id") % 3 == 1, F.array(step(1, "create", F.col("path"), none, F.lit("fresh"), False)))
    rows = rows.otherwise(F.array(
        step(1, "delete", F.col("path"), none, none, False), step(2, "create", fresh, none, F.lit("fresh"), False),
        step(3, "rename", fresh, F.col("path"), none, False),
    ))
    changes = files.select(F.col("doc_id").cast("string").alias("txn"), F.explode(rows).alias("c")).select("txn", "c.*")
    return _planned(changes, files.select("path", "content"))


@query("syntax_gate")
def syntax_gate(spark, sf):
    """Documents as planned texts: prose under a code extension does not parse."""
    return edits.syntax_gate(corpus.documents(spark, sf).select("path", F.col("content").alias("after")))


def _change(**columns):
    """A change of a request; columns that its kind does not need are null."""
    values = {c: columns.get(c, F.lit(None)) for c in edit_requests.COLUMNS if c != "txn"}
    return F.struct(*(v.cast(edit_requests.COLUMNS[c]).alias(c) for c, v in values.items()))


def _requested(files, *changes):
    asked = files.select(F.col("doc_id").cast("string").alias("txn"), F.explode(F.array_compact(F.array(*changes))).alias("c")).select("txn", "c.*")
    plan = edit_requests.plan_requests(asked, files.select("path", "content"), snapshot="now")
    return plan.select("txn", "path", F.coalesce("error", F.lit("")).alias("error"), F.coalesce(handles.content_hash("after"), F.lit("")).alias("after_hash"))


@query("edit_request_all_kinds", with_ctes(CORPUS) + """
SELECT doc_id::VARCHAR AS txn, path, '' AS error, '' AS after_hash FROM corpus
UNION ALL SELECT doc_id::VARCHAR, 'kept/' || path, '', sha256('# head' || chr(10) || replace(content, 'la', 'LA') || 'tail') FROM corpus
UNION ALL SELECT doc_id::VARCHAR, 'new/' || path, '', '' FROM corpus""")
def edit_request_all_kinds(spark, sf):
    """Replace, two inserts, a rename, and a file that is created and deleted again."""
    files = corpus.documents(spark, sf)
    n = ((F.octet_length("content") - F.octet_length(F.replace("content", F.lit("la"), F.lit("")))) / 2).cast("int")
    stem, path, fresh, now = F.concat(F.lit("doc_"), F.col("doc_id")), F.col("path"), F.concat(F.lit("new/"), "path"), F.lit("now")
    return _requested(
        files,
        _change(seq=F.lit(1), kind=F.lit("replace"), path=path, old_text=F.lit("la"), new_text=F.lit("LA"), expected_replacements=n, snapshot_id=now),
        _change(seq=F.lit(2), kind=F.lit("insert"), path=path, anchor_symbol=stem, position=F.lit("before"), content=F.lit("# head\n"), expected_hash=handles.content_hash("content"), snapshot_id=now),
        _change(seq=F.lit(3), kind=F.lit("insert"), path=path, anchor_symbol=stem, position=F.lit("after"), content=F.lit("tail"), snapshot_id=now),
        _change(seq=F.lit(4), kind=F.lit("rename"), path=path, to=F.concat(F.lit("kept/"), path), snapshot_id=now),
        _change(seq=F.lit(5), kind=F.lit("create"), path=fresh, content=F.lit("x"), snapshot_id=now),
        _change(seq=F.lit(6), kind=F.lit("delete"), path=fresh, snapshot_id=now),
    )


@query("edit_request_ranges", with_ctes(CORPUS, "cut AS (SELECT doc_id, path, content, string_split(content, chr(10)) AS p FROM corpus)",
    """placed AS (SELECT *, CASE WHEN len(p) >= 2 THEN length(p[1]) + 1 ELSE length(content) END AS a,
  CASE WHEN len(p) >= 4 THEN length(array_to_string(p[1:3], chr(10))) + 1 ELSE length(content) END AS b FROM cut)""") + """
SELECT doc_id::VARCHAR AS txn, path, CASE doc_id % 4 WHEN 1 THEN 'STALE_FILE' WHEN 2 THEN 'AMBIGUOUS_HANDLE_EDIT_ORDER' WHEN 3 THEN 'MISSING_PRECONDITION' ELSE '' END AS error,
  CASE WHEN doc_id % 4 = 0 THEN sha256(left(content, a) || 'X' || CASE WHEN suffix(substr(content, a + 1, b - a), chr(10)) THEN chr(10) ELSE '' END || substr(content, b + 1)) ELSE '' END AS after_hash
FROM placed""")
def edit_request_ranges(spark, sf):
    """Lines 2 and 3 by their handle: as they are, of another version, beside another change, or without a guard."""
    files = corpus.documents(spark, sf)
    case, path = F.col("doc_id") % 4, F.col("path")
    digest = F.when(case == 1, F.lit("0" * 64)).otherwise(handles.content_hash("content"))
    handle = handles.range_handle("main", path, F.lit(2), F.lit(3), digest)
    return _requested(
        files,
        F.when(case != 3, _change(seq=F.lit(1), kind=F.lit("replace_range"), path=path, handle=handle, new_text=F.lit("X"))),
        F.when(case == 2, _change(seq=F.lit(2), kind=F.lit("delete"), path=path, snapshot_id=F.lit("now"))),
        F.when(case == 3, _change(seq=F.lit(3), kind=F.lit("delete"), path=path)),
    )


@query("edit_request_checks", with_ctes(CORPUS, f"""asked AS (SELECT doc_id, path, content, {needle_sql(FIRST_WORD)} AS a, {needle_sql(TWO_WORDS)} AS b FROM corpus)""",
    "counted AS (SELECT *, (strlen(content) - strlen(replace(content, a, ''))) // strlen(a) AS na, (strlen(content) - strlen(replace(content, b, ''))) // strlen(b) AS nb FROM asked)") + """
SELECT doc_id::VARCHAR AS txn, path, CASE WHEN doc_id % 5 = 0 THEN 'STALE_SNAPSHOT' WHEN na <> 1 OR nb <> 1 THEN 'EXACT_MATCH_COUNT' ELSE 'OVERLAPPING_EDITS' END AS error,
  '' AS after_hash FROM counted""")
def edit_request_checks(spark, sf):
    """Two replacements of which one lies in the other; every fifth request names an older snapshot."""
    files = corpus.documents(spark, sf)
    path, asked = F.col("path"), F.when(F.col("doc_id") % 5 == 0, "then").otherwise("now")
    return _requested(
        files,
        _change(seq=F.lit(1), kind=F.lit("replace"), path=path, old_text=_needle(FIRST_WORD), new_text=F.lit("x"), snapshot_id=asked),
        _change(seq=F.lit(2), kind=F.lit("replace"), path=path, old_text=_needle(TWO_WORDS), new_text=F.lit("y"), snapshot_id=asked),
    )
