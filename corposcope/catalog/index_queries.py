"""Derived columns, terms, postings, metrics, snapshots, handles, refresh."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import handles, paths, terms, text
from ..functions.rows import unnest
from ..operators import index, symbols
from ..session import written
from ..sources import corpus, repository
from .base import BASE, CORPUS, SYMBOLS, document_type_sql, handle_sql, language_sql, query, sql_list, terms_sql, with_ctes


@query("language_of", with_ctes(CORPUS) + f"SELECT path, {language_sql()} AS language FROM corpus")
def language_of(spark, sf):
    return corpus.document_paths(spark, sf).select("path", paths.language("path").alias("language"))


@query("classify_documents", with_ctes(CORPUS) + f"SELECT path, {document_type_sql()} AS document_type FROM corpus")
def classify_documents(spark, sf):
    return corpus.document_paths(spark, sf).select("path", paths.document_type("path").alias("document_type"))


# Names with every class of segment, prefix and suffix, chosen by document id.
SHAPES = [
    "AGENTS.md", "src/test_{}.py", "a/b_test.rs", "web/x.spec.tsx", "runtime/{}.json", "evidence/{}.txt",
    "fixtures_parser/{}.rs", "recordings/{}.bin", "x/{}.fixture.json", "logs/{}.log", "__TESTS__/{}.go", "testament/{}.rs",
]


def shaped_sql(shapes: list[str]) -> str:
    return f"replace(({sql_list(shapes)})[1 + doc_id % {len(shapes)}], '{{}}', doc_id::VARCHAR)"


def shaped(shapes: list[str]):
    names = F.array(*[F.lit(s) for s in shapes])
    return F.replace(F.get(names, F.pmod("doc_id", F.lit(len(shapes))).cast("int")), F.lit("{}"), F.col("doc_id").cast("string"))


@query("classify_shapes", f"SELECT doc_id, path, {document_type_sql()} AS document_type FROM (SELECT doc_id, {shaped_sql(SHAPES)} AS path FROM documents)")
def classify_shapes(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", shaped(SHAPES).alias("path"))
    return df.select("doc_id", "path", paths.document_type("path").alias("document_type"))


EXCLUDED = ["build/{}.o", "src/{}.rs", "web/node_modules/{}/a.js", "core/target-x{}/b", "core/targeting/{}.rs", ".git/{}",
            "lib/.venv/{}.py", "distance/{}.txt", "a/dist/{}.css", "src/.corposcope-{}.tmp"]


@query("path_exclusions", f"""SELECT doc_id, path,
  len(list_filter(string_split(path, '/'), lambda c: c IN {tuple(paths.EXCLUDED_COMPONENTS)} OR prefix(c, 'target-') OR prefix(c, 'target_'))) > 0
  OR contains(string_split(path, '/')[-1], '.corposcope-') AS excluded
FROM (SELECT doc_id, {shaped_sql(EXCLUDED)} AS path FROM documents)""")
def path_exclusions(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", shaped(EXCLUDED).alias("path"))
    return df.select("doc_id", "path", paths.is_excluded("path").alias("excluded"))


RELATIVE = ["src/{}.rs", "/abs/{}.rs", "../up/{}.rs", "a/../{}.rs", "a..b/{}.rs", "dir\\..\\{}.rs", "..{}/x.rs"]


@query("relative_paths", f"""SELECT doc_id, path, NOT prefix(path, '/') AND NOT list_contains(string_split(replace(path, chr(92), '/'), '/'), '..') AS relative
FROM (SELECT doc_id, {shaped_sql(RELATIVE)} AS path FROM documents)""")
def relative_paths(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", shaped(RELATIVE).alias("path"))
    return df.select("doc_id", "path", paths.is_relative("path").alias("relative"))


PATTERNS = ["docs/src1/", "*.log", "/src/**/doc_?2.py", "en"]


@query("configured_exclusions", with_ctes(CORPUS) + """SELECT path FROM corpus WHERE NOT (prefix(path, 'docs/src1/') OR suffix(path, '.log')
  OR regexp_matches(path, '^src/(.*/)?doc_.2\\.py$') OR list_contains(string_split(path, '/'), 'en'))""")
def configured_exclusions(spark, sf):
    df = corpus.document_paths(spark, sf)
    return df.filter(repository.not_excluded("path", PATTERNS)).select("path")


# Each document with one of four line-end treatments, by id.
ENDINGS_SQL = """CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, chr(10), chr(13) || chr(10))
 WHEN 2 THEN replace(text, chr(10), chr(13)) ELSE replace(text, chr(10), ' ') END"""


def endings(c="text"):
    k = F.pmod("doc_id", F.lit(4))
    lf = F.lit("\n")
    return (
        F.when(k == 0, F.col(c)).when(k == 1, F.replace(c, lf, F.lit("\r\n")))
        .when(k == 2, F.replace(c, lf, F.lit("\r"))).otherwise(F.replace(c, lf, F.lit(" ")))
    )


@query("line_endings", f"""SELECT doc_id, CASE WHEN crlf + lf + cr = 0 THEN 'none' WHEN lf + cr = 0 THEN 'crlf' WHEN crlf + cr = 0 THEN 'lf' ELSE 'mixed' END AS line_ending,
  greatest(crlf + lf + CASE WHEN suffix(t, chr(10)) THEN 0 ELSE 1 END, 1) AS line_count
FROM (SELECT doc_id, t, crlf, strlen(t) - strlen(replace(t, chr(10), '')) - crlf AS lf, strlen(t) - strlen(replace(t, chr(13), '')) - crlf AS cr
  FROM (SELECT doc_id, t, (strlen(t) - strlen(replace(t, chr(13) || chr(10), ''))) // 2 AS crlf FROM (SELECT doc_id, {ENDINGS_SQL} AS t FROM documents)))""")
def line_endings(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", endings().alias("t"))
    return df.select("doc_id", text.line_ending("t").alias("line_ending"), text.line_count("t").alias("line_count"))


@query("line_rows", with_ctes(*BASE) + "SELECT path, line, text FROM lines")
def line_rows(spark, sf):
    rows = unnest(text.with_lines(corpus.documents(spark, sf)), "lines", "text", "path", position="i")
    return rows.select("path", (F.col("i") + 1).alias("line"), "text")


@query("file_admission", """SELECT doc_id, strlen(text) <= 4000 AND NOT contains(text, chr(0)) AS admitted FROM documents""")
def file_admission(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    return df.select("doc_id", corpus.admissible(F.encode("text", "UTF-8"), 4000).alias("admitted"))


@query("query_terms", f"SELECT doc_id, array_to_string(list_sort({terms_sql('text')}), ' ') AS terms FROM documents")
def query_terms(spark, sf):
    return corpus.documents(spark, sf).select("doc_id", F.array_join(terms.terms("content"), " ").alias("terms"))


def _index_terms_sql() -> str:
    whole = terms_sql("content || chr(10) || path || chr(10) || names")
    parts = terms_sql("translate(array_to_string(list_filter(w, lambda t: regexp_matches(t, '[_.-]')), ' '), '_.-', '   ')")
    return with_ctes(
        *BASE, SYMBOLS,
        "named AS (SELECT path, string_agg(name, chr(10)) AS names FROM symbols GROUP BY path)",
        f"whole AS (SELECT path, content, {whole} AS w FROM corpus JOIN named USING (path))",
        f"indexed AS (SELECT path, list_sort(list_distinct(list_concat(w, {parts}))) AS terms FROM whole)",
    )


@query("indexed_terms", _index_terms_sql() + "SELECT path, array_to_string(terms, ' ') AS terms FROM indexed")
def indexed_terms(spark, sf):
    files = index.with_terms(symbols.with_symbols(corpus.documents(spark, sf)))
    return files.select("path", F.array_join("indexed_terms", " ").alias("terms"))


@query("postings", _index_terms_sql() + "SELECT term, count(*) AS files, sum(length(path))::BIGINT AS path_chars FROM (SELECT unnest(terms) AS term, path FROM indexed) GROUP BY term")
def postings(spark, sf):
    rows = index.postings(symbols.with_symbols(corpus.documents(spark, sf)))
    return rows.groupBy("term").agg(F.count("*").alias("files"), F.sum(F.length("path")).alias("path_chars"))


@query("candidate_files", _index_terms_sql() + "SELECT path FROM indexed WHERE list_has_any(terms, ['haus', 'eau', 'doc_17'])")
def candidate_files(spark, sf):
    files = symbols.with_symbols(corpus.documents(spark, sf))
    return index.candidate_files(files, index.postings(files), ["haus", "eau", "doc_17"]).select("path")


@query("index_metrics", _index_terms_sql() + f"""SELECT * FROM
 (SELECT count(*) AS indexed_file_count, sum(lc) AS indexed_loc, sum(lc) FILTER (WHERE {document_type_sql()} = 'source') AS indexed_source_loc,
         sum(strlen(content)) AS indexed_content_bytes FROM parts),
 (SELECT count(DISTINCT t) AS token_count, count(*) AS token_posting_count FROM (SELECT unnest(terms) AS t FROM indexed)),
 (SELECT count(DISTINCT name) AS symbol_name_count, count(*) AS symbol_declaration_count FROM symbols)""")
def index_metrics(spark, sf):
    files = symbols.with_symbols(corpus.documents(spark, sf)).withColumn("document_type", paths.document_type("path"))
    return index.metrics(files)


@query("content_hash", with_ctes(CORPUS) + "SELECT path, sha256(content) AS hash FROM corpus")
def content_hash(spark, sf):
    return corpus.documents(spark, sf).select("path", handles.content_hash("content").alias("hash"))


def _snapshot_sql(head: str) -> str:
    tag = index.SNAPSHOT_TAG
    lanes = ", ".join(f"bit_xor(('0x' || substr(d, {1 + 8 * i}, 8))::BIGINT) AS lane{i}" for i in range(8))
    xor = " || ".join(f"lpad(lower(to_hex(lane{i})), 8, '0')" for i in range(8))
    little = " || ".join(f"substr(lpad(lower(to_hex(n)), 16, '0'), {15 - 2 * i}, 2)" for i in range(8))
    return with_ctes(
        CORPUS,
        "rows AS (SELECT sha256(encode(path) || '\\x00'::BLOB || encode(sha256(content)) || '\\x00'::BLOB) AS d FROM corpus)",
        f"lanes AS (SELECT count(*) AS n, {lanes} FROM rows)",
    ) + (
        f"SELECT n AS file_count, 'snap_' || sha256(encode('{tag}') || '\\x00'::BLOB || encode('{head}') || '\\x00'::BLOB "
        f"|| unhex({little}) || unhex({xor})) AS snapshot_id FROM lanes"
    )


@query("snapshot_id", _snapshot_sql("abc123"))
def snapshot_id(spark, sf):
    return index.snapshot_id(corpus.documents(spark, sf), "abc123")


# After the change: every tenth document longer, every tenth gone, every tenth new beside the old.
CHANGED = """corpus AS (
  SELECT path, content || CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE '' END AS content FROM given WHERE doc_id % 10 <> 1
  UNION ALL SELECT 'new/' || path, content FROM given WHERE doc_id % 10 = 2)"""


@query("snapshot_refreshed", _snapshot_sql("abc123").replace(CORPUS, CORPUS.replace("corpus AS", "given AS", 1) + ", " + CHANGED))
def snapshot_refreshed(spark, sf):
    """The id after a change, from the stored lanes and the changed rows."""
    files = corpus.documents(spark, sf)
    turn = F.col("doc_id") % 10
    longer = files.filter(turn == 0).select("path", F.concat("content", F.lit("x")).alias("content"))
    gone = files.filter(turn == 1).select("path", F.lit(None).cast("string").alias("content"))
    fresh = files.filter(turn == 2).select(F.concat(F.lit("new/"), "path").alias("path"), "content")
    lanes = written(index.snapshot_lanes(files), "lanes")
    return index.snapshot_of(index.refreshed_lanes(lanes, files, longer.union(gone).union(fresh)), "abc123")



@query("range_handles", with_ctes(*BASE) + f"SELECT path, {handle_sql('path', '1', 'lc', 'sha256(content)')} AS handle FROM parts")
def range_handles(spark, sf):
    df = corpus.documents(spark, sf)
    return df.select(
        "path",
        handles.range_handle("main", F.col("path"), F.lit(1), text.line_count("content"), handles.content_hash("content")).alias("handle"),
    )


@query("handle_round_trip", with_ctes(*BASE) + "SELECT path, 'main' AS w, path AS p, 1 AS a, lc AS b, sha256(content) AS h FROM parts")
def handle_round_trip(spark, sf):
    return range_handles(spark, sf).select("path", handles.decode_range("handle").alias("r")).select("path", "r.*")


@query("utf16_columns", with_ctes(*BASE) + r"""SELECT path, line, length(text) AS scalars, strlen(text) AS bytes,
  length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS utf16 FROM lines""")
def utf16_columns(spark, sf):
    return line_rows(spark, sf).select(
        "path", "line", F.length("text").alias("scalars"), F.octet_length("text").alias("bytes"), text.utf16_length("text").alias("utf16")
    )


@query("file_uris", with_ctes(CORPUS) + """SELECT path, 'file:///root%20dir/' || replace(replace(content_head, '%2F', '/'), '%3A', ':') AS uri
FROM (SELECT path, url_encode(path || ' ~*+ä:' ) AS content_head FROM corpus)""")
def file_uris(spark, sf):
    df = corpus.document_paths(spark, sf)
    return df.select("path", text.file_uri(F.concat(F.lit("/root dir/"), F.col("path"), F.lit(" ~*+ä:"))).alias("uri"))


@query("uri_round_trip", with_ctes(CORPUS) + "SELECT path, '/root dir/' || path || ' ~*+ä:' AS decoded FROM corpus")
def uri_round_trip(spark, sf):
    return file_uris(spark, sf).select("path", text.uri_to_path("uri").alias("decoded"))


# Path events derived from the labels: toxic files are gone, bad ones changed,
# and one directory vanishes as a whole.
EVENTS_SQL = [
    CORPUS,
    """changed AS (
  SELECT path, CASE WHEN toxic = 1 THEN NULL WHEN quality = 0 THEN content || chr(10) || 'edited' ELSE content END AS content
  FROM corpus JOIN labels USING (doc_id)
  UNION ALL SELECT 'logs/src5', NULL UNION ALL SELECT 'src/new.rs', 'fn main() {}')""",
    """gone AS (SELECT path FROM changed WHERE content IS NULL)""",
    """removed AS (SELECT DISTINCT corpus.path FROM corpus JOIN gone ON corpus.path = gone.path OR prefix(corpus.path, gone.path || '/'))""",
]


def path_events(spark, sf):
    files = corpus.documents(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic")
    edited = F.concat("content", F.lit("\nedited"))
    changed = files.join(labels, "doc_id").select(
        "path", F.when(F.col("toxic") == 1, None).when(F.col("quality") == 0, edited).otherwise(F.col("content")).alias("content")
    )
    extra = spark.createDataFrame([("logs/src5", None), ("src/new.rs", "fn main() {}")], "path string, content string")
    return files, changed.unionByName(extra)


@query("refresh_upsert_delete", with_ctes(*EVENTS_SQL) + """SELECT coalesce(k.path, c.path) AS path, sha256(coalesce(c.content, k.content)) AS hash,
  CASE WHEN c.content IS NULL THEN 'kept' WHEN k.path IS NULL THEN 'added' WHEN c.content = k.content THEN 'kept' ELSE 'changed' END AS status
FROM (SELECT * FROM corpus ANTI JOIN removed USING (path)) k
FULL JOIN (SELECT * FROM changed WHERE content IS NOT NULL) c ON k.path = c.path""")
def refresh_upsert_delete(spark, sf):
    files, changed = path_events(spark, sf)
    return index.refresh(files, changed).select("path", handles.content_hash("content").alias("hash"), "status")


@query("refresh_removed", with_ctes(*EVENTS_SQL) + "SELECT path FROM removed")
def refresh_removed(spark, sf):
    files, changed = path_events(spark, sf)
    return index.removed_paths(files, changed)
