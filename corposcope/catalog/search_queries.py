"""Line search, file names, directory map."""

from __future__ import annotations

from ..operators import index, search
from ..sources import corpus
from .base import BASE, CORPUS, handle_sql, language_sql, preview_sql, query, sql_list, terms_sql, windows_sql, with_ctes
from ..functions.terms import query_terms


def gate_sql(pattern: str) -> str:
    wanted = query_terms(pattern)
    if not wanted:
        return "TRUE"
    terms = terms_sql("content || chr(10) || path")
    # A wanted term has no separator, so it is found whole or as part of a compound.
    parts = terms_sql(f"translate(array_to_string({terms}, ' '), '_.-', '   ')")
    return f"(list_has_any({terms}, {sql_list(wanted)}) OR list_has_any({parts}, {sql_list(wanted)}))"


def search_sql(pattern: str, condition: str, *, context: int, limit: int, cap: int, scope: str = "TRUE",
               kind: str = "literal", gate: bool = True) -> str:
    allowed = gate_sql(pattern) if gate and kind == "literal" else "TRUE"
    return with_ctes(
        *BASE,
        f"allowed AS (SELECT path FROM corpus WHERE ({scope}) AND {allowed})",
        "scoped AS (SELECT lines.* FROM lines SEMI JOIN allowed USING (path))",
        *windows_sql(condition, context, "scoped"),
        f"picked AS (SELECT * FROM windows WHERE island <= {cap} ORDER BY island, path LIMIT {limit})",
    ) + f"""SELECT path, line, start_line, end_line, {preview_sql()} AS preview,
       {handle_sql('path', 'start_line', 'end_line', 'sha256(content)')} AS handle,
       '{kind}' AS match_type, 1.0::DOUBLE AS score, '{kind}_match' AS reason
FROM picked JOIN parts USING (path)"""


def ascii_ci(pattern: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"contains(translate(text, '{upper}', '{lower}'), '{pattern.lower()}')"


@query("search_literal_ci", search_sql("le", ascii_ci("le"), context=2, limit=20, cap=8))
def search_literal_ci(spark, sf):
    return search.search_text(corpus.documents(spark, sf), "le")


@query("search_literal_cs", search_sql("La", "contains(text, 'La')", context=1, limit=40, cap=8))
def search_literal_cs(spark, sf):
    return search.search_text(corpus.documents(spark, sf), "La", case_sensitive=True, context=1, max_results=40)


@query("search_literal_scoped", search_sql("que", ascii_ci("que"), context=0, limit=200, cap=200, scope="prefix(path, 'src/')"))
def search_literal_scoped(spark, sf):
    return search.search_text(corpus.documents(spark, sf), "que", scope=["./src"], context=0, max_results=200)


@query("search_literal_two_scopes", search_sql("und", ascii_ci("und"), context=0, limit=60, cap=8,
       scope="prefix(path, 'docs/') OR prefix(path, 'tests/src1/')"))
def search_literal_two_scopes(spark, sf):
    return search.search_text(corpus.documents(spark, sf), "und", scope=["docs/", "tests\\src1"], context=0, max_results=60)


@query("search_literal_pruned_miss", search_sql("ertio", ascii_ci("ertio"), context=2, limit=20, cap=8))
def search_literal_pruned_miss(spark, sf):
    return search.search_text(corpus.documents(spark, sf), "ertio")


@query("search_substring_unpruned", search_sql("ertio", ascii_ci("ertio"), context=2, limit=20, cap=8, gate=False))
def search_substring_unpruned(spark, sf):
    return search.search_text(corpus.documents(spark, sf), "ertio", prune="none")


@query("search_stopword_fullscan", search_sql("the", ascii_ci("the"), context=2, limit=20, cap=8))
def search_stopword_fullscan(spark, sf):
    return search.search_text(corpus.documents(spark, sf), "the")


REGEX_CI = r"^é\p{L}*eau[ ,.]"
REGEX_CS = r"^[A-Z]\p{L}+ \p{L}+\.$"


@query("search_regex_ci", search_sql(REGEX_CI, f"regexp_matches(text, '(?i){REGEX_CI}')", context=1, limit=50, cap=8, kind="regex"))
def search_regex_ci(spark, sf):
    return search.search_text(corpus.documents(spark, sf), REGEX_CI, syntax="regex", context=1, max_results=50)


@query("search_regex_cs", search_sql(REGEX_CS, f"regexp_matches(text, '{REGEX_CS}')", context=0, limit=50, cap=8, kind="regex"))
def search_regex_cs(spark, sf):
    return search.search_text(corpus.documents(spark, sf), REGEX_CS, syntax="regex", context=0, case_sensitive=True, max_results=50)


REGEX_POSIX = "[[:space:]][[:upper:]][[:lower:]]+[[:punct:]]"


@query("search_regex_posix", search_sql(REGEX_POSIX, f"regexp_matches(text, '{REGEX_POSIX}')", context=0, limit=50, cap=8, kind="regex"))
def search_regex_posix(spark, sf):
    return search.search_text(corpus.documents(spark, sf), REGEX_POSIX, syntax="regex", context=0, case_sensitive=True, max_results=50)


MANY = ["le", "der", "que", "the", "zzqq"]


def many_sql(patterns: list[str], context: int, limit: int, cap: int) -> str:
    arms = []
    for i, p in enumerate(patterns):
        ctes = with_ctes(
            f"allowed AS (SELECT path FROM corpus WHERE {gate_sql(p)})",
            "scoped AS (SELECT lines.* FROM lines SEMI JOIN allowed USING (path))",
            *windows_sql(ascii_ci(p), context, "scoped"),
        )
        arms.append(
            f"(SELECT * FROM ({ctes} SELECT {i} AS query_index, '{p}' AS query, path, island - 1 AS turn, line, start_line, end_line, "
            f"row_number() OVER (ORDER BY island, path) AS rank FROM windows WHERE island <= {cap}) WHERE rank <= {limit})"
        )
    return with_ctes(*BASE) + " UNION ALL ".join(arms)


MANY_COLUMNS = ["query_index", "query", "path", "turn", "line", "start_line", "end_line", "rank"]


@query("search_multi_query", many_sql(MANY, 1, 15, 8))
def search_multi_query(spark, sf):
    return search.search_many(corpus.documents(spark, sf), MANY, context=1, max_results=15).select(MANY_COLUMNS)


# Twelve literals in one pass, two of which are no patterns.
TWELVE = ["le", "der", "que", "the", "zzqq", "ung", "tion", "ent", "La", "und"]


@query("search_multi_replies", f"""SELECT r.*, {preview_sql()} AS preview, {handle_sql('path', 'start_line', 'end_line', 'sha256(content)')} AS handle,
  'literal' AS match_type, 1.0::DOUBLE AS score, 'literal_match' AS reason, NULL::VARCHAR AS error
FROM ({many_sql(TWELVE, 2, 10, 8)}) r JOIN ({with_ctes(*BASE)} SELECT path, content, ls FROM parts) USING (path)
UNION ALL SELECT 10, '', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'INVALID_REQUEST'
UNION ALL SELECT 11, '', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'INVALID_REQUEST'""")
def search_multi_replies(spark, sf):
    return search.search_many(corpus.documents(spark, sf), [*TWELVE, "", ""], max_results=10)


@query("search_truncation_stats", with_ctes(
    *BASE, f"allowed AS (SELECT path FROM corpus WHERE {gate_sql('le')})",
    "scoped AS (SELECT lines.* FROM lines SEMI JOIN allowed USING (path))",
    *windows_sql(ascii_ci("le"), 1, "scoped"),
    "per_file AS (SELECT path, count(*) AS n FROM windows GROUP BY path)",
) + """SELECT count(*) AS matched_files, coalesce(sum(n), 0) AS total_windows, least(sum(least(n, 8)), 20) AS result_count,
       sum(n) > least(sum(least(n, 8)), 20) AS truncated FROM per_file""")
def search_truncation_stats(spark, sf):
    return search.search_stats(corpus.documents(spark, sf), "le", context=1)


PAGE_PATH = "regexp_replace(url, '^[a-z]+://', '') || '/page_' || page_id || '.html'"
PAGES = f"corpus AS (SELECT {PAGE_PATH} AS path, html AS content FROM pages)"


@query("search_pages", search_sql("track", ascii_ci("track"), context=0, limit=30, cap=8).replace(CORPUS, PAGES))
def search_pages(spark, sf):
    return search.search_text(corpus.pages(spark, sf), "track", context=0, max_results=30)


@query("find_file_substring", with_ctes(CORPUS) + """SELECT path, 'substring' AS match_type, 1.0::DOUBLE AS score, 'filename_match' AS reason
FROM corpus WHERE contains(lower(path), 'src1/en') ORDER BY path LIMIT 20""")
def find_file_substring(spark, sf):
    return index.find_file(corpus.document_paths(spark, sf), "SRC1/en")


@query("find_file_glob", with_ctes(CORPUS) + """SELECT path, 'glob' AS match_type, 1.0::DOUBLE AS score, 'filename_match' AS reason
FROM corpus WHERE regexp_full_match(path, '(?i).*s/src.*doc_.6\\.py') ORDER BY path LIMIT 100""")
def find_file_glob(spark, sf):
    return index.find_file(corpus.document_paths(spark, sf), "*S/src*doc_?6.py", max_results=100)


@query("find_file_scoped_cs", with_ctes(CORPUS) + """SELECT path, 'substring' AS match_type, 1.0::DOUBLE AS score, 'filename_match' AS reason
FROM corpus WHERE contains(path, 'doc_1') AND (prefix(path, 'logs/') OR prefix(path, 'docs/src1/')) ORDER BY path LIMIT 200""")
def find_file_scoped_cs(spark, sf):
    return index.find_file(corpus.document_paths(spark, sf), "doc_1", scope=["logs", "docs/src1"], case_sensitive=True, max_results=200)


@query("find_file_stats", with_ctes(CORPUS) + """SELECT count(*) AS total, least(count(*), 20) AS result_count, count(*) > 20 AS truncated
FROM corpus WHERE contains(lower(path), '/fr/')""")
def find_file_stats(spark, sf):
    return index.find_file_stats(corpus.document_paths(spark, sf), "/FR/")


@query("find_page", f"""SELECT path, 'substring' AS match_type, 1.0::DOUBLE AS score, 'filename_match' AS reason
FROM (SELECT {PAGE_PATH} AS path FROM pages) WHERE contains(lower(path), 'example.com/') ORDER BY path LIMIT 50""")
def find_page(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return index.find_file(pages.select(corpus.page_path(pages["url"], pages["page_id"]).alias("path")), "example.com/", max_results=50)


MAP = """SELECT regexp_extract(path, '^(.*)/', 1) AS directory, count(*) AS files,
       array_to_string(list_sort(list_distinct(list({lang}))), ',') AS languages
FROM corpus WHERE {scope} GROUP BY 1 ORDER BY 1 LIMIT {limit}"""


@query("repo_map", with_ctes(CORPUS) + MAP.format(lang=language_sql(), scope="TRUE", limit=200))
def repo_map(spark, sf):
    return index.repo_map(corpus.document_paths(spark, sf), max_results=200)


@query("repo_map_scoped", with_ctes(CORPUS) + MAP.format(lang=language_sql(), scope="prefix(path, 'tests/')", limit=20))
def repo_map_scoped(spark, sf):
    return index.repo_map(corpus.document_paths(spark, sf), scope=["tests"], max_results=20)


@query("scope_counts", with_ctes(CORPUS) + """SELECT count(*) FILTER (WHERE prefix(path, 'tests/')) AS file_count,
       count(*) AS total_file_count, TRUE AS scope_applied FROM corpus""")
def scope_counts(spark, sf):
    return index.scope_counts(corpus.document_paths(spark, sf), ["tests"])


@query("languages", with_ctes(CORPUS) + f"SELECT DISTINCT {language_sql()} AS language FROM corpus WHERE {language_sql()} <> 'text'")
def languages(spark, sf):
    return index.languages(corpus.document_paths(spark, sf))
