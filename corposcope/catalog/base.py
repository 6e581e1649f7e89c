"""Query registry and the SQL fragments the checks share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions import paths
from ..functions.terms import STOP_WORDS, TERM_PATTERN
from ..sources.corpus import DOCUMENT_DIRS, DOCUMENT_EXTENSIONS


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        REGISTRY[name] = Query(name, build, sql)
        return build

    return register


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_set(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


CORPUS = f"""corpus AS (
  SELECT doc_id,
         ({sql_list(DOCUMENT_DIRS)})[1 + doc_id % {len(DOCUMENT_DIRS)}] || '/' || source || '/' || lang || '/doc_' || doc_id
           || ({sql_list(DOCUMENT_EXTENSIONS)})[1 + doc_id % {len(DOCUMENT_EXTENSIONS)}] AS path,
         text AS content
  FROM documents)"""

PARTS = """parts AS (
  SELECT path, content, string_split(content, chr(10))[1:n] AS ls, greatest(n, 1) AS lc
  FROM (SELECT path, content,
               len(string_split(content, chr(10))) - CASE WHEN content = '' OR suffix(content, chr(10)) THEN 1 ELSE 0 END AS n
        FROM corpus))"""

LINES = """lines AS (
  SELECT path, lc, unnest(ls) AS text, generate_subscripts(ls, 1) AS line FROM parts)"""

BASE = [CORPUS, PARTS, LINES]

TERMS = f"list_filter(list_distinct(list_transform(regexp_extract_all({{text}}, '{TERM_PATTERN}'), lambda t: lower(t))), lambda t: t NOT IN {sql_set(STOP_WORDS)})"


def terms_sql(text: str) -> str:
    return TERMS.format(text=text)


LANGUAGE = "CASE " + " ".join(
    f"WHEN ext IN {sql_set(exts)} THEN '{name}'" for name, exts in paths.LANGUAGE_EXTENSIONS.items()
) + " ELSE 'text' END"


def language_sql(path: str = "path") -> str:
    ext = f"lower(regexp_extract({path}, '[^/]\\.([^./]*)$', 1))"
    return LANGUAGE.replace("ext IN", f"{ext} IN")


def document_type_sql(path: str = "path") -> str:
    segs = f"string_split(lower({path}), '/')"
    base = f"string_split(lower({path}), '/')[-1]"
    ends = lambda suffixes: "(" + " OR ".join(f"suffix({base}, '{s}')" for s in suffixes) + ")"
    has = lambda names: f"list_has_any({segs}, {sql_list(names)})"
    return (
        f"CASE WHEN {base} IN {sql_set(paths.INSTRUCTION_NAMES)} THEN 'instruction' "
        f"WHEN {has(paths.TEST_SEGMENTS)} OR prefix({base}, 'test_') OR {ends(paths.TEST_SUFFIXES)} THEN 'test' "
        f"WHEN {has(paths.EVIDENCE_SEGMENTS)} AND {ends(paths.EVIDENCE_SUFFIXES)} THEN 'runtime_evidence' "
        f"WHEN {has(paths.ARTIFACT_SEGMENTS)} OR {ends(paths.ARTIFACT_SUFFIXES)} THEN 'artifact' "
        f"WHEN suffix({base}, '.log') THEN 'log' ELSE 'source' END"
    )


def handle_sql(path: str, a: str, b: str, digest: str, workspace: str = "main") -> str:
    body = f"""'{{"w":"{workspace}","p":"' || {path} || '","a":' || {a} || ',"b":' || {b} || ',"h":"' || {digest} || '"}}'"""
    return f"'range:' || {base64url_sql(body)}"


def base64url_sql(body: str) -> str:
    return f"rtrim(translate(to_base64(encode({body})), '+/', '-_'), '=')"


def preview_sql(a: str = "start_line", b: str = "end_line", ls: str = "ls") -> str:
    return f"ltrim(array_to_string({ls}[{a}:{b}], chr(10)), chr(10))"


def windows_sql(condition: str, context: int, files: str = "lines") -> list[str]:
    """hits -> marked -> numbered -> windows(path, island, line, start_line, end_line)."""
    return [
        f"""hits AS (SELECT path, line, greatest(line - {context}, 1) AS s, least(line + {context}, lc) AS e
            FROM {files} WHERE {condition})""",
        """marked AS (SELECT *, CASE WHEN s <= lag(e) OVER (PARTITION BY path ORDER BY line) + 1 THEN 0 ELSE 1 END AS opens
            FROM hits)""",
        """numbered AS (SELECT *, sum(opens) OVER (PARTITION BY path ORDER BY line) AS island FROM marked)""",
        """windows AS (SELECT path, island, min(line) AS line, min(s) AS start_line, max(e) AS end_line
            FROM numbered GROUP BY path, island)""",
    ]


# Identifier runs with 1-based column; the class names letters and numbers by
# category, which agrees with the alphabetic property on the given texts.
RUN = r"[_$\p{L}\p{N}\x{200C}\x{200D}\x{0300}-\x{036F}\x{1AB0}-\x{1AFF}\x{1DC0}-\x{1DFF}\x{20D0}-\x{20FF}\x{FE20}-\x{FE2F}]+"

TOKENS = f"""tokenized AS (
  SELECT path, line, unnest(regexp_extract_all(text, '{RUN}')) AS token,
         unnest(list_transform(regexp_split_to_array(text, '{RUN}')[1:len(regexp_extract_all(text, '{RUN}'))], lambda g: length(g))) AS gap,
         generate_subscripts(regexp_extract_all(text, '{RUN}'), 1) AS k
  FROM lines),
tokens AS (
  SELECT path, line, k, token,
         1 + sum(gap + length(token)) OVER (PARTITION BY path, line ORDER BY k) - length(token) AS col
  FROM tokenized)"""

SYMBOLS = r"""heads AS (
  SELECT path, lc, line, text, regexp_extract(text, '^(\p{Lu}\p{L}*)', 1) AS name FROM lines
  WHERE regexp_extract(text, '^(\p{Lu}\p{L}*)', 1) <> ''),
symbols AS (
  SELECT path, name, 'heading' AS kind, line AS start_line,
         coalesce(lead(line) OVER (PARTITION BY path ORDER BY line) - 1, lc) AS end_line,
         left(regexp_replace(text, '^\s+|\s+$', '', 'g'), 300) AS signature,
         row_number() OVER (PARTITION BY path ORDER BY line) AS ordinal
  FROM heads
  UNION ALL
  SELECT path, regexp_extract(path, '([^/]*?)(?:\.[^./]*)?$', 1), 'document', 1, lc,
         left(regexp_replace(coalesce(ls[1], ''), '^\s+|\s+$', '', 'g'), 300), 0
  FROM parts)"""
