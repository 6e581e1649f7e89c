"""The same results in DuckDB's SQL, for the operators that SQL can express."""

from __future__ import annotations

from . import license, linetemplates, revisit, urlfilter

WORD = r"[^\x20\x09-\x0D]+"

OP10 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS ws FROM d),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM w),
grams AS (
  SELECT doc_id, p, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
again AS (SELECT doc_id, p FROM grams WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM again, range(0, 5) r(o) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0) AS n_lines,
         length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS upper
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words
         AND 10 * n_dup_lines <= 3 * n_lines AND (letters = 0 OR upper::DOUBLE / letters <= 0.5) AS kept
FROM judged"""

_templates = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(license.TEMPLATES))


def _shingles(name: str, source: str, keys: str, text: str) -> str:
    words = rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return f"""{name}_w AS (SELECT {keys}, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM (SELECT {keys}, {words} AS ws FROM {source})),
{name} AS (
  SELECT {keys}, p, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS s
  FROM {name}_w WINDOW o AS (PARTITION BY {keys} ORDER BY p) QUALIFY s IS NOT NULL)"""


OP3 = f"""
WITH given(template_id, license, template) AS (VALUES {_templates}),
{_shingles("cut", "given", "template_id, license", "template")},
t AS (SELECT DISTINCT template_id, license, s FROM cut),
sized AS (SELECT template_id, license, count(*) AS n, (2 ** ceil(log2(count(*))))::INT AS c FROM t GROUP BY ALL),
{_shingles("doc", "documents", "doc_id", "text")},
hits AS (SELECT doc_id, p, s, template_id, license, n, c FROM doc JOIN t USING (s) JOIN sized USING (template_id, license)),
placed AS (
  SELECT *, p - p % c AS start FROM hits UNION ALL SELECT *, p - p % c - c AS start FROM hits WHERE p - p % c - c >= 0),
shares AS (SELECT doc_id, template_id, license, start, count(DISTINCT s)::DOUBLE / any_value(n) AS share FROM placed GROUP BY ALL)
SELECT doc_id, template_id::INT AS template_id, license, max(share) AS containment, min(start)::INT AS first_word, count(*) AS windows
FROM shares WHERE share >= {license.CONTAINMENT} GROUP BY ALL"""

_not_merged = ", ".join(f"'{n}'" for n in revisit.NOT_MERGED)


def _headers(*pairs: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"{{'k': '{k}', 'v': {v}}}" for k, v in pairs) + "], lambda e: e.v IS NOT NULL)"


def _get(headers: str, name: str) -> str:
    return f"list_filter({headers}, lambda e: e.k = '{name}')[1].v"


_tag = """'"' || md5(coalesce(html, '')) || '"'"""
_day = "'day ' || (page_id % 97)"
_ts = "1700000000 + (page_id * 7919) % 1000003"
_response = _headers(
    ("content-type", "'text/html'"), ("content-length", "strlen(coalesce(html, ''))::VARCHAR"), ("cache-control", "'max-age=60'"),
    ("etag", f"CASE WHEN page_id % 5 <> 4 THEN {_tag} END"), ("last-modified", f"CASE WHEN page_id % 7 <> 6 THEN {_day} END"),
)
_second = _headers(
    ("etag", f"CASE page_id % 3 WHEN 0 THEN 'W/' || {_tag} WHEN 1 THEN {_tag} ELSE '\"other\"' END"),
    ("cache-control", "'max-age=120'"), ("content-length", "'0'"), ("connection", "'close, X-Hop'"), ("x-hop", "'1'"), ("x-cache", "'hit'"),
)
_fourth = _headers(("last-modified", f"CASE WHEN page_id % 4 <> 0 THEN {_day} ELSE 'day 1000' END"), ("expires", "'0'"))

OP5 = f"""
WITH rest AS (SELECT *, regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''), '^https?://(www[0-9]*\\.)?', '') AS r FROM pages),
parts AS (
  SELECT *, regexp_replace(regexp_extract(r, '^([^/?]*)', 1), ':(80|443)$', '') || regexp_replace(regexp_extract(r, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(r, '\\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '{revisit.DROPPED_PARAMETERS}'))), '&') AS q
  FROM rest),
keyed AS (SELECT *, base || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url_key FROM parts),
records AS (
  SELECT 4 * page_id AS record_id, url_key, {_ts} AS ts, 1 AS late, {_response} AS h FROM keyed
  UNION ALL SELECT 4 * page_id + 1, url_key, {_ts} + 100 + page_id % 50, 0, {_second} FROM keyed
  UNION ALL SELECT 4 * page_id + 2, url_key, {_ts} - 10, 0, {_headers(("date", "'earlier'"))} FROM keyed
  UNION ALL SELECT 4 * page_id + 3, url_key, {_ts} + 500, 0, {_fourth} FROM keyed),
joined AS (
  SELECT *, last_value(CASE WHEN late = 1 THEN {{'id': record_id, 'h': h}} END IGNORE NULLS)
    OVER (PARTITION BY url_key ORDER BY ts, late, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
  FROM records),
judged AS (
  SELECT *, {_get("h", "etag")} AS tag, {_get("h", "last-modified")} AS modified,
    {_get("prior.h", "etag")} AS ptag, {_get("prior.h", "last-modified")} AS pmodified,
    list_transform(string_split(lower(coalesce({_get("h", "connection")}, '')), ','), lambda x: trim(x)) AS hop
  FROM joined WHERE late = 0),
told AS (
  SELECT *, CASE WHEN prior IS NULL THEN 'no_response'
    WHEN tag IS NOT NULL AND ptag IS NOT NULL THEN CASE WHEN regexp_replace(tag, '^W/', '') = regexp_replace(ptag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
    WHEN modified IS NOT NULL AND pmodified IS NOT NULL THEN CASE WHEN modified = pmodified THEN 'resolved' ELSE 'mismatch' END
    WHEN tag IS NULL AND modified IS NULL THEN 'resolved' ELSE 'not_comparable' END AS outcome,
    list_filter(h, lambda x: x.k NOT IN ({_not_merged}) AND NOT list_contains(hop, x.k)) AS upd
  FROM judged)
SELECT record_id, url_key, outcome, CASE WHEN outcome = 'resolved' THEN prior.id END AS response_id,
  CASE WHEN outcome = 'resolved' THEN array_to_string(list_sort(list_transform(list_concat(
    list_filter(prior.h, lambda x: NOT list_contains(list_transform(upd, lambda u: u.k), x.k)), upd), lambda x: x.k || ': ' || x.v)), chr(10)) END AS headers
FROM told"""

OP9 = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents),
cut AS (
  SELECT doc_id, line, ln, list_transform(regexp_extract_all(line, '{WORD}'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS ts FROM lines),
placed AS (SELECT *, len(ts) AS n, least(3, len(ts) // 3) AS lead, least({linetemplates.FIELDS}, len(ts) - least(3, len(ts) // 3)) AS parts
           FROM cut WHERE len(ts) >= {linetemplates.LEAST_TOKENS}),
fields AS (
  SELECT doc_id, ln, n, parts, n || chr(30) || array_to_string(ts[1:lead], chr(31)) AS path,
         list_transform(range(0, parts), lambda i: array_to_string(ts[lead + (n - lead) * i // parts + 1 : lead + (n - lead) * (i + 1) // parts], chr(31))) AS fs
  FROM placed),
spelled AS (
  SELECT doc_id, ln, n, unnest(list_concat([path || chr(30) || array_to_string(fs, chr(30))],
    CASE WHEN n >= {linetemplates.GENERAL} THEN list_transform(range(1, parts + 1), lambda j:
      path || chr(30) || array_to_string(list_transform(fs, lambda f, i: CASE WHEN i = j THEN '<*>' ELSE f END), chr(30))) ELSE [] END)) AS template
  FROM fields),
known AS (
  SELECT template, min(doc_id) AS first_doc FROM spelled GROUP BY template
  HAVING count(DISTINCT doc_id) >= any_value(CASE WHEN n >= {linetemplates.LONG} THEN {linetemplates.LONG_DOCS} ELSE {linetemplates.SHORT_DOCS} END)),
gone AS (SELECT DISTINCT doc_id, ln FROM spelled JOIN known USING (template) WHERE doc_id > first_doc),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE gone.ln IS NULL) AS kept, count(*) AS n_lines, count(gone.ln) AS n_dropped
  FROM lines LEFT JOIN gone USING (doc_id, ln) GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM documents LEFT JOIN kept USING (doc_id)"""

# CRC-32 of a list of bytes, by its table of 256 remainders (column ``t`` of ``tab``).
_TAB = "tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t)"


def _crc32(octets: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


# Letters of a run are below U+0100, so they have one or two bytes.
_octets = "flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END))"

OP11 = rf"""
WITH RECURSIVE {_TAB},
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{7,}}')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT *, {_crc32(_octets)} AS h FROM runs, tab),
spelled AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed),
v AS (SELECT word, sum(times)::BIGINT AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
holes AS (SELECT word, n, left(word, i - 1) || chr(1) || substr(word, i + 1) AS hole, left(word, i - 1) || substr(word, i + 1) AS shorter FROM cut),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b USING (hole) WHERE a.word <> b.word
  UNION SELECT h.word, v.word, v.n FROM holes h JOIN v ON v.word = h.shorter
  UNION SELECT v.word, h.word, h.n FROM holes h JOIN v ON v.word = h.shorter),
best AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
told AS (
  SELECT v.word, CASE WHEN near_n >= 10 * v.n THEN near END AS form, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, 0 AS step FROM told UNION ALL SELECT walk.word, told.form, step + 1 FROM walk JOIN told ON told.word = walk.root WHERE told.form IS NOT NULL)
SELECT told.word, form, arg_max(root, step) AS root, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n) AS form_n
FROM told JOIN walk USING (word) GROUP BY told.word, form"""

_digits = "list_transform(string_split(conv_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)"

OP12 = rf"""
WITH {_TAB},
turns AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({{'k': md5(r) || md5(x), 's': length(x)}} ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) AS ts FROM turns GROUP BY conv_id),
asked AS (SELECT conv_id, ts, conv_id - conv_id % 100 AS base, {_crc32(_digits)} % 6 AS h FROM own, tab),
rebuilt AS (SELECT a.conv_id, list_concat(coalesce(b.ts[1:h], []), a.ts[h + 1:]) AS ts FROM asked a LEFT JOIN own b ON b.conv_id = a.base),
paths AS (SELECT conv_id, ts, len(ts) AS size, unnest(range(0, len(ts) + 1)) AS depth FROM rebuilt),
steps AS (
  SELECT conv_id, size, depth, CASE WHEN depth > 0 THEN ts[depth].s ELSE 0 END AS tokens,
    md5(array_to_string(list_transform(ts[1:depth], lambda e: e.k), '')) AS node,
    CASE WHEN depth > 0 THEN md5(array_to_string(list_transform(ts[1:depth - 1], lambda e: e.k), '')) END AS above
  FROM paths),
nodes AS (
  SELECT depth, node, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(tokens) AS tokens,
    coalesce(array_to_string(list(conv_id::VARCHAR ORDER BY conv_id) FILTER (size = depth), ','), '') AS ends
  FROM steps GROUP BY depth, node),
counted AS (SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.above = n.node) AS n_children FROM nodes n),
sums AS (
  SELECT s.depth, s.node, sum((n.n_convs - 1) * n.tokens)::BIGINT AS saved_tokens, count(*) FILTER (n.n_children = 0) AS n_leaves
  FROM counted n JOIN steps s ON s.conv_id = n.conv_id AND s.depth <= n.depth GROUP BY s.depth, s.node)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted c JOIN sums USING (depth, node) LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.node = c.above"""

_rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")))
_globs = " OR ".join(f"(host GLOB '{h}' AND path GLOB '{p}')" for h, p in urlfilter.BLOCKED)

OP13 = f"""
WITH rules(verdict, rule_host, rule_path) AS (VALUES {_rules}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
judged AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, {_globs} AS listed, rules.verdict
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM judged"""

ORACLE_SQL = {"op3_license": OP3, "op5_revisit": OP5, "op9_line_templates": OP9, "op10_cascade": OP10, "op11_spelling": OP11, "op12_turntrie": OP12, "op13_urlfilter": OP13}
