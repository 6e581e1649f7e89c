"""Change-log queries over ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changelog
from ..sources import corpus
from .base import query, with_ctes

LOG = """log AS (SELECT event_id AS generation, 'user/' || user_id || '/v' || floor(value)::BIGINT || '.log' AS path, event_type AS source, ts AS "timestamp", value, user_id FROM events)"""


@query("changes_since", with_ctes(LOG) + "SELECT generation, path, source FROM log WHERE generation > 40 ORDER BY generation DESC LIMIT 200")
def changes_since(spark, sf):
    return changelog.changes_since(corpus.events_log(spark, sf), 40).select("generation", "path", "source")


@query("changes_by_source", with_ctes(LOG) + "SELECT generation, path, source FROM log WHERE generation > 40 AND source = 'error' ORDER BY generation DESC LIMIT 500")
def changes_by_source(spark, sf):
    return changelog.changes_since(corpus.events_log(spark, sf), 40, "error", 500).select("generation", "path", "source")


@query("log_retention", with_ctes(LOG) + "SELECT generation, path FROM log ORDER BY generation DESC, path DESC LIMIT 2000")
def log_retention(spark, sf):
    return changelog.retain(corpus.events_log(spark, sf)).select("generation", "path")


@query("changed_path_groups", with_ctes(LOG, """groups AS (SELECT regexp_extract(path, '^([^/]*/[^/]*)/', 1) AS g, count(DISTINCT path) AS n FROM log GROUP BY 1)""",
    "ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, g) AS rank, count(*) OVER () AS total FROM groups)") + """
SELECT rank, g AS "group", n AS paths FROM ranked WHERE rank < 20 OR total <= 20
UNION ALL SELECT 20, '(other)', sum(n)::BIGINT FROM ranked WHERE rank >= 20 AND total > 20 HAVING count(*) > 0""")
def changed_path_groups(spark, sf):
    return changelog.changed_groups(corpus.events_log(spark, sf))


@query("changed_paths", with_ctes(LOG) + "SELECT DISTINCT path FROM log ORDER BY path LIMIT 30")
def changed_paths(spark, sf):
    return changelog.changed_paths(corpus.events_log(spark, sf))


@query("changed_summary", with_ctes(LOG) + 'SELECT count(DISTINCT path) AS "count", count(DISTINCT path) > 30 AS truncated FROM log')
def changed_summary(spark, sf):
    return changelog.changed_summary(corpus.events_log(spark, sf))


@query("dirty_symmetric_difference", with_ctes(LOG) + """SELECT path, CASE WHEN bool_or(source = 'click') THEN 'left' ELSE 'right' END AS side
FROM log WHERE source IN ('click', 'view') GROUP BY path HAVING count(DISTINCT source) = 1""")
def dirty_symmetric_difference(spark, sf):
    log = corpus.events_log(spark, sf)
    return changelog.symmetric_difference(log.filter(F.col("source") == "click"), log.filter(F.col("source") == "view"))


@query("dirty_ownership", with_ctes(LOG) + """SELECT path, bool_or(source = 'click') AS own, bool_or(source <> 'click') AS "external"
FROM log WHERE path IN (SELECT path FROM log WHERE source = 'purchase') GROUP BY path""")
def dirty_ownership(spark, sf):
    log = corpus.events_log(spark, sf)
    return changelog.partition_by_owner(log.filter(F.col("source") == "purchase"), log, "click")


@query("run_attribution", with_ctes(LOG, """runs AS (SELECT strftime(date_trunc('hour', "timestamp"), '%Y-%m-%d %H') AS run_id, min(generation) - 1 AS a, max(generation) AS b,
  min("timestamp") + INTERVAL 30 MINUTE AS ended_at FROM log GROUP BY 1)""") + """SELECT run_id, path, count(*) AS changes FROM runs JOIN log
  ON generation > a AND generation <= b AND "timestamp" <= ended_at GROUP BY run_id, path""")
def run_attribution(spark, sf):
    log = corpus.events_log(spark, sf)
    runs = log.groupBy(F.date_format(F.date_trunc("hour", "timestamp"), "yyyy-MM-dd HH").alias("run_id")).agg(
        (F.min("generation") - 1).alias("start_generation"), F.max("generation").alias("end_generation"),
        (F.min("timestamp") + F.expr("INTERVAL 30 MINUTES")).alias("ended_at"),
    )
    return changelog.attribute_runs(log, runs)


@query("run_attribution_frozen", with_ctes(LOG, """runs AS (SELECT strftime(date_trunc('hour', "timestamp"), '%Y-%m-%d %H') AS run_id, min(generation) - 1 AS a,
  coalesce(min(generation) FILTER (source = 'error'), max(generation)) AS b, arg_min("timestamp", generation) FILTER (source = 'error') AS ended_at FROM log GROUP BY 1)""") + """
SELECT run_id, path, count(*) AS changes FROM runs JOIN log ON generation > a AND generation <= b AND (ended_at IS NULL OR "timestamp" <= ended_at) GROUP BY run_id, path""")
def run_attribution_frozen(spark, sf):
    """Hours as runs, each frozen at its first error."""
    log = corpus.events_log(spark, sf)
    polls = log.select(F.date_format(F.date_trunc("hour", "timestamp"), "yyyy-MM-dd HH").alias("run_id"), "generation", "timestamp", F.col("source").alias("state"))
    return changelog.attribute_runs(log, changelog.frozen_runs(polls, ["error"]))


@query("run_retention", with_ctes(LOG, """runs AS (SELECT user_id AS run_id, CASE WHEN arg_max(source, generation) = 'signup' THEN NULL ELSE max(generation) END AS ended_at FROM log GROUP BY 1)""",
    "finished AS (SELECT *, row_number() OVER (ORDER BY ended_at DESC, run_id DESC) AS rank FROM runs WHERE ended_at IS NOT NULL)") + """
SELECT run_id, TRUE AS active FROM runs WHERE ended_at IS NULL
UNION ALL SELECT run_id, FALSE FROM finished WHERE rank <= 128 - (SELECT count(*) FROM runs WHERE ended_at IS NULL)""")
def run_retention(spark, sf):
    log = corpus.events_log(spark, sf)
    runs = log.groupBy(F.col("user_id").alias("run_id")).agg(F.max_by("source", "generation").alias("last"), F.max("generation").alias("g"))
    runs = runs.select("run_id", F.when(F.col("last") != "signup", F.col("g")).alias("ended_at"))
    return changelog.retain_runs(runs).select("run_id", F.col("ended_at").isNull().alias("active"))


NEWEST = "newest AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY generation DESC) AS rank FROM log)"


@query("median_latency", with_ctes(LOG, NEWEST) + """SELECT source, count(*) AS samples, list_sort(list(value))[(count(*) - 1) // 2 + 1] AS p50
FROM newest WHERE rank <= 64 GROUP BY source""")
def median_latency(spark, sf):
    return changelog.lower_median(corpus.events_log(spark, sf), "source", "value", [F.desc("generation")])


@query("p95_latency", with_ctes(LOG, NEWEST) + """SELECT source, count(*) AS samples, list_sort(list(value))[floor((count(*) - 1) * 0.95 + 0.5)::INT + 1] AS p95
FROM newest WHERE rank <= 64 GROUP BY source""")
def p95_latency(spark, sf):
    return changelog.rounded_p95(corpus.events_log(spark, sf), "source", "value", [F.desc("generation")])


@query("tail_retention", """SELECT conv_id, right(string_agg(text, '' ORDER BY turn), 400) AS tail, sum(length(text))::BIGINT - least(sum(length(text)), 400)::BIGINT AS dropped_chars
FROM conversations GROUP BY conv_id""")
def tail_retention(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text")
    return changelog.retain_tail(turns, "conv_id", "turn", "text", 400)
