"""Streams run to the end over tables, then read back from their output folder.

Inputs that the tables do not hold as files (path events) are first derived and
written under the session's checkpoint folder, as a feed would deliver them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import handles
from ..session import checkpoint_dir
from ..sources import corpus
from ..streaming import reconcile, stateful
from .base import query, with_ctes
from .index_queries import EVENTS_SQL, path_events


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("stream_tail", """SELECT conv_id::VARCHAR AS run_id, right(string_agg(text, '' ORDER BY turn), 400) AS tail,
  sum(length(text))::BIGINT - least(sum(length(text)), 400)::BIGINT AS dropped_chars FROM conversations GROUP BY conv_id""")
def stream_tail(spark, sf):
    """Conversations as runs, turns as output chunks."""
    out = _scratch(spark, "tails")
    source = spark.read.parquet(f"{sf}/conversations.parquet").schema
    turns = spark.readStream.schema(source).parquet(f"{sf}/conversations.parquet*")
    chunks = turns.select(F.col("conv_id").cast("string").alias("run_id"), F.col("turn").cast("int").alias("seq"), "text")
    stream = stateful.accumulate_tail(chunks, 400).writeStream.outputMode("update").trigger(availableNow=True)
    stream = stream.option("checkpointLocation", f"{out}/checkpoint")
    stream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    # A later batch of a run replaces its earlier row.
    return rows.groupBy("run_id").agg(F.max_by(F.struct("tail", "dropped_chars"), "batch").alias("r")).select("run_id", "r.*")


def _feed(spark, sf, removed_at: str, written_at: str):
    """Documents as the base, label-derived path events as the feed, run to its end."""
    out = _scratch(spark, "feed")
    files, changed = path_events(spark, sf)
    reconcile.initialise(files, f"{out}/state", buckets=8)
    when = F.when(F.col("content").isNull(), F.lit(removed_at)).otherwise(F.lit(written_at)).cast("timestamp")
    events = changed.select("path", "content", F.lit("external").alias("origin"), when.alias("ts"))
    events.write.parquet(f"{out}/events")
    feed = spark.readStream.schema(reconcile.EVENT_SCHEMA).parquet(f"{out}/events")
    reconcile.start(feed, f"{out}/state", f"{out}/checkpoint", "0 seconds", available_now=True).awaitTermination()
    return reconcile.current(spark, f"{out}/state").select("path", "hash")


_SNAPSHOT_SQL = """SELECT coalesce(c.path, k.path) AS path, sha256(coalesce(c.content, k.content)) AS hash
FROM (SELECT * FROM corpus ANTI JOIN removed USING (path)) k
FULL JOIN (SELECT * FROM changed WHERE content IS NOT NULL{late}) c ON k.path = c.path"""


@query("stream_reconcile", with_ctes(*EVENTS_SQL) + _SNAPSHOT_SQL.format(late=""))
def stream_reconcile(spark, sf):
    """Directories vanish before files are written again."""
    return _feed(spark, sf, "2024-01-01", "2024-01-02")


@query("stream_reconcile_late_delete", with_ctes(*EVENTS_SQL) + _SNAPSHOT_SQL.format(
    late=" AND NOT EXISTS (SELECT 1 FROM gone WHERE prefix(changed.path, gone.path || '/'))"))
def stream_reconcile_late_delete(spark, sf):
    """Directories vanish after files below them were written, in one batch."""
    return _feed(spark, sf, "2024-01-02", "2024-01-01")
