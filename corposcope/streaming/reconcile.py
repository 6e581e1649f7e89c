"""Change feed to snapshot: deduplicated batches, deltas, generations.

State is a base table plus one delta folder per micro-batch, both partitioned by
a hash bucket of the path.  A batch joins its paths with the snapshot by bucket
and path; nothing is rewritten until ``compact``.  Folders are named by batch id and overwritten on a retry, so a
batch that runs twice leaves one result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import handles, paths
from ..functions.rows import unnest
from ..session import checkpoint_dir

BUCKETS = 256
EVENT_SCHEMA = "path STRING, content STRING, origin STRING, ts TIMESTAMP"
ROW = "bucket INT, path STRING, content STRING, hash STRING, batch_id BIGINT"


def bucket(path: Column | str, buckets: int) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.pmod(F.xxhash64(p), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def initialise(corpus: DataFrame, state: str, buckets: int = BUCKETS) -> None:
    """Write the base table from a corpus.

    ``buckets`` should leave a bucket's path and hash columns small enough to read
    in every batch; a few thousand suit a corpus of many billions of files.
    """
    rows = corpus.select(
        bucket("path", buckets).alias("bucket"), "path", "content", handles.content_hash("content").alias("hash"),
        F.lit(-1).cast("bigint").alias("batch_id"),
    )
    _write_base(rows, f"{state}/base-0")
    _point(corpus.sparkSession, state, 0, -1, buckets)


def _write_base(rows: DataFrame, target: str) -> None:
    # Ranges of (bucket, path): a large bucket is written by many tasks.
    rows.repartitionByRange("bucket", "path").write.mode("overwrite").partitionBy("bucket").parquet(target)


def _point(spark: SparkSession, state: str, version: int, upto: int, buckets: int) -> None:
    row = spark.createDataFrame([(version, upto, buckets)], "version INT, upto BIGINT, buckets INT")
    row.coalesce(1).write.mode("append").parquet(f"{state}/versions")


def _base(spark: SparkSession, state: str) -> tuple[str, int, int]:
    row = spark.read.parquet(f"{state}/versions").orderBy(F.desc("version")).first()
    return f"{state}/base-{row['version']}", row["upto"], row["buckets"]


def current(spark: SparkSession, state: str, before: int | None = None) -> DataFrame:
    """The snapshot: the newest delta row of a path wins over its base row."""
    location, upto, _ = _base(spark, state)
    base = _read(spark, location, ROW)
    deltas = _read(spark, f"{state}/deltas", ROW).filter(F.col("batch_id") > upto)
    if before is not None:
        deltas = deltas.filter(F.col("batch_id") < before)
    newest = deltas.groupBy("bucket", "path").agg(F.max_by(F.struct("content", "hash", "batch_id"), "batch_id").alias("n"))
    kept = base.join(newest.select("bucket", "path"), ["bucket", "path"], "left_anti")
    fresh = newest.filter(F.col("n.hash").isNotNull()).select("bucket", "path", "n.content", "n.hash", "n.batch_id")
    return kept.select("bucket", "path", "content", "hash", "batch_id").unionByName(fresh)


def mutations(spark: SparkSession, state: str) -> DataFrame:
    """The log of outside changes."""
    schema = "generation BIGINT, path STRING, after_hash STRING, source STRING, timestamp TIMESTAMP, batch_id BIGINT"
    return _read(spark, f"{state}/mutations", schema)


def generation(spark: SparkSession, state: str) -> int:
    """Number of batches that changed something."""
    return _read(spark, f"{state}/generations", "generation BIGINT, batch_id BIGINT").count()


def apply_batch(events: DataFrame, batch_id: int, state: str) -> None:
    """Fold one micro-batch of path events into the state.

    Events of a path collapse to the last one.  A vanished path takes everything
    below it along.  The generation moves only when some hash changed.
    """
    spark = events.sparkSession
    buckets = _base(spark, state)[2]
    usable = events.filter(~paths.is_excluded("path") & (F.col("path") != ""))
    # Of events at one time the removal counts last, then the larger text.
    newest = F.struct("ts", F.col("content").isNull(), "content", "origin")
    last = usable.groupBy("path").agg(F.max_by(F.struct("content", "origin", "ts"), newest).alias("e")).select("path", "e.*")
    # A file written before its directory vanished in the same batch vanishes with it.
    removed = last.filter(F.col("content").isNull()).select(F.col("path").alias("dir"), F.col("origin").alias("dir_origin"), F.col("ts").alias("dir_ts"))
    parents = unnest(last, F.slice(paths.ancestors("path"), F.lit(1), F.size(F.split("path", "/")) - 1), "dir", "path")
    swept = parents.join(removed, "dir").groupBy("path").agg(F.max(F.struct("dir_ts", "dir_origin")).alias("d"))
    late = F.col("d.dir_ts") > F.col("ts")
    last = last.join(swept, "path", "left").select(
        "path", F.when(late, F.lit(None).cast("string")).otherwise(F.col("content")).alias("content"),
        F.when(late, F.col("d.dir_origin")).otherwise(F.col("origin")).alias("origin"),
        F.when(late, F.col("d.dir_ts")).otherwise(F.col("ts")).alias("ts"), bucket("path", buckets).alias("bucket"),
    )
    now = current(spark, state, before=batch_id)
    touched = last.join(now.select("bucket", "path", F.col("hash").alias("old")), ["bucket", "path"], "left").select(
        "bucket", "path", "content", handles.content_hash("content").alias("hash"), "old", "origin", "ts"
    )
    direct = touched.filter(~F.col("hash").eqNullSafe(F.col("old")))
    gone = last.filter(F.col("content").isNull()).select(F.col("path").alias("dir"), "origin", "ts")
    # Only the path and hash columns of the snapshot are read for this.
    below = unnest(now, F.slice(paths.ancestors("path"), F.lit(1), F.size(F.split("path", "/")) - 1), "dir", "bucket", "path", F.col("hash").alias("old"))
    below = below.join(gone, "dir").groupBy("bucket", "path", "old").agg(F.first("origin").alias("origin"), F.max("ts").alias("ts"))
    none = F.lit(None).cast("string")
    children = below.join(last.select("path"), "path", "left_anti").select(
        "bucket", "path", none.alias("content"), none.alias("hash"), "old", "origin", "ts"
    )
    changed = direct.unionByName(children).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    delta = f"{state}/deltas/batch_id={batch_id}"
    out = changed.select("bucket", "path", "content", "hash", "old", "origin", "ts")
    out.write.mode("overwrite").parquet(f"{state}/staging/batch_id={batch_id}")
    staged = spark.read.parquet(f"{state}/staging/batch_id={batch_id}")
    if staged.isEmpty():
        return
    staged.select("bucket", "path", "content", "hash").write.mode("overwrite").parquet(delta)
    earlier = _read(spark, f"{state}/generations", "generation BIGINT, batch_id BIGINT").filter(F.col("batch_id") < batch_id).count()
    mark = spark.createDataFrame([(earlier + 1,)], "generation BIGINT").coalesce(1)
    mark.write.mode("overwrite").parquet(f"{state}/generations/batch_id={batch_id}")
    outside = staged.filter(F.col("origin") != "internal").select(
        F.lit(earlier + 1).cast("bigint").alias("generation"), "path", F.col("hash").alias("after_hash"),
        F.lit("external").alias("source"), F.col("ts").alias("timestamp"),
    )
    outside.write.mode("overwrite").parquet(f"{state}/mutations/batch_id={batch_id}")


def compact(spark: SparkSession, state: str, upto: int) -> None:
    """Write a new base that includes all deltas up to a batch; readers switch to
    it when its version row appears."""
    location, _, buckets = _base(spark, state)
    version = int(location.rsplit("-", 1)[1]) + 1
    rows = current(spark, state, before=upto + 1)
    _write_base(rows, f"{state}/base-{version}")
    _point(spark, state, version, upto, buckets)


def start(
    events: DataFrame, state: str, checkpoint: str | None = None, interval: str = "2 seconds", available_now: bool = False
) -> StreamingQuery:
    """Run the feed; the trigger interval is the debounce between reconciles.

    ``available_now`` works off what has arrived and stops.
    """
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    # The state's name keeps the offsets of several feeds apart.
    checkpoint = checkpoint or f"{checkpoint_dir(events.sparkSession)}/reconcile-{uuid.uuid5(uuid.NAMESPACE_URL, state).hex}"
    return (
        events.writeStream.foreachBatch(lambda df, batch_id: apply_batch(df, batch_id, state))
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
