"""Change-log queries: cursors, roll-ups, set differences, run attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import paths
from ..session import written

# Capacities of the log, of runs, of roll-ups and of samples.
LOG_CAPACITY = 2000
RUN_CAPACITY = 128
MAX_PATHS = 30
MAX_GROUPS = 20
SAMPLES = 64
# Largest rank that Spark turns into a group limit by default.


def changes_since(log: DataFrame, since: int = 0, source: str | None = None, limit: int = 200) -> DataFrame:
    """Newest first, generation strictly above the cursor: one top-k."""
    rows = log.filter(F.col("generation") > since)
    if source is not None:
        rows = rows.filter(F.col("source") == source)
    return rows.orderBy(F.desc("generation"), "path").limit(min(limit, LOG_CAPACITY))


def retain(log: DataFrame, capacity: int = LOG_CAPACITY) -> DataFrame:
    """The newest ``capacity`` records of the whole log."""
    return log.orderBy(F.desc("generation"), F.desc("path")).limit(capacity)


def retain_per_key(rows: DataFrame, key: str, order: list[Column], capacity: int, salts: int = 64) -> DataFrame:
    """The first ``capacity`` rows per key.

    A key is first cut into ``salts`` slices, each of which keeps its own first n
    rows, so no task sorts all rows of a key that holds most of the data.  Where
    Spark plans ``row_number() <= n`` as a group limit, a task also sends at most n
    rows per slice.
    """
    sliced = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    return _first(_first(sliced, [key, "_salt"], order, capacity).drop("_salt"), [key], order, capacity)


def _first(rows: DataFrame, keys: list[str], order: list[Column], capacity: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= capacity).drop("_rank")


def retain_tail(rows: DataFrame, key: str, order: str, value: str, limit: int) -> DataFrame:
    """Per key, the last ``limit`` characters of its texts in order, and how many
    were dropped.

    A text that is not empty has at least one character, so the last ``limit``
    texts of a key always suffice: a group limit keeps them, and only those are
    ordered and joined.  Lengths are summed with partial aggregation.
    """
    filled = rows.filter(F.length(value) > 0)
    totals = rows.groupBy(key).agg(F.coalesce(F.sum(F.length(value)), F.lit(0)).alias("_total"))
    kept = retain_per_key(filled.select(key, order, value), key, [F.desc(order)], limit)
    after = W.partitionBy(key).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)
    kept = kept.withColumn("_after", F.coalesce(F.sum(F.length(value)).over(after), F.lit(0))).filter(F.col("_after") < limit)
    tails = kept.groupBy(key).agg(
        F.right(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value)))), lambda s: s[value]), ""),
            F.lit(limit),
        ).alias("tail")
    )
    joined = totals.join(tails, key, "left").withColumn("tail", F.coalesce("tail", F.lit("")))
    return joined.select(key, "tail", (F.col("_total") - F.length("tail")).alias("dropped_chars"))


def retain_runs(runs: DataFrame, capacity: int = RUN_CAPACITY) -> DataFrame:
    """Drop the oldest finished runs beyond capacity; active runs always stay.

    ``runs`` has run_id and ended_at, null while active.  The finished runs kept
    are the newest (capacity - active), found without one global sort: at most
    ``capacity`` of them can stay, so a top-k precedes the ranking.
    """
    active = runs.filter(F.col("ended_at").isNull())
    newest = runs.filter(F.col("ended_at").isNotNull()).orderBy(F.desc("ended_at"), F.desc("run_id")).limit(capacity)
    count = active.agg(F.count("*").alias("_active"))
    ranked = newest.withColumn("_rank", F.row_number().over(W.orderBy(F.desc("ended_at"), F.desc("run_id"))))
    kept = ranked.join(F.broadcast(count)).filter(F.col("_rank") <= capacity - F.col("_active"))
    return active.unionByName(kept.drop("_rank", "_active"))


def changed_groups(changed: DataFrame, max_groups: int = MAX_GROUPS) -> DataFrame:
    """Distinct changed paths per group, largest first, the rest as (other).

    Only the top groups are ranked; the remainder is total minus those, so no
    window runs over all groups.  Twenty rows and one total row meet at the end.
    """
    groups = (
        changed.filter(~paths.is_excluded_dir("path")).select("path").distinct()
        .groupBy(paths.change_group("path").alias("group")).agg(F.count("*").alias("paths"))
    )
    totals = groups.agg(F.sum("paths").alias("_all"), F.count("*").alias("_groups"))
    top = groups.orderBy(F.desc("paths"), "group").limit(max_groups)
    order = W.orderBy(F.desc("paths"), F.col("group"))
    ranked = top.withColumn("rank", F.row_number().over(order)).join(F.broadcast(totals))
    before = F.sum("paths").over(order.rowsBetween(W.unboundedPreceding, -1))
    folded = (F.col("rank") == max_groups) & (F.col("_groups") > max_groups)
    return ranked.withColumn("_before", before).select(
        "rank", F.when(folded, "(other)").otherwise(F.col("group")).alias("group"),
        F.when(folded, F.col("_all") - F.col("_before")).otherwise(F.col("paths")).alias("paths"),
    )


def changed_paths(changed: DataFrame, limit: int = MAX_PATHS) -> DataFrame:
    """First distinct changed paths in path order."""
    return changed.filter(~paths.is_excluded_dir("path")).select("path").distinct().orderBy("path").limit(limit)


def changed_summary(changed: DataFrame, limit: int = MAX_PATHS) -> DataFrame:
    total = changed.filter(~paths.is_excluded_dir("path")).agg(F.count_distinct("path").alias("count"))
    return total.select("count", (F.col("count") > limit).alias("truncated"))


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paths in exactly one of two sets, by one grouped pass over both.

    Grouping merges copies of a path per task before the exchange, which an
    outer join of two long lists would not.
    """
    both = left.select("path", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select("path", F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    sides = both.groupBy("path").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.filter(F.col("l") != F.col("r")).select("path", F.when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def partition_by_owner(dirty: DataFrame, log: DataFrame, own_source: str) -> DataFrame:
    """Dirty paths touched by the engine's own edits and by others."""
    touched = log.groupBy("path").agg(
        F.bool_or(F.col("source") == own_source).alias("own"), F.bool_or(F.col("source") != own_source).alias("external")
    )
    return dirty.select("path").distinct().join(touched, "path").select("path", "own", "external")


def attribute_runs(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Distinct paths changed by each run: start < generation <= end, not later
    than the run's end time.

    An interval join by ranges of the data.  The log is dealt into ranges of
    (generation, path), so a generation that wrote most of it fills many ranges.  A run is
    repeated for the ranges that it touches, however many generations it spans.  Where
    it covers a range whole, it meets the counts per path of that range; only in the
    ranges of its ends it meets the rows.
    """
    dealt = log.select("path", "generation", "timestamp").repartitionByRange("generation", "path")
    rows = written(dealt.withColumn("_range", F.spark_partition_id()), "log-ranges")
    # One row for each partition of the log.
    ranges = rows.groupBy("_range").agg(F.min("generation").alias("low"), F.max("generation").alias("high"), F.max("timestamp").alias("latest"))
    pieces = runs.filter("end_generation > start_generation").join(F.broadcast(ranges), (F.col("high") > F.col("start_generation")) & (F.col("low") <= F.col("end_generation")))
    covers = (
        (F.col("low") > F.col("start_generation")) & (F.col("high") <= F.col("end_generation"))
        & (F.col("ended_at").isNull() | (F.col("latest") <= F.col("ended_at")))
    )
    pieces = pieces.withColumn("_covers", F.coalesce(covers, F.lit(False)))
    counts = rows.groupBy("_range", "path").agg(F.count("*").alias("changes"))
    whole = pieces.filter("_covers").join(counts, "_range").select("run_id", "path", "changes")
    ends = pieces.filter("NOT _covers").join(rows, "_range").filter(
        (F.col("generation") > F.col("start_generation"))
        & (F.col("generation") <= F.col("end_generation"))
        & (F.col("ended_at").isNull() | (F.col("timestamp") <= F.col("ended_at")))
    )
    found = whole.unionByName(ends.groupBy("run_id", "path").agg(F.count("*").alias("changes")))
    return found.groupBy("run_id", "path").agg(F.sum("changes").alias("changes"))


def frozen_runs(polls: DataFrame, terminal: list[str]) -> DataFrame:
    """(run_id, start_generation, end_generation, ended_at) of each run as its first
    terminal poll left it; later polls change nothing.

    ``polls`` (run_id, generation, timestamp, state) come in any order and any number per
    run; they are reduced before the shuffle.  A run without a terminal poll is open: it
    ends at its last poll's generation and has no end time.
    """
    ended = F.when(F.col("state").isin(terminal), F.struct("generation", "timestamp"))
    runs = polls.groupBy("run_id").agg((F.min("generation") - 1).alias("start_generation"), F.min(ended).alias("_stop"), F.max("generation").alias("_last"))
    return runs.select("run_id", "start_generation", F.coalesce("_stop.generation", "_last").alias("end_generation"), F.col("_stop.timestamp").alias("ended_at"))


def lower_median(rows: DataFrame, key: str, value: str, order: list[Column], samples: int = SAMPLES) -> DataFrame:
    """Lower median over the newest samples of each key."""
    kept = retain_per_key(rows, key, order, samples)
    return kept.groupBy(key).agg(
        F.count("*").alias("samples"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("p50")
    )


def rounded_p95(rows: DataFrame, key: str, value: str, order: list[Column], samples: int = SAMPLES) -> DataFrame:
    """The value at index round((n - 1) * 0.95) of the newest samples of each key."""
    kept = retain_per_key(rows, key, order, samples)
    ordered = kept.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("v"))
    index = F.floor((F.size("v") - 1) * F.lit(0.95) + 0.5).cast("int")
    return ordered.select(key, F.size("v").alias("samples"), F.get("v", index).alias("p95"))
