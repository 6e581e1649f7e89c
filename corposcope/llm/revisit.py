"""Not-modified revisits resolved to the response they confirm.

A web archive stores a 304 answer as a revisit record without a body.  Each is
resolved by an as-of join: by canonical URL, to the latest strictly earlier full
response; then the validators are compared and the headers that a 304 may update
are merged into those of the response.

The as-of join splits any URL, however many captures it has: records are range
partitioned by (url, time), and written with the number of their range.  Within a
range the last response is carried forward; only a URL that runs over the end of a
range needs one from earlier ranges, and there are at most as many such URLs as
ranges.  Bodies are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# Query parameters that do not name a resource.
DROPPED_PARAMETERS = "^(utm_[a-z]+|sid|sessionid|phpsessid|jsessionid)(=.*)?$"
# Headers of a 304 that do not update the stored response: those of the
# connection, and those that describe the body that a 304 does not have.
NOT_MERGED = (
    "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer",
    "transfer-encoding", "upgrade", "content-encoding", "content-length", "content-range", "content-type",
)


def canonical(url: Column) -> Column:
    """Host, path and sorted query in lower case, without scheme, ``www``, default
    port, fragment, trailing slashes and parameters that do not name a resource."""
    rest = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "#.*$", ""), "^https?://(www[0-9]*\\.)?", "")
    host = F.regexp_replace(F.regexp_extract(rest, "^([^/?]*)", 1), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    named = F.filter(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(DROPPED_PARAMETERS))
    query = F.array_join(F.array_sort(named), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that differ by case only the first in code order counts."""
    pairs = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    first = F.aggregate(
        F.coalesce(pairs, F.array()),
        F.array().cast("array<struct<key:string,value:string>>"),
        lambda done, e: F.when(F.exists(done, lambda d: d["key"] == e["key"]), done).otherwise(F.concat(done, F.array(e))),
    )
    return F.map_from_entries(first)


def _opaque(etag: Column) -> Column:
    """The tag without the mark of a weak one: a 304 is matched by weak comparison."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def as_of(events: DataFrame, key: str, order: list[str], full: Column, payload: list[str]) -> DataFrame:
    """``events`` with ``prior``: the ``payload`` of the last ``full`` row before each row,
    among the rows with its ``key`` in the order of ``order`` (which must not be null)."""
    marked = events.withColumn("__full", full).repartitionByRange(F.col(key), *order).withColumn("__range", F.spark_partition_id())
    marked = written(marked, "ranges")
    kept = F.when(F.col("__full"), F.struct(*payload))
    before = Window.partitionBy("__range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = marked.withColumn("__inside", F.last(kept, ignorenulls=True).over(before))

    # Keys that lie in more than one range: each is the last of some range, so there
    # are fewer of them than ranges, and both tables below have at most two rows a range.
    ends = marked.groupBy("__range").agg(F.array(F.min(key), F.max(key)).alias("k")).select("__range", F.explode("k").alias(key)).distinct()
    split = ends.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    tails = marked.join(F.broadcast(split), key).groupBy("__range", key).agg(F.max_by(kept, F.when(F.col("__full"), F.struct(*order))).alias("__tail"))
    earlier = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select("__range", key, F.last("__tail", ignorenulls=True).over(earlier).alias("__carried"))
    out = inside.join(F.broadcast(carried), ["__range", key], "left")
    return out.withColumn("prior", F.coalesce("__inside", "__carried")).drop("__inside", "__carried", "__full", "__range")


def resolve(
    records: DataFrame, record_id: str = "record_id", url: str = "url", ts: str = "ts", kind: str = "kind", status: str = "status", headers: str = "headers",
) -> DataFrame:
    """One row per revisit: (record_id, url_key, ts, outcome, response_id, merged).

    ``kind`` is 'response' or 'revisit'; a full response is one with status 200.
    ``outcome`` is

    * ``no_response`` - no earlier full response of the URL, or no URL or time;
    * ``mismatch`` - a validator of both differs (ETag first, by weak comparison; if
      not both have one, Last-Modified);
    * ``not_comparable`` - the revisit names validators, none of which the response has;
    * ``resolved`` - a validator agrees, or the revisit names none.

    ``merged`` are the response's headers, updated by those of the revisit that a 304
    may change; set, like ``response_id``, only if resolved.  Null headers count as
    none.  Of responses at one time the one with the larger id counts; one at the time
    of the revisit is not earlier.  Repeated revisits give repeated rows.  Records of
    another kind or without an id are left out; other columns are not read.
    """
    own = records.select(
        F.col(record_id).alias("record_id"), F.col(url).alias("__url"), F.col(ts).alias("ts"), F.col(kind).alias("kind"), F.col(status).alias("status"),
        _lower_names(F.col(headers)).alias("headers"),
    ).where("record_id is not null and kind in ('response', 'revisit')").withColumn("url_key", canonical(F.col("__url"))).drop("__url")
    usable = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    full = (F.col("kind") == "response") & F.coalesce(F.col("status") == 200, F.lit(False))
    events = own.where(usable & (full | (F.col("kind") == "revisit"))).withColumn("late", full.cast("int"))
    # At one time revisits come first, so that a response then is not before them.
    joined = as_of(events, "url_key", ["ts", "late", "record_id"], F.col("late") == 1, ["record_id", "headers"]).where("kind = 'revisit'").drop("late")
    lost = own.where(~usable & (F.col("kind") == "revisit")).withColumn("prior", F.lit(None).cast(joined.schema["prior"].dataType))
    found = joined.unionByName(lost)

    tag, modified = F.col("headers")["etag"], F.trim(F.col("headers")["last-modified"])
    prior_tag, prior_modified = F.col("prior.headers")["etag"], F.trim(F.col("prior.headers")["last-modified"])
    outcome = (
        F.when(F.col("prior").isNull(), "no_response")
        .when(tag.isNotNull() & prior_tag.isNotNull(), F.when(_opaque(tag) == _opaque(prior_tag), "resolved").otherwise("mismatch"))
        .when(modified.isNotNull() & prior_modified.isNotNull(), F.when(modified == prior_modified, "resolved").otherwise("mismatch"))
        .when(tag.isNull() & modified.isNull(), "resolved")
        .otherwise("not_comparable")
    )
    named = F.transform(F.split(F.lower(F.coalesce(F.col("headers")["connection"], F.lit(""))), ","), lambda x: F.trim(x))
    update = F.map_filter("headers", lambda k, _: ~k.isin(*NOT_MERGED) & ~F.array_contains(named, k))
    stored = F.map_filter("prior.headers", lambda k, _: ~F.map_contains_key("__update", k))
    found = found.withColumn("outcome", outcome).withColumn("__update", update)
    is_resolved = F.col("outcome") == "resolved"
    return found.select(
        "record_id", "url_key", "ts", "outcome",
        F.when(is_resolved, F.col("prior.record_id")).alias("response_id"), F.when(is_resolved, F.map_concat(stored, "__update")).alias("merged"),
    )


def header_lines(headers: Column) -> Column:
    """A header map as sorted ``name: value`` lines."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(F.array_sort(lines), "\n")
