"""Turning arrays into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array: Column | str, name: str, *keep, position: str | None = None) -> DataFrame:
    """One row per element, beside the ``keep`` columns.

    For a plain explode the optimizer infers ``size(array) > 0`` and pushes it to
    the scan, where a computed array is then built a second and third time.  The
    outer form with a test on its output builds the array once.
    """
    array = F.col(array) if isinstance(array, str) else array
    if position is None:
        generated = F.explode_outer(array).alias(name)
    else:
        generated = F.posexplode_outer(array).alias(position, name)
    return df.select(*keep, generated).filter(F.col(name).isNotNull())


# A request within both bounds is sent to every executor.
MOST_REQUESTED, MOST_REQUESTED_BYTES = 10_000, 32 << 20


def is_small(requested: DataFrame) -> bool:
    """Whether the rows and the text of a request are within the bounds."""
    texts = [F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0)) for f in requested.schema.fields if f.dataType.typeName() == "string"]
    rows, *sizes = requested.limit(MOST_REQUESTED + 1).select(F.count("*"), *texts).first() if texts else [requested.limit(MOST_REQUESTED + 1).count()]
    return rows <= MOST_REQUESTED and sum(sizes) <= MOST_REQUESTED_BYTES


# Up to so many values are a test that a scan can push down.
MOST_PATHS = 200


def at_paths(files: DataFrame, wanted: list, on: str = "path") -> DataFrame:
    """The files with one of up to ``MOST_PATHS`` paths; the test reaches the scan."""
    return files.filter(F.col(on).isin(wanted) if wanted else F.lit(False))


def winners(top: DataFrame, files: DataFrame, *columns: str | Column, push: bool = False) -> DataFrame:
    """The rows of a limited top-k (``MOST_PATHS`` at most) with columns of their files.

    With ``push`` (a stored corpus sorted by path) the top-k is computed first and its
    paths are pushed into the scan, so only their row groups are read.  Without it the
    rows are broadcast to a scan of the whole corpus, which a computed path cannot prune.
    """
    if push:
        rows = top.collect()
        files = at_paths(files, sorted({r["path"] for r in rows}))
        top = top.sparkSession.createDataFrame(rows, top.schema)
    return files.select("path", *columns).join(F.broadcast(top), "path")


def attach(requested: DataFrame, files: DataFrame, *columns: str | Column, on: str = "path") -> DataFrame:
    """Rows of ``requested`` with ``columns`` of the file of their path, as a left join gives them.

    A left join cannot broadcast its left side, so it would shuffle every text to
    serve a few paths.  A request of measured size is taken to the driver once instead
    (``MOST_REQUESTED`` rows and ``MOST_REQUESTED_BYTES`` at most) and broadcast to the files, and
    its rows without a file are added; few paths are also pushed into the scans.  A
    larger request is joined.
    """
    if not is_small(requested):
        return requested.join(files.select(on, *columns), on, "left")
    rows = requested.collect()
    keys = sorted({r[on] for r in rows if r[on] is not None})
    if len(keys) <= MOST_PATHS:
        files = at_paths(files, keys, on)
    requested = requested.sparkSession.createDataFrame(rows, requested.schema)
    served = files.select(on, *columns)
    own = [c for c in requested.columns if c != on]
    found = served.join(F.broadcast(requested), on)
    found = found.select(on, *own, *[c for c in served.columns if c != on])
    known = files.select(on).join(F.broadcast(requested.select(on).distinct()), on, "left_semi")
    # No more paths than the request has.
    missing = requested.join(F.broadcast(known), on, "left_anti")
    return found.unionByName(missing, allowMissingColumns=True)
