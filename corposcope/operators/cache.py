"""Versioned index cache: a scan reuses what an earlier build parsed."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import repository
from ..sources.corpus import describe
from . import index
from .symbols import with_symbols

CACHE_SCHEMA = "corposcope-cache-1"


def _settings(root: str, max_bytes: int, artifacts, exclude, extractor: str) -> str:
    return json.dumps(
        {
            "schema": CACHE_SCHEMA, "root": root, "max_bytes": max_bytes, "artifacts": list(artifacts or []),
            "exclude": list(exclude or []), "extractor": extractor,
        }
    )


def _latest(spark: SparkSession, target: str) -> dict | None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{target}/builds")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    row = spark.read.parquet(f"{target}/builds").orderBy(F.desc("seq")).first()
    return row.asDict() if row else None


def scan_cached(
    spark: SparkSession, root: str, target: str, *, max_bytes: int = repository.DEFAULT_MAX_BYTES,
    artifacts: list[str] | None = None, exclude: list[str] | None = None, extractor: str = "code",
) -> tuple[DataFrame, bool]:
    """(file rows, cache hit).  The cache holds only for equal settings, and a row
    is reused only for an equal path and content hash; times are never trusted.

    Rows go to a new folder; the one-row build record is written last, so a lost
    job leaves the previous build in force.
    """
    settings = _settings(root, max_bytes, artifacts, exclude, extractor)
    last = _latest(spark, target)
    hit = last is not None and last["settings"] == settings
    corpus = repository.scan(spark, root, max_bytes=max_bytes, exclude=exclude, artifacts=artifacts)
    if hit:
        rows = index.reuse(spark, last["location"], corpus.drop("size"), extractor=extractor)
    else:
        rows = index.with_terms(with_symbols(describe(corpus), extractor)).drop("lines")
    location = f"{target}/files-{uuid.uuid4().hex}"
    rows.repartitionByRange("path").sortWithinPartitions("path").write.parquet(location)
    seq = last["seq"] + 1 if last else 0
    record = spark.createDataFrame([(seq, settings, location)], "seq BIGINT, settings STRING, location STRING")
    record.coalesce(1).write.mode("append").parquet(f"{target}/builds")
    return spark.read.parquet(location), hit
