"""Helpers the operators share: table reading, the shared folder, row checks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# Bytes of an Arrow batch that are turned into Python objects at a time.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors see.

    Only a local session, as in tests, gets a folder of this machine where the setting
    is absent, one for the session; on a cluster its absence is an error.
    """
    folder = checkpoint_dir(spark)
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/corposcope-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; a null key counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def by_batch(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Rows of ``df`` through ``work``, one Arrow batch at a time, in place (no shuffle).

    ``work`` returns the columns by name.  It gets about ``SLICE_BYTES`` at a time (one
    row at least), so what it holds does not grow with the rows of a batch.
    """
    names = [f.name for f in _struct(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                columns = work(batch.slice(at, step))
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return df.mapInArrow(run, schema)


def _struct(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The text column, null as ''."""
    return [t or "" for t in batch.column(name).to_pylist()]
