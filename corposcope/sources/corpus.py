"""Adapters that present a table as a corpus of (path, content) files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import handles, paths, text
from ..session import read_table

# Directories and extensions of the virtual paths given to documents.
DOCUMENT_DIRS = ["src", "tests", "fixtures", "docs", "runtime", "logs"]
DOCUMENT_EXTENSIONS = [".py", ".rs", ".md", ".json", ".log", ".txt", ".ts", ".go"]


def _pick(values: list[str], key: Column) -> Column:
    index = F.pmod(key, F.lit(len(values))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), index)


def document_path(doc_id: Column, source: Column, lang: Column) -> Column:
    """dir/source/lang/doc_<id>.<ext> with dir and ext chosen by the id."""
    return F.concat(
        _pick(DOCUMENT_DIRS, doc_id), F.lit("/"), source, F.lit("/"), lang,
        F.lit("/doc_"), doc_id.cast("string"), _pick(DOCUMENT_EXTENSIONS, doc_id),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files; doc_id is kept for derived inputs."""
    df = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    return df.select(
        "doc_id",
        document_path(F.col("doc_id"), F.col("source"), F.col("lang")).alias("path"),
        F.col("text").alias("content"),
    )


def document_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the documents only; the text column is never read."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select("doc_id", document_path(F.col("doc_id"), F.col("source"), F.col("lang")).alias("path"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as files named by URL and page id."""
    df = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    return df.select(page_path(F.col("url"), F.col("page_id")).alias("path"), F.col("html").alias("content"))


def page_path(url: Column, page_id: Column) -> Column:
    host = F.regexp_replace(url, r"^[a-z]+://", "")
    return F.concat(host, F.lit("/page_"), page_id.cast("string"), F.lit(".html"))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a change log: one mutation row per event."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    path = F.concat(
        F.lit("user/"), F.col("user_id").cast("string"), F.lit("/v"),
        F.floor("value").cast("string"), F.lit(".log"),
    )
    return df.select(
        F.col("event_id").alias("generation"), path.alias("path"), F.col("event_type").alias("source"),
        F.col("ts").alias("timestamp"), "value", "user_id",
    )


def admissible(content: Column | str, max_bytes: int) -> Column:
    """Admission of raw bytes: size, no NUL in the first 8192 bytes, valid UTF-8."""
    return refusal(content, max_bytes).isNull()


# Fixed value: the size in bytes above which a file is refused.
MOST_BYTES = 2_000_000


def refusal(content: Column | str, max_bytes: int = MOST_BYTES) -> Column:
    """Why a text is not admitted (``too_large``, ``binary``, ``not_utf8``, ``no_content``), or null."""
    c = text.col(content)
    return (
        F.when(c.isNull(), "no_content").when(F.octet_length(c) > max_bytes, "too_large")
        .when(F.position(F.lit(b"\0"), F.substring(c.cast("binary"), 1, 8192)) != 0, "binary")
        .when(~F.is_valid_utf8(c.cast("string")), "not_utf8")
    )


def admit(corpus: DataFrame, max_bytes: int = MOST_BYTES) -> DataFrame:
    """The files of a corpus that searches and the stored index both see."""
    return corpus.filter(refusal("content", max_bytes).isNull() & ~paths.is_excluded("path"))


def refused(corpus: DataFrame, max_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, reason, size) of every file that ``admit`` leaves out."""
    why = F.when(paths.is_excluded("path"), "excluded").otherwise(refusal("content", max_bytes))
    rows = corpus.select("path", why.alias("reason"), F.octet_length("content").cast("bigint").alias("size"))
    return rows.filter(F.col("reason").isNotNull())


def describe(corpus: DataFrame) -> DataFrame:
    """Add the derived columns of a file row."""
    path, content = F.col("path"), F.col("content")
    return corpus.withColumns(
        {
            "hash": handles.content_hash(content),
            "language": paths.language(path),
            "document_type": paths.document_type(path),
            "line_count": text.line_count(content),
            "size": F.octet_length(content).cast("bigint"),
        }
    )
