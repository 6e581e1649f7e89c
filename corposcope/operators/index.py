"""Index tables: file rows, term postings, metrics, snapshot id, refresh."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import handles, paths, terms, text
from ..functions.rows import unnest
from ..sources.corpus import MOST_BYTES, admit, describe, refused
from .references import identifiers
from .symbols import symbol_rows, with_symbols

SNAPSHOT_TAG = "corposcope-index"


def with_terms(files: DataFrame) -> DataFrame:
    """Add ``indexed_terms`` (needs ``symbols``)."""
    names = F.transform("symbols", lambda s: s["name"])
    return files.withColumn("indexed_terms", terms.indexed_terms(F.col("content"), F.col("path"), names))


def postings(files: DataFrame) -> DataFrame:
    """term, path.  Terms are distinct per file already, so nothing is shuffled."""
    return unnest(with_terms(files), "indexed_terms", "term", "path")


def candidate_files(corpus: DataFrame, posting_rows: DataFrame, wanted: list[str]) -> DataFrame:
    """Files holding any wanted term; no terms means all, a miss means none."""
    if not wanted:
        return corpus
    hits = posting_rows.filter(F.col("term").isin(wanted)).select("path").distinct()
    return corpus.join(hits, "path", "left_semi")


def find_file(corpus: DataFrame, name: str, *, scope=None, case_sensitive: bool = False, max_results: int = 20) -> DataFrame:
    """Paths matching a substring, or a glob when the name has * or ?."""
    from .search import clamp_limit

    hit = filename_test(name, case_sensitive)
    return (
        corpus.filter(paths.in_scope("path", scope)).filter(hit).select(
            "path",
            F.lit("glob" if _is_glob(name) else "substring").alias("match_type"),
            F.lit(1.0).alias("score"), F.lit("filename_match").alias("reason"),
        )
        .orderBy("path").limit(clamp_limit(max_results))
    )


def _is_glob(name: str) -> bool:
    return "*" in name or "?" in name


def filename_test(name: str, case_sensitive: bool):
    """``*`` crosses directories, ``?`` is one character, the rest is literal."""
    if not _is_glob(name):
        return text.contains_literal("path", name, case_sensitive)
    body = "".join({"*": ".*", "?": "."}.get(ch) or text.java_quote(ch) for ch in name)
    return F.rlike("path", F.lit(("(?d)" if case_sensitive else "(?diu)") + f"^{body}\\z"))


def find_file_stats(corpus: DataFrame, name: str, *, scope=None, case_sensitive: bool = False, max_results: int = 20) -> DataFrame:
    from .search import clamp_limit

    limit = clamp_limit(max_results)
    hit = corpus.filter(paths.in_scope("path", scope)).filter(filename_test(name, case_sensitive))
    n = hit.agg(F.count("*").alias("total"))
    return n.select(
        "total", F.least("total", F.lit(limit)).alias("result_count"),
        (F.col("total") > limit).alias("truncated"),
    )


def repo_map(corpus: DataFrame, *, scope=None, max_results: int = 20) -> DataFrame:
    """Directories (200 at most) with file counts and their languages, first by path.

    At most 17 languages exist, so the collected set stays small however many
    files one directory holds.
    """
    from .search import clamp_limit

    grouped = (
        corpus.filter(paths.in_scope("path", scope))
        .groupBy(paths.dirname("path").alias("directory"))
        .agg(F.count("*").alias("files"), F.collect_set(paths.language("path")).alias("languages"))
    )
    return (
        grouped.orderBy("directory").limit(clamp_limit(max_results))
        .select("directory", "files", F.array_join(F.sort_array("languages"), ",").alias("languages"))
    )


def scope_counts(corpus: DataFrame, scope=None) -> DataFrame:
    return corpus.agg(
        F.count_if(paths.in_scope("path", scope)).alias("file_count"), F.count("*").alias("total_file_count"),
    ).withColumn("scope_applied", F.lit(paths.scope_size(scope) > 0))


def languages(corpus: DataFrame) -> DataFrame:
    lang = paths.language("path").alias("language")
    return corpus.select(lang).filter(F.col("language") != "text").distinct()


def metrics(files: DataFrame) -> DataFrame:
    """Index counters in one scan.

    Each file yields one counter row and one row per distinct term and symbol
    name; the partial aggregate folds them per task before the one exchange, and
    distinct counts are the number of groups left.
    """
    rows = with_terms(files).select(
        F.expr(
            "concat("
            "array(named_struct('kind', 'file', 'token', '', 'loc', line_count, 'source_loc', "
            "if(document_type = 'source', line_count, 0), 'bytes', octet_length(content))), "
            "transform(indexed_terms, t -> named_struct('kind', 'term', 'token', t, 'loc', 0, 'source_loc', 0, 'bytes', 0)), "
            "transform(symbols, s -> named_struct('kind', 'symbol', 'token', s.name, 'loc', 0, 'source_loc', 0, 'bytes', 0)))"
        ).alias("rows")
    )
    grouped = (
        unnest(rows, "rows", "r").groupBy("r.kind", "r.token")
        .agg(
            F.count("*").alias("n"), F.sum("r.loc").alias("loc"),
            F.sum("r.source_loc").alias("source_loc"), F.sum("r.bytes").alias("bytes"),
        )
    )
    kind = F.col("kind")
    return grouped.agg(
        F.sum(F.when(kind == "file", F.col("n"))).alias("indexed_file_count"),
        F.sum("loc").alias("indexed_loc"),
        F.sum("source_loc").alias("indexed_source_loc"),
        F.sum("bytes").alias("indexed_content_bytes"),
        F.count_if(kind == "term").alias("token_count"),
        F.sum(F.when(kind == "term", F.col("n"))).alias("token_posting_count"),
        F.count_if(kind == "symbol").alias("symbol_name_count"),
        F.sum(F.when(kind == "symbol", F.col("n"))).alias("symbol_declaration_count"),
    )


def snapshot_lanes(corpus: DataFrame) -> DataFrame:
    """File count and the XOR of all row digests, as eight 32-bit lanes.

    XOR is its own inverse and order-free, so the lanes of a changed snapshot
    are those of the old one XOR the lanes of removed and added rows.
    """
    digest = F.col("hash") if "hash" in corpus.columns else handles.content_hash("content")
    rows = corpus.select(*handles.snapshot_lanes(F.col("path"), digest))
    return rows.agg(
        F.count("*").alias("file_count"),
        *[F.coalesce(F.bit_xor(f"lane{i}"), F.lit(0)).alias(f"lane{i}") for i in range(8)],
    )


def snapshot_id(corpus: DataFrame, head: str = "", tag: str = SNAPSHOT_TAG) -> DataFrame:
    return snapshot_of(snapshot_lanes(corpus), head, tag)


def snapshot_of(lanes: DataFrame, head: str = "", tag: str = SNAPSHOT_TAG) -> DataFrame:
    """(file_count, snapshot_id) from stored lanes: one row, no file is read."""
    token = handles.snapshot_token(tag, F.lit(head), F.col("file_count"), [F.col(f"lane{i}") for i in range(8)])
    return lanes.select("file_count", token.alias("snapshot_id"))


def refreshed_lanes(lanes: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """The lanes of what ``refresh`` makes of ``files``: those before, XOR the rows that go,
    XOR the rows that come.

    Of ``files`` (path, hash) the two narrow columns are read, no text; ``changed`` is as in
    ``refresh``.  Of several rows for one path the corpus would have several too.
    """
    digest = F.col("hash") if "hash" in files.columns else handles.content_hash("content")
    present = changed.filter(F.col("content").isNotNull())
    touched = removed_paths(files.select("path"), changed).union(present.select("path")).distinct()
    gone = files.select("path", digest.alias("hash")).join(touched, "path", "left_semi")
    come = present.select("path", handles.content_hash("content").alias("hash"))
    parts = lanes.withColumn("_sign", F.lit(1)).unionByName(snapshot_lanes(gone).withColumn("_sign", F.lit(-1))).unionByName(snapshot_lanes(come).withColumn("_sign", F.lit(1)))
    return parts.agg(F.sum(F.col("_sign") * F.col("file_count")).alias("file_count"), *[F.bit_xor(f"lane{i}").alias(f"lane{i}") for i in range(8)])


def refresh(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows after a set of path events.

    ``changed`` has one row per path with ``content``, null when the path is
    gone.  A vanished path removes itself and everything below it.  ``status``
    tells kept, changed and added.

    Unchanged files pass through one anti join on their path.  When the changed
    set is small Spark broadcasts it, and the text of the corpus is not shuffled;
    old and new versions are compared by hash, never side by side.
    """
    present = changed.filter(F.col("content").isNotNull())
    replaced = removed_paths(files, changed).union(present.select("path"))
    kept = files.select("path", "content").join(replaced, "path", "left_anti")
    survivors = files.select("path", handles.content_hash("content").alias("old")).join(
        removed_paths(files, changed), "path", "left_anti"
    )
    fresh = present.select("path", "content", handles.content_hash("content").alias("new")).join(survivors, "path", "left")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new") == F.col("old"), "kept").otherwise("changed")
    return kept.select("path", "content", F.lit("kept").alias("status")).unionByName(
        fresh.select("path", "content", status.alias("status"))
    )


def removed_paths(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files at or below a vanished path: each file is matched by equality against
    its own ancestors, so the prefix test is a semi join, not a range join."""
    gone = changed.filter(F.col("content").isNull()).select(F.col("path").alias("dir"))
    return (
        unnest(files, paths.ancestors("path"), "dir", "path")
        .join(gone, "dir", "left_semi").select("path").distinct()
    )


# The narrow tables and the keys they are sorted by.
NARROW = {"postings": ["term", "path"], "symbols": ["name", "path"], "identifiers": ["token", "path"]}


def build(
    corpus: DataFrame, target: str, *, extractor: str = "prose", max_bytes: int = MOST_BYTES, tables: Iterable[str] = NARROW
) -> dict[str, str]:
    """Write ``files`` and the narrow ``tables`` as parquet, and ``refused``: the paths that
    were not admitted, each with the reason, and ``snapshot``: the lanes of the snapshot's id.

    ``files`` is range-partitioned on the path.  A narrow table has one sorted part for each
    part of ``files``, so its rows are computed once and never exchanged; a hot key fills
    as many files as hold it, and a lookup reads the pages of its key in each part.
    """
    # The range partitioner samples its child, so the rows are dealt before anything is computed on them.
    admitted = admit(corpus, max_bytes).repartitionByRange("path").sortWithinPartitions("path")
    files = with_terms(with_symbols(describe(admitted), extractor)).drop("lines")
    out = {name: f"{target}/{name}" for name in ("files", "refused", "snapshot")}
    files.write.mode("overwrite").parquet(out["files"])
    refused(corpus, max_bytes).write.mode("overwrite").parquet(out["refused"])
    # Later tables read the stored rows: the text is parsed once.
    snapshot_lanes(corpus.sparkSession.read.parquet(out["files"])).write.mode("overwrite").parquet(out["snapshot"])
    return extend(corpus.sparkSession, out, target, tables)


def extend(spark: SparkSession, out: dict[str, str], target: str, tables: Iterable[str]) -> dict[str, str]:
    """``out`` of a build with those of the narrow ``tables`` that it lacks."""
    stored = spark.read.parquet(out["files"])
    rows = {"postings": lambda: unnest(stored, "indexed_terms", "term", "path"), "symbols": lambda: symbol_rows(stored), "identifiers": lambda: identifiers(stored)}
    for name in tables:
        if name not in out:
            rows[name]().sortWithinPartitions(*NARROW[name]).write.mode("overwrite").parquet(f"{target}/{name}")
            out = {**out, name: f"{target}/{name}"}
    return out


def reuse(spark: SparkSession, previous: str, corpus: DataFrame, *, extractor: str = "prose") -> DataFrame:
    """File rows for ``corpus``, taking parsed columns from an earlier build where
    path and content hash agree; only the misses are parsed."""
    current = describe(corpus)
    cached = spark.read.parquet(previous).select("path", "hash", "symbols", "indexed_terms")
    hits = current.join(cached, ["path", "hash"], "inner")
    misses = with_terms(with_symbols(current.join(cached, ["path", "hash"], "left_anti"), extractor)).drop("lines")
    return hits.unionByName(misses.select(*hits.columns))
