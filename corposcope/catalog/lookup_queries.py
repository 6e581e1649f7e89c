"""Named queries over a stored index: the rows of the scans, from the paths that can hold them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index, references
from ..operators.lookup import Stored
from ..plans.workspace import Workspace
from ..session import checkpoint_dir
from ..sources import corpus
from . import search_queries  # noqa: F401  its SQL is shared
from .base import CORPUS, REGISTRY, query, with_ctes
from .symbol_queries import _first_target

_built: dict[tuple[str, str], tuple[str, dict[str, str]]] = {}


def _tables(spark: SparkSession, sf: str, *narrow: str) -> dict[str, str]:
    """The index of the documents in the shared folder: once per session the stored files, and
    each narrow table when a request first asks it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _built:
        folder = f"{checkpoint_dir(spark).rstrip('/')}/corposcope-index-{uuid.uuid4().hex}"
        _built[key] = folder, index.build(corpus.documents(spark, sf).select("path", "content"), folder, tables=())
    folder, out = _built[key]
    _built[key] = folder, index.extend(spark, out, folder, narrow)
    return _built[key][1]


def _answer(spark: SparkSession, sf: str, narrow: str, **request) -> DataFrame:
    return Workspace.open(spark, _tables(spark, sf, narrow), max_results=200).retrieve([request], fail_fast=True).results["op_1"]


@query("indexed_search", REGISTRY["search_literal_ci"].sql)
def indexed_search(spark, sf):
    return _answer(spark, sf, "postings", operation="search_text", pattern="le")


@query("indexed_search_scoped", REGISTRY["search_literal_scoped"].sql)
def indexed_search_scoped(spark, sf):
    return _answer(spark, sf, "postings", operation="search_text", pattern="que", paths=["./src"], context_lines=0, max_results=200)


@query("indexed_symbols", REGISTRY["find_symbol_ranked"].sql)
def indexed_symbols(spark, sf):
    return _answer(spark, sf, "symbols", operation="find_symbol", symbol="ER", max_results=60)


@query("indexed_references", REGISTRY["references_lexical"].sql)
def indexed_references(spark, sf):
    stored = Stored.open(spark, _tables(spark, sf, "symbols", "identifiers"))
    target = _first_target(stored.first_declaring("Le"), "Le")
    found = references.find_references(stored.with_token("Le"), target, context=1, max_results=50, push=True)
    return found.withColumn("enclosing_symbol", F.coalesce("enclosing_symbol", F.lit("")))


@query("refused_files", with_ctes(CORPUS) + """SELECT path, 'too_large' AS reason, strlen(content) AS size FROM corpus WHERE strlen(content) > 4000""")
def refused_files(spark, sf):
    return corpus.refused(corpus.documents(spark, sf), max_bytes=4000)
