"""Requests over a stored index, in two phases.

``index.build`` writes ``files`` sorted by path and, beside it, narrow tables sorted by
their keys in each part: ``postings`` (term, path), ``symbols`` (name, path), ``identifiers``
(token, path).  Phase one asks a narrow table which paths can hold a result; the key's filter is
pushed into its sorted files.  Phase two runs the operator over the texts of those
paths alone: a test ``path IN (...)`` is pushed into the scan of ``files``, where Parquet
skips every row group and page that holds none of them.  More than ``MOST_PATHS`` paths
are no list for a filter; then each stored row is asked the same question in the scan, as
a join would send every text through an exchange.

Both phases keep a superset of the files with a result, so the rows of an operator
are those it gives over all files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import handles, paths, terms, text
from ..functions.rows import MOST_PATHS, at_paths
from .references import is_identifier
from .symbols import qualified_parts


@dataclass(frozen=True)
class Stored:
    """The tables of one index."""

    files: DataFrame
    # None where a table is not at hand; a request over the others does not need it.
    postings: DataFrame | None = None
    symbols: DataFrame | None = None
    identifiers: DataFrame | None = None
    # The lanes of the snapshot's id.
    snapshot: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, tables: dict[str, str]) -> Stored:
        """``tables`` as ``index.build`` returns them.  Lists of up to ``MOST_PATHS`` values
        are pushed down one by one; by default Spark pushes only the range of a list of
        more than ten."""
        key = "spark.sql.parquet.pushdown.inFilterThreshold"
        spark.conf.set(key, str(max(MOST_PATHS, int(spark.conf.get(key)))))
        return cls(**{name: spark.read.parquet(tables[name]) for name in ("files", "postings", "symbols", "identifiers", "snapshot") if name in tables})

    def at(self, *wanted: str) -> DataFrame:
        """Files of the paths of a point read."""
        return at_paths(self.files, list(wanted))

    def holding(self, hits: DataFrame, test: Column) -> DataFrame:
        """Files of the paths in ``hits``, which are those whose stored row passes ``test``."""
        rows = hits.select("path").limit(MOST_PATHS + 1).collect()
        found = {r["path"] for r in rows}
        if len(rows) <= MOST_PATHS or (len(found) <= MOST_PATHS and not self._more(hits, found)):
            return at_paths(self.files, sorted(found))
        return self.files.filter(test)

    @staticmethod
    def _more(hits: DataFrame, found: set[str]) -> bool:
        """Whether paths are left that the first rows, which may repeat a path, did not show."""
        return bool(found) and not hits.filter(~F.col("path").isin(sorted(found))).select("path").isEmpty()

    def with_terms(self, pattern: str, syntax: str = "literal", scope: list[str] | None = None) -> DataFrame:
        """Files that hold a term of a literal; a regex, or a literal without terms, sees all."""
        wanted = terms.query_terms(pattern) if syntax == "literal" else []
        if not wanted:
            return self.files
        inside = paths.in_scope("path", scope)
        held = F.arrays_overlap("indexed_terms", F.array(*map(F.lit, wanted)))
        return self.holding(self.postings.filter(F.col("term").isin(wanted) & inside), held & inside)

    def with_token(self, name: str, scope: list[str] | None = None) -> DataFrame:
        """Files in which a name stands as an identifier; a name that is none sees all."""
        if not is_identifier(name):
            return self.files
        inside = paths.in_scope("path", scope)
        run = f"(?<![{terms.IDENTIFIER_CLASS}]){text.java_quote(name)}(?![{terms.IDENTIFIER_CLASS}])"
        held = F.contains("content", F.lit(name)) & F.rlike("content", F.lit(run))
        return self.holding(self.identifiers.filter((F.col("token") == name) & inside), inside & held)

    def declaring(self, selector: str, path: str | None = None) -> DataFrame:
        """Files that declare what a selector names, in full or by its last part."""
        leaf = (qualified_parts(selector.strip()) or ("", selector.strip()))[1]
        names = sorted({selector.strip(), leaf})
        inside = F.lit(True) if path is None else F.col("path") == paths.normalize_path(path)
        held = F.exists("symbols", lambda s: s["name"].isin(names))
        return self.holding(self.symbols.filter(F.col("name").isin(names) & inside), inside & held)

    def first_declaring(self, name: str) -> DataFrame:
        """The first file in path order that declares ``name``."""
        first = self.symbols.filter(F.col("name") == name).agg(F.min("path").alias("path")).first()["path"]
        return self.at(*([] if first is None else [first]))

    def symbols_like(self, query: str, scope: list[str] | None, limit: int) -> DataFrame:
        """Files of the first ``limit`` symbols in the order of ``symbols.find_symbol``."""
        needle, name = text.ascii_lower_py(query), text.ascii_lower("name")
        rank = F.when(name == needle, 0).when(name.startswith(needle), 1).otherwise(2)
        inside = paths.in_scope("path", scope)
        hits = self.symbols.filter(inside).filter(F.contains(name, F.lit(needle)))
        first = hits.select("path", rank.alias("rank"), "start_line", "ordinal").orderBy("rank", "path", "start_line", "ordinal").limit(limit)
        return self.holding(first, inside & F.exists("symbols", lambda s: F.contains(text.ascii_lower(s["name"]), F.lit(needle))))

    def of_token(self, prefix: str, token: str, code: str) -> DataFrame:
        """Files of the path that a handle or a continuation names."""
        body = handles.decode_token(prefix, token, code)
        named = body.get("p" if prefix == "range:" else "path") if isinstance(body, dict) else None
        return self.at(named) if isinstance(named, str) else self.files.filter(F.lit(False))


def pushed_paths(df: DataFrame) -> list[str]:
    """The ``path IN`` tests that the scans of a plan push down, for tests and tuning."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "PushedFilters" in line and ("In(path" in line or "EqualTo(path" in line)]


