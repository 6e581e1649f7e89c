"""One corpus behind the request API.

A workspace turns requests into DataFrames.  It holds no data: ``files`` is any DataFrame
with path and content.  Over a stored index (``Workspace.open``) each request first asks
the narrow tables for the paths it concerns and then reads the texts of these alone
(``operators.lookup``); over any other corpus it scans all files.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import handles, paths, text
from ..functions.rows import MOST_PATHS
from ..operators import changelog, edit_requests, edits, hunks, index, reads, references, search, symbols
from ..operators.lookup import Stored
from ..sources.corpus import admit, describe
from . import diff_pages, requests

# Instruction files shown with a summary, and their inline limit.
INSTRUCTION_FILES = ["AGENTS.md", "CLAUDE.md"]
INSTRUCTION_CAP = 4096


@dataclass
class Reply:
    """Results and errors of a batch, by operation id, in request order."""

    results: dict[str, DataFrame] = field(default_factory=dict)
    # One row each: totals before any limit, whether results were cut, what was looked at.
    headers: dict[str, DataFrame] = field(default_factory=dict)
    errors: dict[str, EngineError] = field(default_factory=dict)
    warnings: dict[str, str] = field(default_factory=dict)

    @property
    def partial_success(self) -> bool:
        return bool(self.results) and bool(self.errors)


class Workspace:
    def __init__(self, spark: SparkSession, corpus: DataFrame, *, name: str = "main", extractor: str = "prose",
                 max_results: int = search.PROTOCOL_MAX_RESULTS, stored: Stored | None = None):
        self.spark, self.name, self.max_results, self.stored = spark, name, max_results, stored
        self.parsed = extractor == "code"
        # The same files as a stored index has.
        corpus = corpus if stored else admit(corpus)
        if "symbols" in corpus.columns:
            self.files = text.with_lines(corpus) if "lines" not in corpus.columns else corpus
        else:
            self.files = symbols.with_symbols(corpus, extractor)

    @classmethod
    def open(cls, spark: SparkSession, tables: dict[str, str], **options) -> Workspace:
        """A workspace over the tables that ``index.build`` wrote."""
        stored = Stored.open(spark, tables)
        return cls(spark, stored.files, stored=stored, **options)

    def _lines(self, files: DataFrame) -> DataFrame:
        return files if "lines" in files.columns else text.with_lines(files)

    def _at(self, *wanted: str) -> DataFrame:
        """Files of given paths."""
        if self.stored:
            return self._lines(self.stored.at(*wanted))
        return self.files.filter(F.col("path").isin(list(wanted)))

    def retrieve(self, operations: list[dict], *, fail_fast: bool = False, snapshot_id: str | None = None) -> Reply:
        """Up to twelve operations; one that fails does not stop the others."""
        if not operations:
            raise EngineError("INVALID_REQUEST", "operations cannot be empty")
        if len(operations) > requests.MAX_OPERATIONS:
            raise EngineError("TOO_MANY_RETRIEVAL_OPERATIONS", "at most twelve operations", requested=len(operations))
        if snapshot_id is not None:
            self.require_snapshot(snapshot_id)
        reply = Reply()
        for number, request in enumerate(operations, 1):
            key = requests.operation_id(request, number)
            try:
                if key in reply.results or key in reply.errors:
                    key, taken = f"op_{number}", key
                    raise EngineError("DUPLICATE_RETRIEVAL_OPERATION_ID", f"id {taken!r} is used twice", id=taken)
                request = requests.check_operation(request)
                answer = getattr(self, f"_{request['operation']}")(request)
                reply.results[key], header = answer if isinstance(answer, tuple) else (answer, None)
                if header is not None:
                    reply.headers[key] = header
                if request.get("max_results", 0) > self._limit(request):
                    reply.warnings[key] = "MAX_RESULTS_CLAMPED"
            except EngineError as error:
                reply.errors[key] = error
                if fail_fast:
                    break
        return reply

    def _limit(self, request: dict) -> int:
        return search.clamp_limit(request.get("max_results", search.DEFAULT_RESULTS), self.max_results)

    def _search_text(self, request: dict) -> tuple[DataFrame, DataFrame]:
        pattern, syntax, scope = request["pattern"], request.get("syntax", "literal"), requests.request_paths(request)
        files = self._lines(self.stored.with_terms(pattern, syntax, scope)) if self.stored else self.files
        options = {
            "syntax": syntax, "scope": scope, "max_results": self._limit(request),
            "context": request.get("context_lines", search.DEFAULT_CONTEXT), "case_sensitive": request.get("case_sensitive", False),
        }
        found = search.search_text(files, pattern, workspace=self.name, push=self.stored is not None, **options)
        return found, search.search_stats(files, pattern, **options)

    def _find_file(self, request: dict) -> tuple[DataFrame, DataFrame]:
        options = {"scope": requests.request_paths(request), "case_sensitive": request.get("case_sensitive", False), "max_results": self._limit(request)}
        return index.find_file(self.files, request["name"], **options), index.find_file_stats(self.files, request["name"], **options)

    def _find_symbol(self, request: dict) -> DataFrame:
        scope, limit = requests.request_paths(request), self._limit(request)
        files = self.stored.symbols_like(request["symbol"], scope, limit) if self.stored else self.files
        return symbols.find_symbol(files, request["symbol"], scope=scope, max_results=limit, workspace=self.name, push=self.stored is not None)

    def _resolve(self, selector: str, path: str | None = None, line: int | None = None) -> references.Target:
        files = self.stored.declaring(selector, path) if self.stored else self.files
        return references.resolve_symbol(files, selector, path, line, self.parsed)

    def _find_references(self, request: dict) -> tuple[DataFrame, DataFrame]:
        target = self._resolve(request["symbol"], request.get("definition_path"), request.get("definition_line"))
        return self._references(
            target, reference_scope=request.get("reference_scope", "all"), scope=requests.request_paths(request),
            kinds=request.get("reference_kinds"), context=min(request.get("context_lines", search.DEFAULT_CONTEXT), search.MAX_CONTEXT),
            max_results=self._limit(request),
        )

    def _references(self, target: references.Target, **options) -> tuple[DataFrame, DataFrame]:
        """Windows, and their totals with the files and bytes in scope."""
        files = self.stored.with_token(target.name, options.get("scope")) if self.stored else self.files
        found = references.find_references(files, target, parsed=self.parsed, workspace=self.name, push=self.stored is not None, **options)
        totals = references.reference_summary(files, target, parsed=self.parsed, **options)
        scanned = references.scanned_scope(self.files, options.get("reference_scope", "all"), options.get("scope"))
        return found, totals.crossJoin(scanned)  # one row each

    def _symbols_overview(self, request: dict) -> DataFrame:
        wanted = [(p,) for p in requests.request_paths(request)]
        return symbols.outline(self.files, self.spark.createDataFrame(wanted, "path STRING"))

    def _repo_map(self, request: dict) -> DataFrame:
        return index.repo_map(self.files, scope=requests.request_paths(request), max_results=self._limit(request))

    def _read(self, request: dict) -> DataFrame:
        rows = self._read_whole(request)
        return reads.compact(rows) if request.get("response_detail") == "compact" else rows

    def _read_whole(self, request: dict) -> DataFrame:
        target, value = request["target"], request["value"]
        limit = request.get("max_chars")
        one = self.spark.createDataFrame([(value,)], "value STRING")
        if target == "path":
            bounds = {k: request[k] for k in ("start_line", "end_line") if k in request}
            return reads.read_paths(
                self.files, one.withColumnRenamed("value", "path"), start=bounds.get("start_line"), end=bounds.get("end_line"),
                max_chars=limit, workspace=self.name,
            )
        if target == "handle":
            handles.decode_token("range:", value, "INVALID_HANDLE")
            return reads.read_handles(self.files, one.withColumnRenamed("value", "handle"), workspace=self.name, max_chars=limit)
        if target == "continuation":
            handles.decode_token("fetch:", value, "INVALID_CONTINUATION")
            return reads.read_continuations(self.files, one.withColumnRenamed("value", "continuation"), workspace=self.name, max_chars=limit)
        if target == "metadata":
            return reads.metadata(describe(self._at(value).select("path", "content")))
        return self._read_symbol(request)

    def _read_symbol(self, request: dict) -> DataFrame:
        """The lines of one declaration and those around it, as a range read gives them: cut at the
        budget, with a handle and a continuation; with ``include_imports`` also the
        import lines above.  ``path::name`` names the path where no path is given."""
        name, path = request["value"], request.get("path")
        head, sep, tail = name.partition("::")
        if path is None and sep and tail and not self._at(paths.normalize_path(head)).isEmpty():
            name, path = tail, head
        found = self._resolve(name, path)
        around = min(request.get("surrounding_lines", 0), reads.MAX_SURROUNDING)
        mine = self._at(found.path)
        start = max(1, found.start_line - around)
        out = reads.read_range(mine, start, found.end_line + around, max_chars=request.get("max_chars"), workspace=self.name)
        out = out.withColumns({"name": F.lit(found.name), "kind": F.lit(found.kind)})
        if request.get("include_imports", False):
            lines = reads.import_prelude(mine, F.lit(start)).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("imports"))
            empty = F.array().cast("array<struct<line:int,text:string>>")
            out = out.join(lines, "path", "left").withColumn("imports", F.coalesce(F.col("imports").cast("array<struct<line:int,text:string>>"), empty))
        return out

    def plan_edit(self, changes: list[dict], *, snapshot_id: str | None = None, detail: str = "standard", cap: int = 0) -> DataFrame:
        """The plan of one edit request: a row for each file with its text before and after and
        its diff, or one row with the error.  Shapes are checked first and raise."""
        if not isinstance(changes, list) or not changes:
            raise EngineError("INVALID_REQUEST", "changes must be a list and cannot be empty")
        checked = [requests.check_change(c) for c in changes]
        rows = [tuple({"txn": "edit", "seq": i, "snapshot_id": snapshot_id, **c}.get(name) for name in edit_requests.COLUMNS) for i, c in enumerate(checked, 1)]
        table = self.spark.createDataFrame(rows, ", ".join(f"{c} {kind}" for c, kind in edit_requests.COLUMNS.items()))
        named = sorted({c[f].replace("\\", "/") for c in checked for f in ("path", "to") if c.get(f)})
        current = self.snapshot_id() if snapshot_id is not None else None
        files = self._at(*named) if len(named) <= MOST_PATHS else self.files
        plan = edit_requests.plan_requests(table, files, workspace=self.name, snapshot=current, extractor="code" if self.parsed else "prose")
        return edits.shape_diff(edits.with_diff(plan.drop("txn")), detail, cap)

    def diff_page(
        self, parsed: DataFrame, snapshot_id: str, *, paths_: list[str] | None = None, symbol: str | None = None, start_line: int | None = None,
        end_line: int | None = None, hunk_ids: list[str] | None = None, max_chars: int = reads.DEFAULT_BUDGET, continuation: str | None = None,
    ) -> tuple[DataFrame, str | None]:
        """A page of the hunks in ``parsed`` (``hunks.parse``) that a request selects, and the next token.

        A symbol needs exactly one path and one declaration there; its hunks are those that
        meet its lines.  A range of lines needs both ends.  All rules given hold at once.
        A continuation brings the rules it was made with; others beside it are an error.
        """
        given = {"paths": paths_ or [], "symbol": symbol, "start_line": start_line, "end_line": end_line, "hunk_ids": hunk_ids or []}
        asked = any(v not in (None, []) for v in given.values())
        scope = given
        if continuation is not None:
            scope = handles.decode_token(diff_pages.PREFIX, continuation, "INVALID_CONTINUATION").get("scope") or given
        kept = parsed
        if scope["paths"]:
            kept = kept.filter(paths.in_scope("path", scope["paths"]))
        if scope["symbol"] is not None:
            if len(scope["paths"]) != 1:
                raise EngineError("INVALID_REQUEST", "the hunks of a symbol need exactly one path")
            found = self._resolve(scope["symbol"], scope["paths"][0])
            kept = kept.filter(hunks.overlaps(found.start_line, found.end_line))
        if scope["start_line"] is not None and scope["end_line"] is not None:
            kept = kept.filter(hunks.overlaps(scope["start_line"], scope["end_line"]))
        if scope["hunk_ids"]:
            kept = kept.filter(F.col("id").isin(scope["hunk_ids"]))
        return diff_pages.page(kept, snapshot_id, max_chars=max_chars, scope=given if asked or continuation is None else None, continuation=continuation)

    def references_at(self, path: str, line: int, max_results: int = 20) -> DataFrame:
        """References of the symbol at a position; same result as by name."""
        row = symbols.resolve_positions(self._at(path), F.lit(line)).first()
        if row is None:
            raise EngineError("PATH_NOT_INDEXED", "path is not indexed", path=path)
        if row["error"]:
            raise EngineError(row["error"], "no declaration at this position", path=path, line=line)
        target = self._resolve(row["name"], path, row["start_line"])
        return self._references(target, context=0, max_results=max_results)[0]

    def snapshot_id(self, head: str = "") -> str:
        if self.stored and self.stored.snapshot is not None:
            return index.snapshot_of(self.stored.snapshot, head).first()["snapshot_id"]
        return index.snapshot_id(self.files, head).first()["snapshot_id"]

    def require_snapshot(self, expected: str, head: str = "") -> None:
        actual = self.snapshot_id(head)
        if actual != expected:
            raise EngineError("STALE_SNAPSHOT", "the corpus changed", expected_snapshot=expected, actual_snapshot=actual)

    def summary(self) -> DataFrame:
        """File count and languages in one row."""
        lang = paths.language("path")
        names = F.sort_array(F.collect_set(F.when(lang != "text", lang)))
        return self.files.agg(F.count("*").alias("file_count"), F.array_join(names, ",").alias("languages"))

    def instructions(self) -> DataFrame:
        """Instruction files, each cut at a line end within the cap."""
        rows = self.files.filter(F.col("path").isin(INSTRUCTION_FILES))
        size = F.octet_length("content")
        return rows.select(
            "path", text.cap_at_newline("content", INSTRUCTION_CAP).alias("content"),
            (size > INSTRUCTION_CAP).alias("content_truncated"), size.alias("content_bytes"),
        )

    @staticmethod
    def changes(log: DataFrame, since_generation: int = 0, source: str | None = None, limit: int = 200) -> DataFrame:
        return changelog.changes_since(log, since_generation, source, limit)
