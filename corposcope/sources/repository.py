"""Scan of a file tree as a Spark data source.

``spark.read.format("tree_files")`` yields path, content, size, modified_ns for
every admitted file below ``root``.  Spark's own file sources skip names that
start with ``_`` or ``.``, which a source tree needs.  The driver lists only the
upper directories, until there are enough subtrees to hand out; tasks walk and
read the rest, so neither the listing nor the text passes through the driver.
The root must be on storage that all executors see.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import EngineError
from ..functions import paths
from .gitignore import Rule, check_exclusions, compile_lines, decide, exclusion_regex

SCHEMA = "path STRING, content STRING, size BIGINT, modified_ns BIGINT"
DEFAULT_MAX_BYTES = 2_000_000
NUL_PROBE = 8192


class Subtree(InputPartition):
    """Directories to walk and loose files to read, as paths below the root."""

    def __init__(self, directories: list[str], files: list[str]):
        self.directories, self.files = directories, files


class Walker:
    """Ignore decisions below one root; rules of a directory are read once."""

    def __init__(self, root: str, respect_ignores: bool, exclude: list[str]):
        self.root, self.respect = root, respect_ignores
        regex = exclusion_regex(exclude)
        self.excluded = re.compile(regex) if regex else None
        self.rules: dict[str, tuple[list[Rule], list[Rule]]] = {}
        self.versioned = respect_ignores and self._inside_worktree()
        self.local = self._read(os.path.join(root, ".git", "info", "exclude")) if self.versioned else []

    def _inside_worktree(self) -> bool:
        at = os.path.abspath(self.root)
        while True:
            if os.path.exists(os.path.join(at, ".git")):
                return True
            if os.path.dirname(at) == at:
                return False
            at = os.path.dirname(at)

    @staticmethod
    def _read(path: str) -> list[Rule]:
        try:
            with open(path, encoding="utf-8", errors="replace") as handle:
                return compile_lines(handle)
        except OSError:
            return []

    def _rules_of(self, directory: str) -> tuple[list[Rule], list[Rule]]:
        if directory not in self.rules:
            at = os.path.join(self.root, directory)
            git = self._read(os.path.join(at, ".gitignore")) if self.versioned else []
            self.rules[directory] = (self._read(os.path.join(at, ".ignore")), git)
        return self.rules[directory]

    def ignored(self, relative: str, is_dir: bool) -> bool:
        name = relative.rsplit("/", 1)[-1]
        if name in paths.EXCLUDED_COMPONENTS or name.startswith(tuple(paths.EXCLUDED_PREFIXES)):
            return True
        if not is_dir and paths.TEMP_MARKER in name:
            return True
        # A directory is tested as if a file lay in it, which a pattern for
        # directories only would also match.
        if self.excluded and self.excluded.fullmatch(relative + "/x" if is_dir else relative):
            return True
        if not self.respect:
            return False
        parts = relative.split("/")
        levels = ["/".join(parts[:i]) for i in range(len(parts) - 1, -1, -1)]
        for kind in (0, 1):
            for level in levels:
                inner = relative[len(level) + 1:] if level else relative
                verdict = decide(self._rules_of(level)[kind], inner, is_dir)
                if verdict is not None:
                    return verdict
        return decide(self.local, relative, is_dir) is True

    def list(self, directory: str) -> tuple[list[str], list[str]]:
        """Sub-directories and files of one directory that are not ignored."""
        dirs, files = [], []
        with os.scandir(os.path.join(self.root, directory)) as entries:
            for entry in entries:
                relative = f"{directory}/{entry.name}" if directory else entry.name
                if entry.is_dir(follow_symlinks=False):
                    if not self.ignored(relative, True):
                        dirs.append(relative)
                elif entry.is_file(follow_symlinks=False) and not self.ignored(relative, False):
                    files.append(relative)
        return sorted(dirs), sorted(files)


def read_file(root: str, relative: str, max_bytes: int):
    """One admitted row, or None: size, no early NUL, strict UTF-8, no symlink."""
    full = os.path.join(root, relative)
    try:
        stat = os.lstat(full)
        if stat.st_size > max_bytes:
            return None
        with open(full, "rb") as handle:
            raw = handle.read(max_bytes + 1)
    except OSError:
        return None
    if len(raw) > max_bytes or b"\0" in raw[:NUL_PROBE]:
        return None
    try:
        return relative, raw.decode("utf-8"), len(raw), stat.st_mtime_ns
    except UnicodeDecodeError:
        return None


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["root"]
        self.max_bytes = int(options.get("max_bytes", DEFAULT_MAX_BYTES))
        self.respect = options.get("respect_ignores", "true").lower() == "true"
        self.start = options.get("start", "")
        self.target = int(options.get("partitions", 64))
        # Options are strings; patterns hold no line breaks.
        self.exclude = check_exclusions([p for p in options.get("exclude", "").split("\n") if p])

    def partitions(self):
        walker = Walker(self.root, self.respect, self.exclude)
        frontier, loose = [self.start], []
        while frontier and len(frontier) < self.target:
            deeper = []
            for directory in frontier:
                dirs, files = walker.list(directory)
                deeper.extend(dirs)
                loose.extend(files)
            frontier = deeper
        parts = [Subtree([directory], []) for directory in frontier]
        step = max(1, -(-len(loose) // self.target))
        parts += [Subtree([], loose[i:i + step]) for i in range(0, len(loose), step)]
        return parts or [Subtree([], [])]

    def read(self, partition):
        walker = Walker(self.root, self.respect, self.exclude)
        queue = list(partition.directories)
        pending = list(partition.files)
        while queue or pending:
            for relative in pending:
                row = read_file(self.root, relative, self.max_bytes)
                if row is not None:
                    yield row
            pending = []
            if queue:
                dirs, pending = walker.list(queue.pop())
                queue.extend(dirs)


class TreeFiles(DataSource):
    @classmethod
    def name(cls):
        return "tree_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)


def scan(
    spark: SparkSession, root: str, *, max_bytes: int = DEFAULT_MAX_BYTES, exclude: list[str] | None = None,
    artifacts: list[str] | None = None, partitions: int | None = None,
) -> DataFrame:
    """The tree below ``root`` plus artifact directories read without ignore files.

    A path found both ways is kept once, as the artifact scan read it.  ``partitions``
    is the least number of subtrees the scan is cut into, eight per core unless given.
    """
    partitions = partitions or 8 * spark.sparkContext.defaultParallelism
    spark.dataSource.register(TreeFiles)
    patterns = check_exclusions(exclude or [])
    reader = spark.read.format("tree_files").option("root", root).option("max_bytes", max_bytes)
    reader = reader.option("exclude", "\n".join(patterns)).option("partitions", partitions)
    out = reader.load()
    for relative in artifacts or []:
        start = _artifact_dir(root, relative)
        if start is None:
            continue
        extra = reader.option("respect_ignores", "false").option("start", start).load()
        out = out.join(extra.select("path"), "path", "left_anti").unionByName(extra)
    return out


def _artifact_dir(root: str, relative: str) -> str | None:
    if os.path.isabs(relative) or ".." in relative.replace("\\", "/").split("/"):
        raise EngineError("OUTSIDE_ROOT", "artifact paths are relative to the root", path=relative)
    base, full = os.path.realpath(root), os.path.realpath(os.path.join(root, relative))
    if not os.path.exists(full):
        return None
    if full != base and not full.startswith(base + os.sep):
        raise EngineError("OUTSIDE_ROOT", "artifact path resolves outside the root", path=relative)
    return os.path.relpath(full, base).replace(os.sep, "/")


def not_excluded(path: Column | str, patterns: list[str]) -> Column:
    """Configured exclusions as one predicate over stored paths."""
    regex = exclusion_regex(patterns)
    p = F.col(path) if isinstance(path, str) else path
    return F.lit(True) if regex is None else ~F.rlike(p, F.lit(regex))
