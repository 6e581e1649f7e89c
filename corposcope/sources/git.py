"""Version-control readers: child processes whose text becomes rows.

Status and log are one short text each.  Diffs are taken path by path inside
tasks, so a large change set is neither cut nor gathered on the driver.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..operators import hunks

MAX_LOG = 200


def run_git(root: str, args: list[str], timeout: int = 120) -> str:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=timeout, check=False)
    except FileNotFoundError as error:
        raise EngineError("GIT_UNAVAILABLE", "git is not installed") from error
    except subprocess.TimeoutExpired as error:
        raise EngineError("GIT_TIMEOUT", "git did not finish", args=args) from error
    if done.returncode != 0:
        message = done.stderr.decode("utf-8", "replace").strip()
        code = "NOT_GIT_REPOSITORY" if "not a git repository" in message else "GIT_FAILED"
        raise EngineError(code, message, args=args)
    return done.stdout.decode("utf-8", "replace")


def _one(spark: SparkSession, root: str, raw: str) -> DataFrame:
    return spark.createDataFrame([(root, raw)], "root STRING, raw STRING")


def status(spark: SparkSession, root: str) -> DataFrame:
    raw = run_git(root, ["status", "--porcelain=v2", "-z", "--branch", "--untracked-files=all"])
    return hunks.parse_status(_one(spark, root, raw), ["root"])


def head(spark: SparkSession, root: str) -> DataFrame:
    raw = run_git(root, ["status", "--porcelain=v2", "-z", "--branch"])
    return hunks.status_header(_one(spark, root, raw), ["root"])


def log(spark: SparkSession, root: str, limit: int = 20) -> DataFrame:
    raw = run_git(root, ["log", f"-n{min(limit, MAX_LOG)}", "--date=iso-strict", "--pretty=format:%H%x09%ad%x09%an%x09%s"])
    return hunks.parse_log(_one(spark, root, raw))


def show(spark: SparkSession, root: str, reference: str = "HEAD") -> DataFrame:
    if reference.startswith("-"):
        raise EngineError("INVALID_REQUEST", "a reference may not be an option", reference=reference)
    return _one(spark, root, run_git(root, ["show", "--stat", "--patch", reference]))


def blame(spark: SparkSession, root: str, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    span = [f"-L{start},{end}"] if start is not None and end is not None else []
    return _one(spark, root, run_git(root, ["blame", *span, "--", path]))


def diff(spark: SparkSession, root: str, *, staged: bool = False, paths: list[str] | None = None) -> DataFrame:
    """Hunks of all changed files (a new-file patch has a header but no hunk)."""
    return hunks.parse(patches(spark, root, staged=staged, paths=paths), ["file"])


def patches(spark: SparkSession, root: str, *, staged: bool = False, paths: list[str] | None = None) -> DataFrame:
    """Patch text per changed file; untracked files are included when asked for by path."""
    changed = status(spark, root)
    wanted = changed.filter("staged" if staged else "unstaged").select("path", F.lit(False).alias("untracked"))
    if paths and not staged:
        wanted = wanted.unionByName(changed.filter("untracked").select("path", F.lit(True).alias("untracked")))
    if paths:
        wanted = wanted.filter(F.col("path").isin(paths))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, untracked in zip(batch["path"], batch["untracked"]):
                if untracked:
                    with open(f"{root}/{path}", encoding="utf-8", errors="replace", newline="") as handle:
                        rows.append((path, None, handle.read()))
                else:
                    args = ["diff", "--no-ext-diff", "--unified=3", *(["--cached"] if staged else []), "--", path]
                    rows.append((path, run_git(root, args), None))
            yield pd.DataFrame(rows, columns=["file", "diff", "content"])

    texts = wanted.mapInPandas(read, "file STRING, diff STRING, content STRING")
    return texts.select("file", F.coalesce("diff", hunks.untracked_patch(F.col("file"), F.col("content"))).alias("diff"))
