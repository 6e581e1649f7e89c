"""Edit requests: every kind of change in one transaction, planned over a piece table.

A request is a list of changes that belong together (``txn``), in order of ``seq``.  Its
guards and exact matches are first checked against the stored texts; then the changes
are folded in order.  A text under edit is a piece table: the stored text is never
copied, a change splits a piece and puts another between, and the text is spelled out
only where a later change has to search it.  The first error voids the request.

Requests are dealt by ``txn`` and streamed one after the other, so a task holds one request
and the files that it names; the request is bounded by its sender.
"""

from __future__ import annotations

import hashlib
import itertools
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import handles, syntax
from .edits import INSERT_POSITIONS, PLAN_SCHEMA, with_line_ends

# Columns of a change; those that a table of changes lacks are null.
COLUMNS = {
    "txn": "string", "seq": "int", "kind": "string", "path": "string", "to": "string", "old_text": "string", "new_text": "string", "content": "string",
    "anchor_symbol": "string", "position": "string", "expected_replacements": "int", "overwrite": "boolean", "expected_hash": "string", "handle": "string",
    "snapshot_id": "string",
}

_HEADING = regex.compile(r"^(\p{Lu}\p{L}*)")


class Pieces:
    """A text as runs of its stored form and of what was added, in order."""

    def __init__(self, original: str):
        self.sources = [original]
        # (source, start, length)
        self.runs: list[tuple[int, int, int]] = [(0, 0, len(original))] if original else []
        self._text: str | None = original

    def text(self) -> str:
        if self._text is None:
            self._text = "".join(self.sources[s][a : a + n] for s, a, n in self.runs)
        return self._text

    def replace(self, ranges: list[tuple[int, int]], new: str) -> None:
        """``new`` in place of each of the disjoint ascending character ranges."""
        self.sources.append(new)
        added = len(self.sources) - 1
        starts = list(itertools.accumulate((n for _, _, n in self.runs), initial=0))
        out: list[tuple[int, int, int]] = []

        def keep(a: int, b: int) -> None:
            k = max(bisect_right(starts, a) - 1, 0)
            while a < b and k < len(self.runs):
                source, at, n = self.runs[k]
                stop = min(b, starts[k] + n)
                if stop > a:
                    out.append((source, at + a - starts[k], stop - a))
                a, k = stop, k + 1

        done = 0
        for a, b in ranges:
            keep(done, a)
            if new:
                out.append((added, 0, len(new)))
            done = b
        keep(done, starts[-1])
        self.runs, self._text = out, None


def line_offset(text: str, line: int) -> int:
    """Where a line starts; the end of the text for a line behind the last."""
    at = 0
    for _ in range(max(line - 1, 0)):
        at = text.find("\n", at) + 1
        if not at:
            return len(text)
    return at


def exact_ranges(text: str, low: int, high: int, old: str, expected: int, like: str) -> list[tuple[int, int]] | None:
    """The ranges of ``old`` within ``low``..``high`` if there are ``expected``: in the line
    ends of the file if those fit, else as given."""
    for needle in dict.fromkeys((with_line_ends(old, like), old)):
        if needle and text.count(needle, low, high) == expected:
            found, at = [], low
            while (at := text.find(needle, at, high)) >= 0:
                found.append((at, at + len(needle)))
                at += len(needle)
            return found
    return None


def ended_like(old: str, new: str) -> str:
    """``new`` with the line end that the text in its place ended with."""
    if new and old.endswith("\n") and not new.endswith("\n"):
        return new + ("\r\n" if old.endswith("\r\n") else "\n")
    return new


def outline(path: str, text: str, extractor: str) -> list[dict]:
    """Declarations of a text in the form of the workspace's extractor."""
    if extractor == "code":
        return syntax.symbols_at(path, text)
    lines = text.replace("\r\n", "\n").split("\n")
    lines = lines[:-1] if lines and lines[-1] == "" else lines
    heads = [(i + 1, m[1]) for i, line in enumerate(lines) if (m := _HEADING.match(line))]
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    out = [{"name": stem, "start_line": 1, "end_line": max(len(lines), 1)}]
    for k, (line, name) in enumerate(heads):
        out.append({"name": name, "start_line": line, "end_line": heads[k + 1][0] - 1 if k + 1 < len(heads) else max(len(lines), 1)})
    return out


class Refused(Exception):
    def __init__(self, code: str, path: str | None):
        self.code, self.path = code, path


@dataclass
class Plan:
    """One request.  ``stored`` has the text of every path that a change names."""

    stored: dict[str, str]
    workspace: str
    snapshot: str | None
    extractor: str
    before: dict[str, str | None] = field(default_factory=dict)
    after: dict[str, Pieces | None] = field(default_factory=dict)

    def now(self, path: str) -> Pieces | None:
        if path in self.after:
            return self.after[path]
        return Pieces(self.stored[path]) if path in self.stored else None

    def put(self, path: str, before: str | None, after: Pieces | None) -> None:
        self.before.setdefault(path, before)
        self.after[path] = after

    def handle_of(self, change: dict) -> dict | None:
        if change["handle"] is None:
            return None
        try:
            body = handles.decode_token("range:", change["handle"], "INVALID_HANDLE")
            fits = body["w"] == self.workspace and body["p"] == change["path"]
            body = {"a": int(body["a"]), "b": int(body["b"]), "h": body["h"], "fits": fits}
        except (EngineError, KeyError, TypeError, ValueError):
            body = {"fits": False}
        if not body["fits"]:
            raise Refused("INVALID_HANDLE", change["path"])
        if body["a"] > body["b"]:
            raise Refused("INVALID_HANDLE_RANGE", change["path"])
        return body

    def check(self, changes: list[dict]) -> None:
        """Snapshot, order of handle edits, exact matches and overlaps, on the stored texts."""
        asked = changes[0]["snapshot_id"]
        if asked is not None and asked != self.snapshot:
            for c in changes:
                created = c["kind"] == "create" and c["overwrite"] is not True
                if not created and c["expected_hash"] is None and c["handle"] is None:
                    raise Refused("STALE_SNAPSHOT", c["path"])
        times = Counter(c["path"] for c in changes)
        for c in changes:
            if c["handle"] is not None and times[c["path"]] > 1:
                raise Refused("AMBIGUOUS_HANDLE_EDIT_ORDER", c["path"])
        spans: dict[str, list[tuple[int, int]]] = {}
        for c in changes:
            if c["kind"] not in ("replace", "replace_range"):
                continue
            text = self.stored.get(c["path"])
            if text is None:
                raise Refused("PATH_NOT_INDEXED", c["path"])
            spans.setdefault(c["path"], []).extend(self.ranges(c, text)[0])
        for path, own in spans.items():
            own.sort()
            if any(b > c for (_, b), (c, _) in zip(own, own[1:])):
                raise Refused("OVERLAPPING_EDITS", path)

    def ranges(self, change: dict, text: str) -> tuple[list[tuple[int, int]], str]:
        """The ranges that a replacement concerns, and the text that stands in one of them."""
        handle = self.handle_of(change)
        low, high = (line_offset(text, handle["a"]), line_offset(text, handle["b"] + 1)) if handle else (0, len(text))
        if change["kind"] == "replace_range":
            if handle is None:
                raise Refused("MISSING_HANDLE", change["path"])
            return [(low, high)], text[low:high]
        expected = 1 if change["expected_replacements"] is None else change["expected_replacements"]
        found = exact_ranges(text, low, high, change["old_text"] or "", expected, text)
        if found is None:
            raise Refused("EXACT_MATCH_COUNT", change["path"])
        return found, text[slice(*found[0])] if found else ""

    def guard(self, change: dict, now: Pieces | None) -> None:
        path, kind = change["path"], change["kind"]
        handle = self.handle_of(change)
        expected = change["expected_hash"] or (handle["h"] if handle else None)
        trusted = change["snapshot_id"] is not None and change["snapshot_id"] == self.snapshot
        if (kind != "create" or now is not None) and expected is None and not trusted:
            raise Refused("MISSING_PRECONDITION", path)
        if expected is not None:
            # The text before the request, or, for a path that the request made, the text made.
            original = self.before.get(path)
            if original is None and now is not None:
                original = now.text()
            if original is None or hashlib.sha256(original.encode()).hexdigest() != expected:
                raise Refused("STALE_FILE", path)

    def apply(self, change: dict) -> None:
        path, kind, to = change["path"], change["kind"], change["to"]
        for named in (path, to):
            if named is not None and (named.startswith("/") or ".." in named.split("/")):
                raise Refused("OUTSIDE_ROOT", named)
        now = self.now(path)
        self.guard(change, now)
        if kind == "create":
            if now is not None and change["overwrite"] is not True:
                raise Refused("PATH_EXISTS", path)
            body = change["content"] or ""
            self.put(path, now.text() if now else None, Pieces(with_line_ends(body, now.text()) if now else body))
            return
        if now is None:
            raise Refused("PATH_NOT_FOUND", path)
        text = now.text()
        if kind == "delete":
            self.put(path, text, None)
        elif kind == "rename":
            if self.after.get(to) is not None or to in self.stored:
                raise Refused("PATH_EXISTS", to)
            self.put(path, text, None)
            self.put(to, None, now)
        elif kind in ("replace", "replace_range"):
            found, old = self.ranges(change, text)
            self.put(path, text, now)
            now.replace(found, ended_like(old, with_line_ends(change["new_text"] or "", text)))
        elif kind == "insert":
            symbol = next((s for s in outline(path, text, self.extractor) if s["name"] == change["anchor_symbol"]), None)
            if symbol is None:
                raise Refused("SYMBOL_NOT_FOUND", path)
            if change["position"] not in INSERT_POSITIONS:
                raise Refused("INVALID_CHANGE_FIELD", path)
            first, last = symbol["start_line"], symbol["end_line"]
            at = line_offset(text, {"before": first, "after": last + 1, "inside_start": first + 1, "inside_end": last}[change["position"]])
            self.put(path, text, now)
            now.replace([(at, at)], with_line_ends(change["content"] or "", text))
        else:
            raise Refused("INVALID_CHANGE_KIND", path)


def plan_request(changes: list[dict], stored: dict[str, str], workspace: str, snapshot: str | None, extractor: str) -> list[list]:
    """Plan rows (path, before, after, error) of one request; its first error alone if it has one."""
    plan = Plan(stored, workspace, snapshot, extractor)
    try:
        plan.check(changes)
        for change in changes:
            plan.apply(change)
    except Refused as error:
        return [[error.path, None, None, error.code]]
    return [[p, plan.before[p], after.text() if after else None, None] for p, after in sorted(plan.after.items())]


def plan_requests(changes: DataFrame, files: DataFrame, *, workspace: str = "main", snapshot: str | None = None, extractor: str = "prose") -> DataFrame:
    """Plan rows (txn, path, before, after, error) of every request in ``changes``.

    ``changes`` has the columns of ``COLUMNS`` that its kinds need; backslashes in paths
    count as slashes.  ``snapshot`` is the current snapshot's id: a request with another one
    passes if each of its changes has a guard of its own.  A path that several changes
    name is joined to its text once per request.  Requests without a txn are one request.
    """
    have = set(changes.columns)
    rows = changes.select(*((F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in COLUMNS.items()))
    slash = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    rows = rows.withColumns({"path": slash(F.col("path")), "to": slash(F.col("to")), "txn": F.coalesce("txn", F.lit(""))})
    named = rows.select("txn", "path").union(rows.filter("to IS NOT NULL").select("txn", F.col("to"))).distinct()
    texts = named.join(files.filter("content IS NOT NULL").select("path", F.col("content").alias("_stored")), "path")
    # A request's texts come before its changes.
    parts = rows.withColumn("_stored", F.lit(None).cast("string")).unionByName(texts, allowMissingColumns=True)
    ordered = parts.repartition("txn").sortWithinPartitions("txn", F.col("seq").asc_nulls_first())

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        records = (r for batch in batches for r in batch.astype(object).where(batch.notna(), None).to_dict("records"))
        out: list[list] = []
        for txn, own in itertools.groupby(records, key=lambda r: r["txn"]):
            stored: dict[str, str] = {}
            asked: list[dict] = []
            for r in own:
                if r["_stored"] is not None:
                    stored[r["path"]] = r["_stored"]
                else:
                    asked.append(r)
            out += [[txn, *row] for row in plan_request(asked, stored, workspace, snapshot, extractor)] if asked else []
            if len(out) >= 500:
                yield pd.DataFrame(out, columns=PLAN_SCHEMA.names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=PLAN_SCHEMA.names)

    return ordered.mapInPandas(fold, PLAN_SCHEMA)
