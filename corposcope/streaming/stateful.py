"""Keyed state: suppression of the engine's own writes, bounded run output."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed value: how long an own write explains a watcher event.
INTERNAL_TTL_SECONDS = 30

ORIGIN_SCHEMA = "path STRING, ts TIMESTAMP, origin STRING"
TAIL_SCHEMA = "run_id STRING, tail STRING, dropped_chars BIGINT"

_COMPLETE = re.compile(
    r"\x1b+(?:\[[^@-~]*[@-~]|\](?:[^\x07\x1b]|\x1b+[^\\\x1b])*(?:\x07|\x1b+\\)|[^\[\]\x1b])", re.S
)


def classify_origin(events: DataFrame) -> DataFrame:
    """Mark watcher events as internal or external.

    ``events``: path, ts, kind (``write`` for the engine's own write, ``watch``
    for a watcher event).  A write explains one later watcher event of its path
    within thirty seconds; the state per path is one timestamp and expires.
    """
    return events.withWatermark("ts", f"{INTERNAL_TTL_SECONDS} seconds").groupBy("path").applyInPandasWithState(
        _origin, ORIGIN_SCHEMA, "written BIGINT", "append", GroupStateTimeout.EventTimeTimeout
    )


def _origin(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    written = state.get[0] if state.exists else None
    out = []
    rows = pd.concat(list(batches)).sort_values(["ts", "kind"], ascending=[True, False])
    for ts, kind in zip(rows["ts"], rows["kind"]):
        micros = int(pd.Timestamp(ts).value // 1000)
        if kind == "write":
            written = micros
            continue
        own = written is not None and 0 <= micros - written < INTERNAL_TTL_SECONDS * 1_000_000
        written = None if own else written
        out.append((key[0], ts, "internal" if own else "external"))
    if written is None:
        if state.exists:
            state.remove()
    else:
        state.update((written,))
        expiry = written // 1000 + INTERNAL_TTL_SECONDS * 1000
        if expiry > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(expiry)
        else:
            state.remove()
    yield pd.DataFrame(out, columns=["path", "ts", "origin"])


def accumulate_tail(chunks: DataFrame, limit: int) -> DataFrame:
    """Per run, the last ``limit`` characters of its output without terminal
    escapes, and how many were dropped.

    ``chunks``: run_id, seq, text.  An escape sequence cut by a chunk border waits
    in the state for its end.  A state holds at most ``limit`` characters and the
    kind of one open sequence, however long the run.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, dropped, pending = state.get if state.exists else ("", 0, "")
        for text in pd.concat(list(batches)).sort_values("seq")["text"]:
            plain, pending = strip_chunk(pending + text)
            tail += plain
            if len(tail) > limit:
                dropped += len(tail) - limit
                tail = tail[-limit:] if limit else ""
        state.update((tail, dropped, pending))
        yield pd.DataFrame([(key[0], tail, dropped)], columns=["run_id", "tail", "dropped_chars"])

    return chunks.groupBy("run_id").applyInPandasWithState(
        fold, TAIL_SCHEMA, "tail STRING, dropped BIGINT, pending STRING", "update", GroupStateTimeout.NoTimeout
    )


def strip_chunk(text: str) -> tuple[str, str]:
    """Text without complete escapes, and what must wait of an open one.

    Of an open sequence only its kind matters, so the rest is never larger than
    three characters.
    """
    plain = _COMPLETE.sub("", text)
    at = plain.find("\x1b")
    if at < 0:
        return plain, ""
    rest = plain[at:].lstrip("\x1b")
    if not rest:
        return plain[:at], "\x1b"
    ends = "\x1b" if rest[0] == "]" and rest.endswith("\x1b") else ""
    return plain[:at], "\x1b" + rest[0] + ends
