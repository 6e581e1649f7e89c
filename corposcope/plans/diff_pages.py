"""Paging through the hunks of one diff with resumable cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import handles

PREFIX = "diff:"
# Bytes of the shortest hunk: its header line.
LEAST_HUNK = 8


def page(
    parsed: DataFrame, snapshot_id: str, *, max_chars: int, scope: dict | None = None, continuation: str | None = None
) -> tuple[DataFrame, str | None]:
    """One page of hunks and the token of the next page.

    ``parsed`` holds the hunks of one diff after its filters, in the order of ``file``
    (else ``path``, for hunks of several files) and ``hunk_no``.
    ``scope`` names the filters.  A token is good for its own snapshot and scope only.
    The driver learns the sizes of the hunks that can stand on one page.
    """
    after = None
    if continuation is not None:
        token = handles.decode_token(PREFIX, continuation, "INVALID_CONTINUATION")
        if token["snapshot_id"] != snapshot_id:
            raise EngineError("STALE_CONTINUATION", "the diff changed", expected_snapshot=token["snapshot_id"])
        if scope is not None and scope != token["scope"]:
            raise EngineError("CONTINUATION_SCOPE_MISMATCH", "the token belongs to other filters", scope=token["scope"])
        after, scope = token["offset"], token["scope"]
    order = [next((c for c in ("file", "path") if c in parsed.columns), None), "hunk_no"]
    order = [c for c in order if c]
    place = F.struct(*order)
    at = lambda p: F.struct(*(F.lit(v).alias(c) for c, v in zip(order, p)))
    rest = parsed if after is None else parsed.filter(place >= at(after))
    # Every hunk has at least LEAST_HUNK bytes, so a page and the hunk after it are among these.
    sizes = rest.select(*order, F.octet_length("text").alias("size")).orderBy(*order)
    used, following, last = 0, None, None
    for row in sizes.limit(max_chars // LEAST_HUNK + 2).collect():
        if last is not None and used + row["size"] > max_chars:
            following = [row[c] for c in order]
            break
        used, last = used + row["size"], [row[c] for c in order]
    shown = rest.filter(F.lit(False) if last is None else place <= at(last)).orderBy(*order)
    if following is None:
        return shown, None
    payload = {"snapshot_id": snapshot_id, "offset": following, "scope": scope}
    return shown, handles.encode_token(PREFIX, payload)
