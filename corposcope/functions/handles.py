"""Content identity and the opaque tokens that refer to text.

``range:`` names lines of one version of a file; ``fetch:`` resumes a read that
met its byte budget.  Both are URL-safe base64 of a small JSON object.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError
from .sqltext import lit
from .text import base64url, col, from_base64url

RANGE_SCHEMA = "w STRING, p STRING, a BIGINT, b BIGINT, h STRING"
SCOPE_SCHEMA = "kind STRING, start_line BIGINT, end_line BIGINT"
FETCH_SCHEMA = (
    f"workspace_id STRING, path STRING, offset BIGINT, content_hash STRING, scope STRUCT<kind: STRING, "
    "start_line: BIGINT, end_line: BIGINT>"
)


def content_hash(c: Column | str) -> Column:
    return F.sha2(F.encode(col(c), "UTF-8"), 256)


def range_handle(workspace: str, path: Column, start: Column, end: Column, digest: Column) -> Column:
    body = F.to_json(
        F.struct(
            F.lit(workspace).alias("w"),
            path.alias("p"),
            start.alias("a"),
            end.alias("b"),
            digest.alias("h"),
        )
    )
    return F.concat(F.lit("range:"), base64url(body))


def range_handle_sql(workspace: str, start: str, end: str) -> str:
    """SQL form of ``range_handle`` over the columns path and content."""
    body = (
        f"to_json(named_struct('w', {lit(workspace)}, 'p', path, 'a', {start}, 'b', {end}, "
        "'h', sha2(encode(content, 'UTF-8'), 256)))"
    )
    return f"concat('range:', translate(base64(encode({body}, 'UTF-8')), '+/=\\r\\n', '-_'))"


def fetch_token(
    workspace: str, path: Column, offset: Column, digest: Column, scope: Column
) -> Column:
    body = F.to_json(
        F.struct(
            F.lit(workspace).alias("workspace_id"),
            path.alias("path"),
            offset.alias("offset"),
            digest.alias("content_hash"),
            scope.alias("scope"),
        )
    )
    return F.concat(F.lit("fetch:"), base64url(body))


def full_scope() -> Column:
    return F.from_json(F.lit('{"kind":"full"}'), SCOPE_SCHEMA)


def line_scope(start: Column, end: Column) -> Column:
    return F.struct(
        F.lit("lines").alias("kind"),
        start.cast("bigint").alias("start_line"),
        end.cast("bigint").alias("end_line"),
    )


def decode_range(token: Column | str) -> Column:
    """Struct (w, p, a, b, h); null for a token of another kind."""
    t = col(token)
    return F.when(
        t.startswith("range:"), F.from_json(from_base64url(F.substr(t, F.lit(7))), RANGE_SCHEMA)
    )


def decode_fetch(token: Column | str) -> Column:
    t = col(token)
    return F.when(
        t.startswith("fetch:"), F.from_json(from_base64url(F.substr(t, F.lit(7))), FETCH_SCHEMA)
    )


def encode_token(prefix: str, payload: dict) -> str:
    raw = json.dumps(payload, separators=(",", ":"), ensure_ascii=False).encode()
    return prefix + base64.urlsafe_b64encode(raw).decode().rstrip("=")


def decode_token(prefix: str, token: str, code: str) -> dict:
    """Driver-side decode of one token of a request."""
    if not token.startswith(prefix):
        raise EngineError(code, "token of another kind")
    body = token[len(prefix):]
    try:
        return json.loads(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)))
    except ValueError as error:
        raise EngineError(code, str(error)) from error


def snapshot_lanes(path: Column, digest: Column) -> list[Column]:
    """sha256(path 0 hash 0) as eight unsigned 32-bit integers."""
    zero = F.lit(b"\0")
    row = F.sha2(
        F.concat(F.encode(path, "UTF-8"), zero, F.encode(digest, "UTF-8"), zero), 256
    )
    return [
        F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"lane{i}")
        for i in range(8)
    ]


def snapshot_token(tag: str, head: Column, count: Column, lanes: list[Column]) -> Column:
    """snap_ + sha256(tag 0 head 0 count-as-u64-little-endian xor-of-rows)."""
    big_endian = F.lpad(F.hex(count.cast("bigint")), 16, "0")
    little = F.concat(*[F.substring(big_endian, 15 - 2 * i, 2) for i in range(8)])
    xor = F.concat(*[F.lpad(F.hex(lane), 8, "0") for lane in lanes])
    body = F.concat(
        F.lit(tag.encode() + b"\0"),
        F.encode(head, "UTF-8"),
        F.lit(b"\0"),
        F.unhex(little),
        F.unhex(xor),
    )
    return F.concat(F.lit("snap_"), F.sha2(body, 256))
