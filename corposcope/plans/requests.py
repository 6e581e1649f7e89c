"""Closed request shapes: which fields each operation and change takes."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import EngineError

# Limits and choices of a request.
MAX_OPERATIONS = 12

# Required and optional fields of each operation and change kind.
_SEARCH = ["id", "path", "paths", "max_results", "context_lines", "case_sensitive", "response_detail"]
OPERATIONS = {
    "find_file": (["operation", "name"], _SEARCH),
    "find_symbol": (["operation", "symbol"], _SEARCH),
    "search_text": (["operation", "pattern"], [*_SEARCH, "syntax"]),
    "find_references": (
        ["operation", "symbol"],
        [*_SEARCH, "reference_scope", "reference_kinds", "definition_path", "definition_line"],
    ),
    "symbols_overview": (["operation"], ["id", "path", "paths", "max_results", "response_detail"]),
    "repo_map": (["operation"], ["id", "path", "paths", "max_results", "response_detail"]),
    "read": (
        ["operation", "target", "value"],
        ["id", "path", "start_line", "end_line", "surrounding_lines", "include_imports", "max_chars", "response_detail"],
    ),
}
CHANGES = {
    "create": (["kind", "path", "content"], ["overwrite", "expected_hash"]),
    "replace": (["kind", "path", "old_text", "new_text"], ["expected_replacements", "expected_hash", "handle"]),
    "replace_range": (["kind", "path", "handle", "new_text"], []),
    "insert": (["kind", "path", "content", "anchor_symbol", "position"], ["expected_hash"]),
    "delete": (["kind", "path"], ["expected_hash"]),
    "rename": (["kind", "path", "to"], ["expected_hash"]),
}
READ_TARGETS = ["path", "handle", "symbol", "metadata", "continuation"]
DETAILS = ["compact", "standard", "debug"]
POSITIONS = ["before", "after", "inside_start", "inside_end"]


@dataclass(frozen=True)
class _Codes:
    missing: str
    unknown: str
    invalid: str
    unsupported: str


_OPERATION = _Codes(
    "MISSING_OPERATION_FIELD", "UNKNOWN_OPERATION_FIELD", "INVALID_OPERATION_FIELD", "UNSUPPORTED_RETRIEVAL_OPERATION"
)
_CHANGE = _Codes("MISSING_CHANGE_FIELD", "UNKNOWN_CHANGE_FIELD", "INVALID_CHANGE_FIELD", "UNSUPPORTED_CHANGE_KIND")


def _check(request: dict, kind: str, table: dict, codes: _Codes) -> None:
    if kind not in table:
        raise EngineError(codes.unsupported, f"{kind!r} is not supported", supported=sorted(table))
    required, optional = table[kind]
    unknown = sorted(set(request) - set(required) - set(optional))
    if unknown:
        raise EngineError(codes.unknown, f"{kind} does not take {', '.join(unknown)}", unknown=unknown)
    missing = [f for f in required if request.get(f) is None]
    if missing:
        raise EngineError(codes.missing, f"{kind} needs {', '.join(missing)}", missing=missing)


def _text(request: dict, field: str, codes: _Codes) -> None:
    value = request.get(field)
    if not isinstance(value, str) or not value.strip():
        raise EngineError(codes.invalid, f"{field} must be a non-empty string", field=field)


NUMBERS = ("max_results", "context_lines", "max_chars", "start_line", "end_line", "surrounding_lines", "definition_line", "expected_replacements")
FLAGS = ("case_sensitive", "include_imports", "overwrite")
LISTS = ("paths", "reference_kinds")


def _types(request: dict, codes: _Codes) -> None:
    """Every field that is given by its type: all that are not named above are strings."""
    for field, value in request.items():
        if value is None:
            continue
        if field in NUMBERS:
            fits, what = isinstance(value, int) and not isinstance(value, bool), "a whole number"
        elif field in FLAGS:
            fits, what = isinstance(value, bool), "true or false"
        elif field in LISTS:
            fits, what = isinstance(value, list) and all(isinstance(v, str) for v in value), "a list of strings"
        else:
            fits, what = isinstance(value, str), "a string"
        if not fits:
            raise EngineError(codes.invalid, f"{field} must be {what}", field=str(field))


def operation_id(request: object, number: int) -> str:
    """The id that a request gives, or its place; a request of a wrong shape has its place."""
    given = request.get("id") if isinstance(request, dict) else None
    return given if isinstance(given, str) and given else f"op_{number}"


def check_operation(request: dict) -> dict:
    if not isinstance(request, dict):
        raise EngineError(_OPERATION.invalid, "an operation is an object", field="operation")
    # A field without a value counts as not given.
    request = {k: v for k, v in request.items() if v is not None}
    kind = request.get("operation")
    if not isinstance(kind, str | None):
        raise EngineError(_OPERATION.invalid, "operation must be a string", field="operation")
    _check(request, kind, OPERATIONS, _OPERATION)
    _types(request, _OPERATION)
    for field in OPERATIONS[kind][0][1:]:
        _text(request, field, _OPERATION)
    paths = request.get("paths", [])
    if kind == "symbols_overview" and not paths and not request.get("path"):
        raise EngineError(_OPERATION.missing, "symbols_overview needs path or paths")
    if request.get("response_detail", "standard") not in DETAILS:
        raise EngineError(_OPERATION.invalid, "unknown response_detail", field="response_detail")
    if kind == "read" and request["target"] not in READ_TARGETS:
        raise EngineError("UNSUPPORTED_READ_TARGET", f"unknown target {request['target']!r}", supported=READ_TARGETS)
    return request


def check_change(request: dict) -> dict:
    if not isinstance(request, dict):
        raise EngineError(_CHANGE.invalid, "a change is an object", field="kind")
    kind = request.get("kind")
    if not isinstance(kind, str) or not kind.strip():
        raise EngineError(_CHANGE.missing, "a change needs a kind", field="kind")
    _check(request, kind, CHANGES, _CHANGE)
    _types(request, _CHANGE)
    _text(request, "path", _CHANGE)
    if kind == "replace_range":
        _text(request, "handle", _CHANGE)
    if kind == "insert" and request["position"] not in POSITIONS:
        raise EngineError(_CHANGE.invalid, "unknown insert position", field="position")
    return request


def request_paths(request: dict) -> list[str]:
    paths = list(request.get("paths", []))
    single = request.get("path")
    if single and single not in paths:
        paths.append(single)
    return paths
