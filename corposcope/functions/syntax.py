"""Per-file helpers that need a parser or a scan with state.

They run as Arrow UDFs over the files that survived the cheap filters.  Python
is parsed with ``ast``; brace languages are read by one declaration pattern
each, so their symbols carry the same kinds but are found without a grammar.
"""

from __future__ import annotations

import ast
import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import LANGUAGE_EXTENSIONS

SYMBOLS_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()),
            T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()),
            T.StructField("signature", T.StringType()),
        ]
    )
)
MARKS_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("start_byte", T.IntegerType()), T.StructField("end_byte", T.IntegerType()),
            T.StructField("role", T.StringType()), T.StructField("enclosing", T.StringType()),
        ]
    )
)

# Declaration keywords and the node kinds they stand for.
RUST = {
    "fn": "function_item", "struct": "struct_item", "enum": "enum_item", "trait": "trait_item",
    "impl": "impl_item", "type": "type_item", "mod": "mod_item",
}
SCRIPT = {
    "function": "function_declaration", "class": "class_declaration",
    "interface": "interface_declaration", "type": "type_alias_declaration",
    "enum": "enum_declaration",
}
MANAGED = {
    "class": "class_declaration", "interface": "interface_declaration",
    "enum": "enum_declaration", "record": "record_declaration",
    "namespace": "namespace_declaration",
}
NATIVE = {"struct": "struct_specifier", "enum": "enum_specifier", "union": "union_specifier"}
GO = {"func": "function_declaration", "type": "type_declaration"}
BRACE_LANGUAGES = {
    "rust": RUST, "typescript": SCRIPT, "tsx": SCRIPT, "javascript": SCRIPT,
    "go": GO, "java": MANAGED, "csharp": MANAGED, "c": NATIVE, "cpp": NATIVE,
}

_MODIFIERS = r"(?:[\w()\[\]:]+\s+)*?"


def _span_end(lines: list[str], first: int) -> int:
    """Line index closing the braces opened from ``first``; itself if none open."""
    depth, opened = 0, False
    for i in range(first, len(lines)):
        code = re.sub(r'"(?:\\.|[^"\\])*"|//.*', "", lines[i])
        for ch in code:
            if ch == "{":
                depth, opened = depth + 1, True
            elif ch == "}":
                depth -= 1
            elif ch == ";" and not opened and depth == 0:
                return i
        if opened and depth <= 0:
            return i
    return len(lines) - 1 if opened else first


def _brace_symbols(language: str, content: str) -> list[dict]:
    keywords = BRACE_LANGUAGES[language]
    # Go methods carry a receiver, Rust impl blocks generics, before the name.
    pattern = re.compile(
        rf"^\s*{_MODIFIERS}({'|'.join(keywords)})(?:\s*\([^)]*\)|\s*<[^>]*>)?\s+([A-Za-z_$][\w$]*)"
    )
    call_like = re.compile(rf"^\s+{_MODIFIERS}([A-Za-z_$][\w$]*)\s*\([^;{{]*\)[^;{{]*\{{\s*$")
    found, lines = [], content.split("\n")
    for i, line in enumerate(lines):
        match = pattern.match(line)
        if match:
            kind, name = keywords[match.group(1)], match.group(2)
            if language == "go" and re.match(r"\s*func\s*\(", line):
                kind = "method_declaration"
        else:
            match = call_like.match(line)
            if not match or language in ("rust", "go", "c") or match.group(1) in ("if", "for", "while", "switch", "catch"):
                continue
            kind, name = "method_definition", match.group(1)
        found.append(_symbol(name, kind, i + 1, _span_end(lines, i) + 1, line))
    return found


def _symbol(name: str, kind: str, start: int, end: int, line: str) -> dict:
    return {
        "name": name, "kind": kind, "start_line": start, "end_line": end,
        "signature": line.strip()[:300],
    }


# What the parsers raise on a text they refuse, and on one too deep or long for them to judge.
REFUSED, BEYOND = (SyntaxError, ValueError), (MemoryError, RecursionError)


def _python_symbols(content: str) -> list[dict]:
    try:
        tree = ast.parse(content)
    except (*REFUSED, *BEYOND):
        return []
    lines = content.split("\n")
    found = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
            line = lines[node.lineno - 1]
            found.append(_symbol(node.name, kind, node.lineno, node.end_lineno, line[node.col_offset:]))
    # Outer before inner: the order of a pre-order walk.
    return sorted(found, key=lambda s: (s["start_line"], -s["end_line"]))


def _symbols(language: str, content: str) -> list[dict]:
    if language == "python":
        return _python_symbols(content)
    return _brace_symbols(language, content) if language in BRACE_LANGUAGES else []


def symbols_at(path: str, content: str) -> list[dict]:
    """Declarations of one text, its language told by the path."""
    extension = path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else ""
    language = next((name for name, known in LANGUAGE_EXTENSIONS.items() if extension in known), "text")
    return _symbols(language, content)


@F.pandas_udf(SYMBOLS_TYPE)
def code_symbols(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(language, content) -> declarations in source order."""
    for language, content in batches:
        yield pd.Series([_symbols(a, b) for a, b in zip(language, content)])


def _breaks_early(content: str) -> bool:
    """Whether some beginning of a Python text is wrong however it goes on.

    A text is refused in a second pass, which words the message on a stack that grows with the
    text; so a text too long for that pass is judged by beginnings of it.
    """
    size = 64
    while size < len(content):
        head = content[:size]
        try:
            ast.parse(head)
        except SyntaxError as error:
            lines = re.split(r"\r\n?|\n", head)
            # The parser stopped at the token it names and has not seen the cut behind it.
            if error.msg == "invalid syntax" and (error.end_offset or 0) > 0 and (error.end_lineno, error.end_offset) < (len(lines), len(lines[-1]) + 1):
                return True
        except BEYOND:
            return False
        size *= 2
    return False


def _has_error(language: str, content: str | None) -> bool | None:
    if content is None or language not in ("python", "json"):
        return None
    try:
        (ast.parse if language == "python" else json.loads)(content)
    except REFUSED:
        return True
    except RecursionError:
        # Python's grammar has accepted a text whose tree is too deep to be built.
        return False if language == "python" else None
    except MemoryError:
        return _breaks_early(content) or None
    return False


@F.pandas_udf(T.BooleanType())
def parse_has_error(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """True or False where a parser exists, null where none does."""
    for language, content in batches:
        yield pd.Series([_has_error(a, b) for a, b in zip(language, content)], dtype="object")


class _Roles(ast.NodeVisitor):
    """Role of each identifier: declaration, else the nearest enclosing context."""

    def __init__(self, content: str, name: str):
        self.name = name
        self.lines = content.encode().split(b"\n")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.marks: list[dict] = []
        self.role, self.owners = "read", []

    def mark(self, line: int, column: int, role: str):
        start = self.starts[line - 1] + column
        owner = next((o for o in reversed(self.owners)), None)
        self.marks.append(
            {"start_byte": start, "end_byte": start + len(self.name.encode()), "role": role, "enclosing": owner}
        )

    def under(self, role: str, nodes):
        outer, self.role = self.role, role
        for node in nodes:
            if node is not None:
                self.visit(node)
        self.role = outer

    def declare(self, node):
        if node.name == self.name:
            line = self.lines[node.lineno - 1]
            keyword = re.compile(rb"(?:async\s+)?(?:def|class)\s+").match(line, node.col_offset)
            at = line.find(self.name.encode(), keyword.end() if keyword else node.col_offset)
            self.mark(node.lineno, at, "declaration")
        self.under(self.role, node.decorator_list)
        self.owners.append(node.name)
        rest = [c for c in ast.iter_child_nodes(node) if c not in node.decorator_list]
        annotation = getattr(node, "returns", None)
        self.under("read", [c for c in rest if c is not annotation])
        self.under("type", [annotation])
        self.owners.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = declare

    def visit_arg(self, node):
        if node.arg == self.name:
            self.mark(node.lineno, node.col_offset, self.role if node.annotation is None else "type")
        self.under("type", [node.annotation])

    def visit_Name(self, node):
        if node.id == self.name:
            self.mark(node.lineno, node.col_offset, self.role)

    def visit_Attribute(self, node):
        if node.attr == self.name:
            self.mark(node.end_lineno, node.end_col_offset - len(self.name.encode()), self.role)
        self.visit(node.value)

    def visit_Call(self, node):
        self.under("call", ast.iter_child_nodes(node))

    def visit_Assign(self, node):
        self.under("write", node.targets)
        self.visit(node.value)

    def visit_AugAssign(self, node):
        self.under("write", [node.target])
        self.visit(node.value)

    def visit_AnnAssign(self, node):
        self.under("write", [node.target])
        self.under("type", [node.annotation])
        if node.value is not None:
            self.visit(node.value)

    def visit_Import(self, node):
        pattern = re.compile(rb"(?<![\w$])" + re.escape(self.name.encode()) + rb"(?![\w$])")
        for number in range(node.lineno, node.end_lineno + 1):
            for match in pattern.finditer(self.lines[number - 1]):
                self.mark(number, match.start(), "import")

    visit_ImportFrom = visit_Import


def _marks(name: str, language: str, content: str) -> list[dict]:
    if language != "python":
        return []
    try:
        tree = ast.parse(content)
    except (*REFUSED, *BEYOND):
        return []
    visitor = _Roles(content, name)
    before = sys.getrecursionlimit()
    # The tree was built within the parser's own limit; the visitor needs a few frames a level.
    sys.setrecursionlimit(max(before, 100_000))
    try:
        visitor.visit(tree)
    finally:
        sys.setrecursionlimit(before)
    return visitor.marks


def role_marks(name: str):
    """UDF (language, content) -> syntactic occurrences of ``name`` with roles."""

    @F.pandas_udf(MARKS_TYPE)
    def marks(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for language, content in batches:
            yield pd.Series([_marks(name, a, b) for a, b in zip(language, content)])

    return marks
