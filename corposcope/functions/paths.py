"""Path expressions: language, document type, exclusion, scope, grouping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, col, java_quote

# File extensions by language.
LANGUAGE_EXTENSIONS = {
    "python": ["py", "pyi"],
    "typescript": ["ts"],
    "tsx": ["tsx"],
    "javascript": ["js", "mjs", "cjs", "jsx"],
    "rust": ["rs"],
    "go": ["go"],
    "java": ["java"],
    "csharp": ["cs"],
    "c": ["c", "h"],
    "cpp": ["cc", "cpp", "cxx", "hpp", "hh"],
    "json": ["json"],
    "markdown": ["md", "markdown"],
    "html": ["html", "htm"],
    "yaml": ["yaml", "yml"],
    "toml": ["toml"],
    "log": ["log"],
}

# Document classes by path segment, basename and suffix.
INSTRUCTION_NAMES = ["agents.md", "claude.md"]
TEST_SEGMENTS = ["test", "tests", "__tests__"]
TEST_SUFFIXES = [
    "_test.rs", ".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx",
    ".test.js", ".spec.js", ".test.jsx", ".spec.jsx",
]
EVIDENCE_SEGMENTS = ["evidence", "runtime"]
EVIDENCE_SUFFIXES = [".json", ".log"]
ARTIFACT_SEGMENTS = ["artifact", "artifacts", "fixture", "fixtures", "recording", "recordings"]
ARTIFACT_SUFFIXES = [
    ".recording.json", ".fixture.json", ".fixtures.json", ".artifact.json", ".artifacts.json",
]

# Directory names never indexed; the last is this engine's own.
EXCLUDED_COMPONENTS = [
    ".git", "node_modules", "target", "dist", "build", ".next", ".venv", "venv",
    ".corposcope-cache",
]
EXCLUDED_PREFIXES = ["target-", "target_"]
TEMP_MARKER = ".corposcope-"


def extension(path: Column | str) -> Column:
    """Last extension in ASCII lower case; a leading dot alone is none."""
    return ascii_lower(F.regexp_extract(col(path), r"[^/]\.([^./]*)$", 1))


def language(path: Column | str) -> Column:
    ext = extension(path)
    out = None
    for name, extensions in LANGUAGE_EXTENSIONS.items():
        test = ext.isin(extensions)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("text")


def _segment(names: list[str]) -> str:
    return "(?:^|/)(?:" + "|".join(java_quote(n) for n in names) + ")(?:/|$)"


def _suffix(names: list[str]) -> str:
    return "(?:" + "|".join(java_quote(n) for n in names) + ")$"


def document_type(path: Column | str) -> Column:
    p = ascii_lower(path)

    def has(pattern: str) -> Column:
        return F.rlike(p, F.lit(pattern))

    basename_test = r"(?:^|/)test_[^/]*$"
    return (
        F.when(has("(?:^|/)(?:" + "|".join(map(java_quote, INSTRUCTION_NAMES)) + ")$"), "instruction")
        .when(has(f"{_segment(TEST_SEGMENTS)}|{basename_test}|{_suffix(TEST_SUFFIXES)}"), "test")
        .when(has(_segment(EVIDENCE_SEGMENTS)) & has(_suffix(EVIDENCE_SUFFIXES)), "runtime_evidence")
        .when(has(f"{_segment(ARTIFACT_SEGMENTS)}|{_suffix(ARTIFACT_SUFFIXES)}"), "artifact")
        .when(p.endswith(".log"), "log")
        .otherwise("source")
    )


def _component_pattern() -> str:
    names = "|".join(java_quote(n) for n in EXCLUDED_COMPONENTS)
    prefixes = "|".join(java_quote(n) + "[^/]*" for n in EXCLUDED_PREFIXES)
    return f"(?:^|/)(?:{names}|{prefixes})(?:/|$)"


def is_excluded_dir(path: Column | str) -> Column:
    """Some component of the path names an excluded directory."""
    return F.rlike(F.replace(col(path), F.lit("\\"), F.lit("/")), F.lit(_component_pattern()))


def is_excluded(path: Column | str) -> Column:
    """An excluded component, or the name of a temporary file."""
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    marker = java_quote(TEMP_MARKER) + "[^/]*$"
    return F.rlike(p, F.lit(f"{_component_pattern()}|{marker}"))


def normalize_path(path: str) -> str:
    path = path.replace("\\", "/")
    while path.startswith("./"):
        path = path[2:]
    return path


def in_scope(path: Column | str, filters: list[str] | None) -> Column:
    """OR over path filters; a trailing slash means raw prefix, none means all.

    Equality and StartsWith reach a parquet scan as pushed filters when
    ``path`` is stored.
    """
    p = col(path)
    out = None
    for item in filter(None, (normalize_path(f) for f in filters or [])):
        if item.endswith("/"):
            test = p.startswith(item)
        else:
            test = (p == item) | p.startswith(item + "/")
        out = test if out is None else out | test
    return F.lit(True) if out is None else out


def scope_size(filters: list[str] | None) -> int:
    return sum(1 for f in filters or [] if normalize_path(f))


def dirname(path: Column | str) -> Column:
    p = col(path)
    return F.when(F.contains(p, F.lit("/")), F.regexp_extract(p, r"^(.*)/", 1)).otherwise(".")


def change_group(path: Column | str) -> Column:
    """(root) for a bare name, its directory for two parts, else the first two."""
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    p = F.trim(F.regexp_replace(p, "/+", "/"), F.lit("/"))
    slashes = F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))
    return (
        F.when(slashes == 0, "(root)")
        .when(slashes == 1, F.substring_index(p, "/", 1))
        .otherwise(F.substring_index(p, "/", 2))
    )


def ancestors(path: Column | str) -> Column:
    """The path and each directory above it (``a/b/c`` -> a, a/b, a/b/c)."""
    parts = F.split(col(path), "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )


def in_reference_scope(scope: str, path: Column | str, doc_type: Column) -> Column:
    if scope in ("", "all"):
        return F.lit(True)
    if scope == "tests":
        return doc_type == "test"
    if scope == "production":
        p = col(path)
        return (doc_type == "source") & ~p.startswith("docs/") & ~p.startswith("examples/")
    return F.lit(False)


def is_relative(path: Column | str) -> Column:
    """No absolute path, no parent component."""
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    return ~p.startswith("/") & ~F.rlike(p, F.lit(r"(?:^|/)\.\.(?:/|$)"))
