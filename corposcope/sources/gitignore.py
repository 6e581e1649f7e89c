"""Ignore-file patterns compiled to regexes over relative paths."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import EngineError


@dataclass(frozen=True)
class Rule:
    regex: str
    negated: bool
    dir_only: bool


def _segment(text: str) -> str:
    out, i = "", 0
    while i < len(text):
        ch = text[i]
        if ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[" and "]" in text[i + 2:]:
            end = text.index("]", i + 2)
            body = text[i + 1:end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif ch == "\\" and i + 1 < len(text):
            i += 1
            out += re.escape(text[i])
        else:
            out += re.escape(ch)
        i += 1
    return out


def compile_rule(line: str) -> Rule | None:
    """One line of an ignore file; None for blanks and comments."""
    line = line.rstrip("\r\n")
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    dir_only = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    parts = line.lstrip("/").split("/")
    regex = "" if anchored else "(?:.*/)?"
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            regex += ".+" if last else "(?:.*/)?"
        else:
            regex += _segment(part) + ("" if last else "/")
    return Rule(regex, negated, dir_only)


def compile_lines(lines) -> list[Rule]:
    return [rule for rule in map(compile_rule, lines) if rule is not None]


def decide(rules: list[Rule], relative: str, is_dir: bool) -> bool | None:
    """True ignored, False re-included, None undecided; the last match wins."""
    for rule in reversed(rules):
        if (is_dir or not rule.dir_only) and re.fullmatch(rule.regex, relative):
            return not rule.negated
    return None


def check_exclusions(patterns: list[str]) -> list[str]:
    """Workspace exclusions must be non-empty and may not re-include."""
    out = []
    for pattern in patterns:
        normal = pattern.replace("\\", "/")
        if not normal.strip() or normal.startswith("!"):
            raise EngineError("INVALID_EXCLUDE_PATTERN", "exclusions must be non-empty and not re-include", pattern=pattern)
        out.append(normal)
    return out


def exclusion_regex(patterns: list[str]) -> str | None:
    """One regex for file paths that match a pattern or lie below a match."""
    rules = compile_lines(check_exclusions(patterns))
    arms = [r.regex + ("/.*" if r.dir_only else "(?:/.*)?") for r in rules]
    return "^(?:" + "|".join(arms) + ")$" if arms else None
