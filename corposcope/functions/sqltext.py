"""Small helpers for expressions written as Spark SQL text.

Folds and nested lambdas are far shorter as SQL, and the driver parses them in
one call where the Column API makes a round trip for every node.
"""

from __future__ import annotations


def lit(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, evaluated once.

    A column used inside a lambda may be inlined there by the optimizer and
    then computed again for every element.  A one-element transform pins it.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def choose(value: str, mapping: dict, default) -> str:
    arms = " ".join(f"WHEN {lit(str(k))} THEN {v!r}D" if isinstance(v, float) else f"WHEN {lit(str(k))} THEN {v}" for k, v in mapping.items())
    tail = f"{default!r}D" if isinstance(default, float) else str(default)
    return f"CASE {value} {arms} ELSE {tail} END"
