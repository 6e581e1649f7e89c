"""Recurring lines by a log-template tree of fixed depth.

A line goes down the tree by its token count, then by its leading tokens; a token
with a digit is a variable there and further on.  In a leaf the remaining tokens
form up to ``FIELDS`` runs.  The line stands for these templates:

* all its fields as they are, and
* for lines of ``GENERAL`` tokens or more, each with one field generalised.

Two lines of a leaf that differ in one field only share the template that leaves
it open, however many values the field has.  A template that occurs in enough
documents is recurring, and its lines are dropped from every document but the
first (the smallest key), so that no text vanishes from the corpus and a copied
document stays whole once.

Templates are hashed to 128 bits and counted with a combine before the shuffle; only
hashes, keys and line numbers are shuffled, and the texts once, to drop the lines.

With ``passages`` lines of 1 or 2 tokens are templates too, as they are, and a line
shorter than ``LONG`` that stands in two documents is dropped where a dropped line is
next to it, or a run of such lines that touches one; blank lines do not count.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, texts_of, written

FIELDS = 4
GENERAL = 6
# Lines with fewer tokens are never templates: they recur by chance.
LEAST_TOKENS = 3
# A line of LONG tokens recurs from LONG_DOCS documents on, a shorter one from SHORT_DOCS on.
LONG, LONG_DOCS, SHORT_DOCS = 8, 2, 10
# With ``passages`` a line of 1 or 2 tokens and so many characters (Chinese, base64) counts as LONG.
LONG_CHARACTERS = 20

_DIGIT = re.compile(rb"[0-9]")


def templates_of(line: bytes) -> list[bytes]:
    """The templates of a line, spelled out: the exact one first; [] for a line that is none."""
    tokens = line.split()
    n = len(tokens)
    if n < LEAST_TOKENS:
        return []
    if _DIGIT.search(line):
        tokens = [b"<*>" if _DIGIT.search(t) else t for t in tokens]
    lead = min(3, n // 3)
    path = b"%d\x1e%b" % (n, b"\x1f".join(tokens[:lead]))
    rest = tokens[lead:]
    parts = min(FIELDS, len(rest))
    fields = [b"\x1f".join(rest[len(rest) * i // parts : len(rest) * (i + 1) // parts]) for i in range(parts)]
    out = [b"\x1e".join((path, *fields))]
    if n >= GENERAL:
        out += [b"\x1e".join((path, *fields[:i], b"<*>", *fields[i + 1 :])) for i in range(parts)]
    return out


def _leasts(line: bytes, found: list[bytes], passages: bool) -> tuple[list[bytes], list[int]]:
    """The templates of a line and the documents that make each recurring; below zero if
    two documents do next to a dropped line."""
    tokens = line.split()
    if not passages:
        return found, [LONG_DOCS if len(tokens) >= LONG else SHORT_DOCS] * len(found)
    if not tokens:
        return [], []
    if not found:
        characters = sum(len(t.decode("utf-8", "surrogatepass")) for t in tokens)
        return [b"\x1d" + b"\x1f".join(tokens)], [LONG_DOCS if characters >= LONG_CHARACTERS else -SHORT_DOCS]
    if len(tokens) >= LONG:
        return found, [LONG_DOCS] * len(found)
    return found, [-SHORT_DOCS] + [SHORT_DOCS] * (len(found) - 1)


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", passages: bool = False) -> DataFrame:
    """(hi, lo, key, at, least) for every template of every line: ``at`` holds the line's
    number (from bit 32), its number without blank lines (from bit 1) and whether it is
    the template's first in the document; ``least`` as in ``_leasts``."""

    def work(batch: pa.RecordBatch) -> dict:
        rows, lines, hashes, firsts, least = [], [], [], [], []
        for row, t in enumerate(texts_of(batch, "text")):
            seen: set[bytes] = set()
            order = 0
            for number, line in enumerate(t.encode("utf-8", "surrogatepass").split(b"\n")):
                order += bool(line.strip())
                for template, most in zip(*_leasts(line, templates_of(line), passages), strict=True):
                    digest = xxhash.xxh3_128_digest(template)
                    rows.append(row)
                    lines.append(number << 32 | order << 1)
                    hashes.append(digest)
                    firsts.append(digest not in seen)
                    seen.add(digest)
                    least.append(most)
        pairs = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
        return {
            "hi": pa.array(pairs[:, 0]), "lo": pa.array(pairs[:, 1]), "key": batch.column("key").take(pa.array(rows, pa.int64())),
            "at": pa.array(np.array(lines, np.int64) + np.array(firsts, bool)), "least": pa.array(least, pa.int32()),
        }

    kind = docs.schema[key].dataType.simpleString()
    return by_batch(docs.select(docs[key].alias("key"), docs[text].alias("text")), work, f"hi bigint, lo bigint, key {kind}, at bigint, least int")


def recurring(found: DataFrame) -> DataFrame:
    """(hi, lo, n_docs, first_key, sure) of the templates in enough documents; those that
    are not ``sure`` are so only next to a dropped line."""
    sums = found.groupBy("hi", "lo").agg(F.sum(F.col("at").bitwiseAND(F.lit(1))).alias("n_docs"), F.min("key").alias("first_key"), F.min("least").alias("least"))
    return sums.where("n_docs >= if(least < 0, 2, least)").withColumn("sure", F.expr("n_docs >= abs(least)")).drop("least")


def _whole_runs(marks: DataFrame) -> DataFrame:
    """(key, __lines) from (key, marks): the sure lines, and the runs of others that touch one."""

    def work(batch: pa.RecordBatch) -> dict:
        out = []
        for own in batch.column("marks").to_pylist():
            sure: dict[int, list] = {}
            for m in own:
                sure.setdefault(m["at"] & 0xFFFFFFFE, [m["at"] >> 32, False])[1] |= m["sure"]
            gone, run, before = [], [], None
            for order in [*sorted(sure), None]:
                if run and (order is None or order != before + 2):
                    gone += [line for line, _ in run] if any(s for _, s in run) else []
                    run = []
                if order is not None:
                    run.append(sure[order])
                before = order
            out.append(gone)
        return {"key": batch.column("key"), "__lines": pa.array(out, pa.list_(pa.int32()))}

    return by_batch(marks, work, f"key {marks.schema['key'].dataType.simpleString()}, __lines array<int>")


def drop_recurring(docs: DataFrame, key: str = "doc_id", text: str = "text", counts: bool = False, passages: bool = False) -> DataFrame:
    """``docs`` with recurring lines dropped from ``text``; with ``counts`` also
    ``n_lines`` and ``n_dropped``.

    A document stays even if all its lines go (its text is then ''); a null text
    stays null.  Rows with one key are one document: repeated rows stay and keep or
    lose the same lines.  Rows with a null key count as documents but lose nothing.
    Lines are split at \\n only; blank lines are never dropped, lines of 1 or 2 tokens only
    with ``passages``.
    All other columns stay as they are.
    """
    # Read twice: the templates are made once.
    found = written(occurrences(docs, key, text, passages), "templates")
    later = found.join(recurring(found), ["hi", "lo"]).where(F.col("key") > F.col("first_key"))
    if passages:
        drops = _whole_runs(later.groupBy("key").agg(F.collect_list(F.struct("at", "sure")).alias("marks")))
    else:
        drops = later.groupBy("key").agg(F.collect_set(F.shiftright("at", 32).cast("int")).alias("__lines"))
    drops = drops.withColumnRenamed("key", "__key")
    joined = docs.join(drops, docs[key] == drops["__key"], "left").drop("__key")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("__lines", i)), "\n")
    out = joined.withColumn("__kept", F.when(F.col("__lines").isNull(), F.col(text)).otherwise(kept))
    names = [F.col("__kept").alias(c) if c == text else F.col(c) for c in docs.columns]
    if counts:
        n = F.coalesce(F.size(lines), F.lit(0)).cast("long")
        gone = F.coalesce(F.size("__lines"), F.lit(0)).cast("long")
        names += [F.greatest(n, F.lit(0)).alias("n_lines"), F.greatest(gone, F.lit(0)).alias("n_dropped")]
    return out.select(*names)
