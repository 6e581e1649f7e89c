"""Quality rules as a short-circuit cascade.

Each rule rejects or passes a text.  What a rule costs (CPU time) and how often it
rejects (selectivity) is estimated on a bounded sample; the rules then run in the
order of rejections per cost, and the first that rejects ends the work on that
text.  The verdict is the conjunction of all rules, so it does not depend on the
estimates; which rule is named as the rejecting one does.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, texts_of

# White space that separates words, and the characters counted as symbols.
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"

# Rows of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 2000


class Measures:
    """Counts of one text, each made when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines that hold a word."""
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words covered by five-word windows that stand at two or more places."""
        words = self.words
        n = len(words)
        if n < 6:
            return 0
        number = dict(zip(dict.fromkeys(words), range(n), strict=False))
        one = np.fromiter(map(number.__getitem__, words), np.int64, n)
        two = _ranks(one[:-1], one[1:])
        if two.max() == n - 2:  # no pair of words stands twice
            return 0
        four = _ranks(two[:-2], two[2:])
        five = _ranks(four[:-1], one[4:])
        again = np.flatnonzero(np.bincount(five)[five] > 1)
        covered = np.zeros(n, bool)
        for k in range(5):
            covered[again + k] = True
        return int(covered.sum())

    @cached_property
    def shouting(self) -> float:
        """Share of upper-case letters among the letters."""
        letters = sum(map(str.isalpha, self.text))
        return sum(map(str.isupper, self.text)) / letters if letters else 0.0


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of each pair among the distinct pairs, in sorted order."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


BASE = (
    Rule("few_words", lambda m: m.n_words < 10),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 20 * m.n_words),
)
RULES = (
    *BASE,
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 15 * m.n_words),
    Rule("repeated_lines", lambda m: 10 * m.n_dup_lines > 3 * len(m.lines)),
    Rule("shouting", lambda m: m.shouting > 0.5),
)


@dataclass(frozen=True)
class Estimate:
    rule: str
    seconds: float
    rejected: int
    rows: int


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Cost and rejections of each rule alone, on about ``rows`` rows drawn at random (a
    fixed seed), so that copies of one text are in the sample in their share."""
    total = docs.count()
    share = min(1.0, rows / total) if total else 1.0
    # Another draw would shift an estimate, not a verdict.
    drawn = docs.select(docs[text]).sample(share, 7) if share < 1 else docs

    def work(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch, "text")
        spent, rejected = [], []
        for rule in rules:
            began = time.process_time_ns()
            rejected.append(sum(rule.rejects(Measures(t)) for t in texts))
            spent.append(time.process_time_ns() - began)
        names = [r.name for r in rules]
        return {"rule": pa.array(names), "spent": pa.array(spent, pa.int64()), "rejected": pa.array(rejected, pa.int64()), "n": pa.array([len(texts)] * len(names), pa.int64())}

    found = by_batch(drawn.select(F.col(text).alias("text")), work, "rule string, spent bigint, rejected bigint, n bigint")
    sums = found.groupBy("rule").agg(F.sum("spent").alias("s"), F.sum("rejected").alias("r"), F.sum("n").alias("n")).collect()
    by = {row["rule"]: Estimate(row["rule"], row["s"] / 1e9, row["r"], row["n"]) for row in sums}
    return [by.get(r.name, Estimate(r.name, 0.0, 0, 0)) for r in rules]


def order(rules: Sequence[Rule], estimates: Sequence[Estimate]) -> list[Rule]:
    """Most rejections per second first; ties by name."""
    rate = {e.rule: (e.rejected + 0.5) / (e.seconds + 1e-6) for e in estimates}
    return sorted(rules, key=lambda r: (-rate.get(r.name, 0.0), r.name))


def judge(
    docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text",
    measures: Sequence[str] = (), estimates: Sequence[Estimate] | None = None,
) -> DataFrame:
    """(key, *measures, kept, rejected_by) for every row.

    ``measures`` names counts of ``Measures`` to return as well; only those and what
    the rules ask for are made.  A null text counts as empty.  Repeated rows and null
    keys stay; other columns are not read.  An empty table gives no rows.
    """
    ordered = order(rules, estimate(docs, rules, text) if estimates is None else estimates)

    def work(batch: pa.RecordBatch) -> dict:
        found: dict[str, list] = {m: [] for m in (*measures, "rejected_by")}
        for t in texts_of(batch, "text"):
            m = Measures(t)
            found["rejected_by"].append(next((r.name for r in ordered if r.rejects(m)), None))
            for name in measures:
                found[name].append(int(getattr(m, name)))
        out = {k: pa.array(v, pa.int64()) for k, v in found.items() if k != "rejected_by"}
        named = found["rejected_by"]
        return out | {"key": batch.column("key"), "rejected_by": pa.array(named, pa.string()), "kept": pa.array([x is None for x in named])}

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, " + "".join(f"{m} bigint, " for m in measures) + "kept boolean, rejected_by string"
    return by_batch(docs.select(docs[key].alias("key"), docs[text].alias("text")), work, schema).withColumnRenamed("key", key)
