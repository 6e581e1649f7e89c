"""URL filters: host and path rules and globs, simulated at once by a bit-parallel automaton.

A canonical URL is its host (A-Z lower-cased), a separator that no text contains, and
its path.  Every rule is a pattern over such symbols: ``*`` stands for any run that does
not cross the separator, ``?`` for one symbol.  All patterns lie side by side in words of
64 bits: state ``j`` of a pattern is bit ``j`` of its field, active once its first ``j``
symbols are matched.  A symbol ``s`` moves all states of all patterns by

    D = ((D << 1, carried over words) & FITS[s]) | (D & STAYS[s])

where ``FITS[s]`` marks the states that ``s`` leads into and ``STAYS[s]`` those with a
``*`` behind them.  The first state of a field is in no ``FITS``, so a shift never runs
from one pattern into the next, wherever the words end.  A pattern matches if the last
bit of its field is active at the end of the URL.

The masks are the rules' own: their size is (257 symbols) x (bits of all rules), checked
against ``MOST_MASK_BYTES`` before they are sent out.  URLs of a batch run in step, the
longest first, so that ended ones leave the front; ``ROW_WORDS`` bounds the states held.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch

# Symbols: the bytes of UTF-8, and the separator of host and path.
SEPARATOR, SYMBOLS = 256, 257
ALLOW, BLOCK = "allow", "block"
# Words of state held at a time, and the greatest size of all masks together.
ROW_WORDS = 1 << 18
MOST_MASK_BYTES = 64 << 20

# Globs of hosts that are blocked where no rule fits: (host, path).
BLOCKED = (
    ("*casino*", "*"),
    ("*free-bets*", "*"),
    ("*bets.*", "*"),
    ("*cheap-pills*", "*"),
    ("*pharma-????.*", "*"),
    ("*adult-?.*", "*"),
    ("*adult.*", "*"),
    ("*spam-farm*", "*"),
    ("*ads-track*", "*"),
    ("ads.*", "*"),
    ("*.ads.*", "*"),
    ("*", "*/wp-login.php"),
    ("*", "*.exe"),
    ("*", "*/cgi-bin/*"),
)


@dataclass(frozen=True)
class Rule:
    """Allows or blocks a host with its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts_of(url: str | None) -> tuple[str, str]:
    """Host and path: the host stands after the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, the path up to ``?``, ``#`` or the end.  Both are empty without ``://`` (and for null)."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [p for p in (rest.find("?"), rest.find("#")) if p >= 0]
    rest = rest[: min(ends)] if ends else rest
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return host.translate(_LOWER), path


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def symbols_of(host: str, path: str) -> np.ndarray:
    first, second = (np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64) for t in (host, path))
    return np.concatenate((first, [SEPARATOR], second))


class Automaton:
    """The masks of several patterns, each a list of symbols, ``"*"`` and ``"?"``."""

    def __init__(self, patterns: list[list[int | str]]):
        width = sum(1 + sum(s != "*" for s in p) for p in patterns)
        self.words = max(1, -(-width // 64))
        if SYMBOLS * self.words * 16 > MOST_MASK_BYTES:
            raise ValueError("the rules do not fit the bound on masks: apply them in several passes")
        fits, stays = (np.zeros((SYMBOLS, self.words), np.uint64) for _ in range(2))
        start, final, at = np.zeros(self.words, np.uint64), [], 0
        for pattern in patterns:
            start[at // 64] |= _bit(at)
            for s in pattern:
                if s == "*":
                    stays[:SEPARATOR, at // 64] |= _bit(at)
                    continue
                at += 1
                fits[slice(0, SEPARATOR) if s == "?" else s, at // 64] |= _bit(at)
            final.append(at)
            at += 1
        self.fits, self.stays, self.start = fits, stays, start
        self.final = np.array(final, np.int64)

    def run(self, texts: list[np.ndarray]) -> np.ndarray:
        """For each text and pattern whether the whole text matches."""
        out = np.zeros((len(texts), len(self.final)), bool)
        order = np.argsort([-len(t) for t in texts], kind="stable")
        step = max(1, ROW_WORDS // self.words)
        for k in range(0, len(order), step):
            self._run(texts, order[k : k + step], out)
        return out

    def _run(self, texts: list[np.ndarray], rows: np.ndarray, out: np.ndarray) -> None:
        sizes = np.array([len(texts[r]) for r in rows], np.int64)
        flat = np.concatenate([texts[r] for r in rows])
        starts = np.cumsum(sizes) - sizes
        state = np.repeat(self.start[None, :], len(rows), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        for t in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(-sizes, -t, side="left"))  # texts longer than t
            now = state[:n]
            s = flat[starts[:n] + t]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:n] = (moved & self.fits[s]) | (now & self.stays[s])
        out[rows] = (state[:, self.final // 64] >> (self.final % 64).astype(np.uint64)) & one


def _bit(at: int) -> np.uint64:
    return np.uint64(1 << (at % 64))


def _glob(text: str) -> list[int | str]:
    return [x for c in text for x in ([c] if c in "*?" else list(c.encode()))]


def _literal(text: str) -> list[int | str]:
    return list(text.encode())


class Filter:
    """Rules (the longest that fits decides) and, where none fits, globs of blocked URLs.

    Of rules of one length the one with the longer host counts, then the earlier one.
    """

    def __init__(self, rules: list[Rule], blocked: tuple[tuple[str, str], ...] = BLOCKED):
        if bad := [r for r in rules if r.verdict not in (ALLOW, BLOCK)]:
            raise ValueError(f"verdict of {bad[0]} is neither {ALLOW} nor {BLOCK}")
        self.rules = sorted(rules, key=lambda r: (-len(r.name), -len(r.host)))
        patterns: list[list[int | str]] = []
        for r in self.rules:  # the host itself, and every subdomain of it
            tail = [*_literal(r.host), SEPARATOR, *_literal(r.path), "*"]
            patterns += [tail, ["*", ord("."), *tail]]
        patterns += [[*_glob(h), SEPARATOR, *_glob(p)] for h, p in blocked]
        self.automaton = Automaton(patterns)

    def judge(self, parts: list[tuple[str, str]]) -> tuple[list[str | None], list[str], list[str | None]]:
        """Rule, verdict, and the glob's number for each (host, path)."""
        hits = self.automaton.run([symbols_of(*p) for p in parts])
        n = len(self.rules)
        by_rule = hits[:, 0 : 2 * n : 2] | hits[:, 1 : 2 * n : 2]
        by_glob = hits[:, 2 * n :].any(axis=1)
        names: list[str | None] = []
        verdicts: list[str] = []
        for row in range(len(parts)):
            fit = np.flatnonzero(by_rule[row])
            rule = self.rules[fit[0]] if len(fit) else None
            names.append(rule.name if rule else None)
            verdicts.append(rule.verdict if rule else BLOCK if by_glob[row] else ALLOW)
        return names, verdicts, by_glob


def judge(pages: DataFrame, rules: Filter, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, listed) for every row; ``listed`` tells whether a
    glob of blocked URLs matches, whatever the rule says.

    A null or empty URL, or one without ``://``, has an empty host and path; it is judged
    like any other (the globs given here do not match it, so it is allowed).  Whole URLs
    are read, whatever their length.  Null keys and repeated rows stay; an empty table
    gives no rows; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(rules)

    def work(batch: pa.RecordBatch) -> dict:
        parts = list(map(parts_of, batch.column("url").to_pylist()))
        names, verdicts, listed = shared.value.judge(parts)
        text = pa.string()
        return {
            "key": batch.column("key"), "host": pa.array([h for h, _ in parts], text), "path": pa.array([p for _, p in parts], text),
            "rule": pa.array(names, text), "verdict": pa.array(verdicts, text), "listed": pa.array(listed, pa.bool_()),
        }

    kind = pages.schema[key].dataType.simpleString()
    source = pages.select(pages[key].alias("key"), pages[url].alias("url"))
    out = by_batch(source, work, f"key {kind}, host string, path string, rule string, verdict string, listed boolean")
    return out.withColumnRenamed("key", key)
