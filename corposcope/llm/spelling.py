"""Spelling variants: near words by search schemes over a bidirectional FM-index.

Two words are near if they differ by exactly one inserted, deleted or replaced code
point.  An error lies in one half of a word, so the other half is matched exactly:

* *Right scheme.*  ``$`` and the first half are matched, then the match is extended to
  the right over the second half and a closing ``$``, with one error.
* *Left scheme.*  The second half and ``$`` are matched from the right, then the match
  is extended to the left over the first half and an opening ``$``, with one error.
  Words that start with the exact first half are left to the right scheme.

The index holds the delimited vocabulary ``$w0$w1$...$`` and its mirror image.  A match
is a pair of suffix-rank intervals of one size, one in each, and both are kept in step
by counts of the symbols in an interval; a full match ``$word$`` is one rank in the block
of delimiters, which is the number of the word.  All patterns of a batch move together
in numpy.

*Distribution.*  The sorted vocabulary is cut into blocks of bounded size, once in the
order of the words (right scheme) and once in the order of the words read backwards
(left scheme).  The words with a given exact half are a run of that order, so a block of
patterns is paired with the blocks that its runs touch, and with no other: a pair of
blocks is the unit of work, bounded whatever the vocabulary or the most common half is.
Only the ends of the blocks are broadcast, ``MOST_BLOCKS`` and a few at most.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, written

# Words and characters of a block; a larger vocabulary than MOST_BLOCKS of them gets larger blocks.
BLOCK_WORDS, BLOCK_CHARACTERS, MOST_BLOCKS = 16_000, 1 << 19, 20_000
# Patterns that move together.
CHUNK = 2048
# Symbols between two stored counts.
STEP = 64

_LAST = "\U0010ffff"
HEAD, TAIL = "head", "tail"


def cut_at(word: str) -> int:
    """Length of the first half."""
    return len(word) // 2


class _Half:
    """BWT of ``$w0$w1$...$`` for sorted words, with counts at every ``STEP`` symbols.

    ``$`` is symbol 0 and the i-th ``$`` the i-th smallest suffix, as the words are
    sorted.  The symbol before the first ``$`` is ``size``, larger than every other.
    """

    def __init__(self, codes: list[np.ndarray], size: int):
        parts = [np.zeros(1, np.int64)]
        for c in codes:
            parts += [c, np.zeros(1, np.int64)]
        text = np.concatenate(parts)
        n, k = len(text), len(codes)
        rank = text + k
        rank[text == 0] = np.arange(k + 1)
        step, order = 1, np.argsort(rank, kind="stable")
        while True:
            key = rank * (n + k + size + 2)
            key[:-step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            step *= 2
            if fresh[-1] == n - 1 or step >= n:
                break
        bwt = text[order - 1]
        bwt[order == 0] = size
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size + 2))))
        blocks = -(-(n + 1) // STEP)
        padded = np.full(blocks * STEP, size + 1, np.int64)
        padded[:n] = bwt
        counts = np.bincount(np.repeat(np.arange(blocks), STEP) * (size + 2) + padded, minlength=blocks * (size + 2)).reshape(blocks, size + 2)
        self.counts = (np.cumsum(counts, axis=0) - counts).astype(np.int32)
        self.below = (np.cumsum(self.counts, axis=1) - self.counts).astype(np.int32)
        self.symbols = padded.astype(np.uint8 if size + 1 < 256 else np.int32).reshape(blocks, STEP)
        self.size = size

    def ranks(self, symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the first ``at`` symbols equal ``symbol``, and how many are smaller."""
        block, here = at // STEP, np.arange(STEP) < (at % STEP)[:, None]
        near, symbol_ = self.symbols[block], symbol.astype(self.symbols.dtype)[:, None]
        equal = self.counts[block, symbol] + ((near == symbol_) & here).sum(axis=1)
        return equal, self.below[block, symbol] + ((near < symbol_) & here).sum(axis=1)

    def all_ranks(self, at: np.ndarray) -> np.ndarray:
        """Counts of every symbol among the first ``at``."""
        block, width = at // STEP, self.size + 2
        here = np.arange(STEP) < (at % STEP)[:, None]
        cells = np.arange(len(at))[:, None] * width + self.symbols[block]
        return self.counts[block] + np.bincount(cells[here], minlength=len(at) * width).reshape(-1, width)


class Index:
    """Bidirectional FM-index of sorted distinct words."""

    def __init__(self, words: list[str]):
        self.words = words
        letters = sorted(set("".join(words)))
        self.code = {c: i + 1 for i, c in enumerate(letters)}
        # Symbol ``size`` stands before the text, ``size + 1`` nowhere.
        self.size = len(letters) + 1
        self.forward = _Half([self.coded(w) for w in words], self.size)
        self.mirror = _Half([self.coded(w) for w in sorted(w[::-1] for w in words)], self.size)

    def coded(self, word: str) -> np.ndarray:
        return np.array([self.code.get(c, self.size + 1) for c in word], np.int64)

    def _extended(self, right: bool, symbol: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Intervals (rank forward, rank in the mirror, size) of the matches with one more symbol."""
        half, own, other = (self.mirror, 1, 0) if right else (self.forward, 0, 1)
        equal, less = half.ranks(symbol, state[own])
        equal_end, less_end = half.ranks(symbol, state[own] + state[2])
        out = np.empty_like(state)
        out[own] = half.first[symbol] + equal
        out[other] = state[other] + less_end - less
        out[2] = equal_end - equal
        return out

    def _children(self, right: bool, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, symbol, interval) of every letter that extends a match."""
        half, own, other = (self.mirror, 1, 0) if right else (self.forward, 0, 1)
        start = half.all_ranks(state[own])
        found = half.all_ranks(state[own] + state[2]) - start
        rows, symbols = np.nonzero(found[:, 1 : self.size])
        symbols = symbols + 1
        less = np.cumsum(found, axis=1) - found
        out = np.empty((3, len(rows)), np.int64)
        out[own] = half.first[symbols] + start[rows, symbols]
        out[other] = state[other][rows] + less[rows, symbols]
        out[2] = found[rows, symbols]
        return rows, symbols, out

    def near(self, patterns: list[str], scheme: str) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word) numbers of every near word that the scheme finds, each once."""
        found = [self._search(patterns[i : i + CHUNK], scheme, i) for i in range(0, len(patterns), CHUNK)]
        pattern, word = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        if scheme == TAIL:
            left = [not self.words[w].startswith(patterns[p][: cut_at(patterns[p])]) for p, w in zip(pattern.tolist(), word.tolist(), strict=True)]
            pattern, word = pattern[left], word[left]
        return pattern, word

    def _search(self, patterns: list[str], scheme: str, offset: int) -> tuple[np.ndarray, np.ndarray]:
        right = scheme == HEAD
        codes = [self.coded(p if right else p[::-1]) for p in patterns]
        size = np.array([len(c) for c in codes], np.int64)
        exact = np.array([cut_at(p) if right else len(p) - cut_at(p) for p in patterns], np.int64)
        flat = np.concatenate([x for c in codes for x in (c, np.zeros(1, np.int64))])
        start = np.cumsum(size + 1) - (size + 1)
        pattern = np.arange(len(patterns))
        place = np.zeros(len(patterns), np.int64)
        wrong = np.zeros(len(patterns), bool)
        # The match ``$``: every delimiter.
        state = np.zeros((3, len(patterns)), np.int64)
        state[2] = len(self.words) + 1
        hits_pattern, hits_word = [], []
        while len(pattern):
            symbol = flat[start[pattern] + place]
            inside = place < size[pattern]
            branching = np.flatnonzero(~wrong & (place >= exact[pattern]))
            moved = self._extended(right, symbol, state)
            new = [(pattern, place + 1, wrong, moved)]
            if len(branching):
                p, at, s = pattern[branching], place[branching], symbol[branching]
                open_ = inside[branching]
                # The pattern's symbol is left out; of a run of equal ones, the first after the exact half.
                again = (at > exact[p]) & (flat[start[p] + at - 1] == s)
                skip = branching[open_ & ~again]
                new.append((pattern[skip], place[skip] + 1, np.ones(len(skip), bool), state[:, skip]))
                # Another symbol stands in its place, or before it.
                rows, others, child = self._children(right, state[:, branching])
                other = others != s[rows]
                rows, child = rows[other], child[:, other]
                put = open_[rows]
                new.append((p[rows[put]], at[rows[put]] + 1, np.ones(int(put.sum()), bool), child[:, put]))
                new.append((p[rows], at[rows], np.ones(len(rows), bool), child))
            pattern, place, wrong = (np.concatenate([x[k] for x in new]) for k in range(3))
            state = np.concatenate([x[3] for x in new], axis=1)
            alive = state[2] > 0
            ended = alive & (place > size[pattern])
            hit = ended & wrong
            hits_pattern.append(pattern[hit])
            hits_word.append(state[0][hit])
            go = alive & ~ended
            pattern, place, wrong, state = pattern[go], place[go], wrong[go], state[:, go]
        both = np.unique(np.concatenate(hits_pattern) * len(self.words) + np.concatenate(hits_word)) if hits_pattern else np.zeros(0, np.int64)
        return both // len(self.words) + offset, both % len(self.words)


def vocabulary(words: DataFrame, word: str = "word", least: int = 2) -> DataFrame:
    """(word, n) of the distinct words that occur ``least`` times or more; null and '' are none.

    Occurrences are counted before the shuffle, so a very common word is no large group.
    """
    given = words.where((F.col(word) != "")).groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n"))
    return given.where(F.col("n") >= least)


def _blocks(vocab: DataFrame, order: str, most: int) -> DataFrame:
    """(first, last, words, ns): runs of the vocabulary in the order of the words (of the
    words read backwards); the ends and words are as ordered, ``first`` names the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[str] = []
        ns: list[int] = []
        characters = 0

        def block() -> pa.RecordBatch:
            columns = [pa.array([words[0]]), pa.array([words[-1]]), pa.array([words], pa.list_(pa.string())), pa.array([ns], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["first", "last", "words", "ns"])

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if words and (len(words) >= most or characters + len(word) > BLOCK_CHARACTERS):
                    yield block()
                    words, ns, characters = [], [], 0
                words.append(word)
                ns.append(n)
                characters += len(word)
        if words:
            yield block()

    at = F.col("word") if order == HEAD else F.reverse("word")
    ordered = vocab.select(at.alias("at"), "n").repartitionByRange("at").sortWithinPartitions("at")
    return written(ordered.mapInArrow(run, "first string, last string, words array<string>, ns array<bigint>"), f"blocks-{order}")


def _pairs(blocks: DataFrame, order: str) -> DataFrame:
    """(asked, block): the blocks that hold words with the exact half of a word of block ``asked``."""
    # A block has BLOCK_WORDS words or BLOCK_CHARACTERS characters but at the end of a partition.
    ends = blocks.select("first", "last").orderBy("first").collect()
    firsts, lasts = [r["first"] for r in ends], [r["last"] for r in ends]
    shared = blocks.sparkSession.sparkContext.broadcast((firsts, lasts))

    def work(batch: pa.RecordBatch) -> dict:
        firsts, lasts = shared.value
        asked, block = [], []
        for name, words in zip(batch.column("first").to_pylist(), batch.column("words").to_pylist(), strict=True):
            met: set[int] = set()
            for w in words:
                half = w[: cut_at(w)] if order == HEAD else w[: len(w) - cut_at(w)]
                met.update(range(bisect_left(lasts, half), bisect_right(firsts, half + _LAST)))
            asked += [name] * len(met)
            block += [firsts[i] for i in sorted(met)]
        return {"asked": pa.array(asked, pa.string()), "block": pa.array(block, pa.string())}

    return by_batch(blocks.select("first", "words"), work, "asked string, block string")


def _found(vocab: DataFrame, order: str, most: int) -> DataFrame:
    blocks = _blocks(vocab, order, most)
    pairs = written(_pairs(blocks, order), f"pairs-{order}")
    spread = int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = blocks.select(F.col("first").alias("asked"), F.col("words").alias("patterns"))
    rows = pairs.join(asked, "asked").join(blocks.select(F.col("first").alias("block"), "words", "ns"), "block")

    def work(batch: pa.RecordBatch) -> dict:
        out: list[tuple[list[str], list[str], list[int]]] = []
        for i in range(batch.num_rows):
            patterns, words, ns = (batch.column(c)[i].as_py() for c in ("patterns", "words", "ns"))
            if order == TAIL:  # from the order of the words read backwards
                turned = sorted(zip([w[::-1] for w in words], ns, strict=True))
                words, ns = [w for w, _ in turned], [n for _, n in turned]
                patterns = [p[::-1] for p in patterns]
            # Only the patterns whose exact half is in the block.
            low, high = batch.column("words")[i][0].as_py(), batch.column("words")[i][-1].as_py()
            patterns = [p for p in patterns if (h := p[: cut_at(p)] if order == HEAD else p[cut_at(p) :][::-1]) <= high and h + _LAST >= low]
            at, near = Index(words).near(patterns, order)
            out.append(([patterns[k] for k in at], [words[k] for k in near], [ns[k] for k in near]))
        word, near, n = ([x for part in out for x in part[k]] for k in range(3))
        return {"word": pa.array(word, pa.string()), "near": pa.array(near, pa.string()), "near_n": pa.array(n, pa.int64())}

    return by_batch(rows.repartition(spread, "asked", "block"), work, "word string, near string, near_n bigint")


def links(vocab: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of near words of ``vocab`` (word, n), once.

    ``vocab`` has distinct words, none null or empty, and is read more than once (a
    written table).  A vocabulary without words gives no rows.
    """
    total = vocab.count()
    most = max(BLOCK_WORDS, -(-total // MOST_BLOCKS))
    return _found(vocab, HEAD, most).union(_found(vocab, TAIL, most))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word with a form: the end of its chain of forms.

    ``forms`` (word, form) has no circle, as a form occurs more often than its word.  Each
    round doubles the length of the chains followed, so their number is the logarithm of
    the longest, which the counts bound (a form has ``ratio`` times its word's).
    """
    at = written(forms.select("word", F.col("form").alias("root")), "chains")
    for k in range(64):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if at.join(on, "root", "left_semi").isEmpty():
            return at
        at = written(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"chains-{k}")
    raise ValueError("the forms run in a circle")


def variants(vocab: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``vocab`` (word, n).

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if
    that is ``ratio`` times the word's n or more, else null; ``root`` is the last of the
    chain of forms, the word itself if it has none.  Other columns are not read.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    own = written(vocab.select("word", "n"), "vocabulary")
    best = links(own).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    joined = own.join(best, "word", "left")
    form_n = -F.col("best.less")
    common = form_n >= ratio * F.col("n")
    told = joined.select(
        "word", F.when(common, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(common, form_n).alias("form_n"),
    )
    told = written(told, "forms")
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
