"""Benchmark decontamination: BM25 over the test items, block-max WAND, exact check.

The test items are indexed, and every passage of every training text is a query.
A passage is a run of twice as many words as the longest item, every next one
starts half a passage later, so a copy of any item lies whole in some passage.
The threshold of an item is a lower bound of the score that the check below leaves
possible.  A term of which more shingles hang than may be missing must be there; of the
others the missing ones have at most ``SHINGLE`` times as many places in shingles as
shingles may be missing, so no more weight can be missing than the fractional knapsack
over (weight, shingles of the term) holds.  Also, one shingle at least is there with all its
terms.  The greater of both bounds is positive for every item.  Impacts are BM25 weights
divided by it, so "above threshold" is 1 for all items, and retrieval loses no item.  All posting
lists are cut at the same item numbers into blocks; the block maxima of all passages
of a text are summed at once with numpy, and only where a block's sum reaches 1 does
WAND run over the postings of that block, with the block maxima as its bounds.  So
every item at 1 or more is returned.  A hit counts if the passage holds at least
``OVERLAP`` of the five-word shingles of the item's question and of its answer.

Items are taken in shards of bounded size.  A task builds the index of a shard from the
shard's items, and writes it as a row of a table; one shard at a time is then loaded and
sent to the executors for a pass over the texts, and taken back before the next.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, texts_of, written

K1, B = 1.2, 0.75
OVERLAP = 0.8
SHINGLE = 5
# Items of a block, or more where a shard would have more than MOST_BLOCKS.
BLOCK, MOST_BLOCKS = 8, 64
# Bounds of a shard of the index: the table of block maxima has one row for each term.
SHARD_ITEMS, SHARD_BYTES = 20_000, 4 << 20
# Passages whose block maxima are summed at a time.
CHUNK = 2048
# For sums of single-precision maxima.
SLACK = 1 - 1e-4

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def split_item(words: list[str]) -> tuple[list[str], list[str]]:
    """Question and answer of an item without a separate answer: the answer is its
    last third, with the words that its first shingles need before it.  If that leaves
    the question less than a shingle, the whole item is the question."""
    cut = len(words) - len(words) // 3
    return (words[:cut], words[cut - SHINGLE + 1 :]) if cut >= SHINGLE else (words, [])


def shingles(words: list[str], width: int = SHINGLE) -> set[tuple[str, ...]]:
    """Distinct shingles; fewer words than a shingle are one."""
    if not words:
        return set()
    return set(zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else {tuple(words)}


def overlap(part: set[tuple[str, ...]], words: list[str]) -> float:
    """Share of the shingles of a part (all of one width) that stand in ``words``; 1 if it has none."""
    return len(part & shingles(words, len(next(iter(part))))) / len(part) if part else 1.0


def least_score(weights: dict[str, float], parts: tuple[set[tuple[str, ...]], ...]) -> float:
    """The least sum of weights of an item's terms in a passage that holds ``OVERLAP`` of
    the shingles of each part."""
    places: dict[str, int] = dict.fromkeys(weights, 0)
    spare, bound = 0, 0.0
    needed: set[str] = set()
    for part in parts:
        missing = len(part) - math.ceil(OVERLAP * len(part) - 1e-9)
        spare += missing
        own: dict[str, int] = {}
        for shingle in part:
            for term in set(shingle):
                own[term] = own.get(term, 0) + 1
        for term, n in own.items():
            places[term] += n
            if n > missing:
                needed.add(term)
        bound = max(bound, min((math.fsum(weights[t] for t in set(s)) for s in part), default=0.0))
    room, gone = SHINGLE * spare, 0.0
    for term in sorted((t for t in weights if t not in needed and places[t]), key=lambda t: -weights[t] / places[t]):
        share = min(1.0, room / places[term])
        gone += share * weights[term]
        room -= share * places[term]
        if share < 1:
            break
    # Words that stand in no shingle of either part may be missing in any number.
    gone += math.fsum(w for t, w in weights.items() if not places[t])
    return max(bound, math.fsum(weights.values()) - gone)


class Index:
    """Inverted index with impacts, their maximum per term, and per block of items."""

    def __init__(self, items: list[tuple[object, list[str], list[str], list[str]]], frequency: dict[str, int], total: int, mean: float):
        """``items``: (id, question words, answer words, all words).  ``frequency`` is the
        number of items with a term, ``total`` and ``mean`` the number and mean length of all items."""
        self.ids = [i for i, _, _, _ in items]
        self.parts = [(shingles(q), shingles(a)) for _, q, a, _ in items]
        whole = [w for _, _, _, w in items]
        self.span = max(map(len, whole), default=0)
        postings: dict[str, list[tuple[int, float]]] = {}
        # The score of each item with itself, in thresholds.
        self.own: list[float] = []
        for at, words in enumerate(whole):
            weights = {}
            for term in dict.fromkeys(words):
                n, tf = frequency.get(term, 1), words.count(term)
                idf = math.log(1 + (total - n + 0.5) / (n + 0.5))
                weights[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            total_weight = sum(weights.values())
            limit = least_score(weights, self.parts[at])
            self.own.append(total_weight / limit)
            for term, weight in weights.items():
                postings.setdefault(term, []).append((at, weight / limit))
        self.terms = {t: k for k, t in enumerate(postings)}
        self.block = max(BLOCK, -(-len(items) // MOST_BLOCKS))
        # Per term and block: the items, and their impacts.
        self.lists: list[dict[int, tuple[list[int], list[float]]]] = []
        self.most = np.zeros((len(postings), -(-len(items) // self.block)), np.float32)
        for t, own in enumerate(postings.values()):
            cut: dict[int, tuple[list[int], list[float]]] = {}
            for at, w in own:
                inside, impacts = cut.setdefault(at // self.block, ([], []))
                inside.append(at)
                impacts.append(w)
                self.most[t, at // self.block] = max(self.most[t, at // self.block], w)
            self.lists.append(cut)

    def search(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """(item, score) of every item of the block whose impacts over the distinct
        ``terms`` sum to 1 or more: WAND, each list bounded by its maximum in the block."""
        found = []
        # (next item, place in the list, items, impacts, bound)
        lists = [[own[0][0], 0, *own, float(self.most[t, block])] for t in terms if (own := self.lists[t].get(block))]
        while lists:
            lists.sort(key=lambda x: x[0])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x[4]
                if bound >= SLACK:
                    pivot = k
                    break
            if pivot < 0:
                break
            at = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == at:
                pivot += 1
            if lists[0][0] == at:
                score = sum(x[3][x[1]] for x in lists[: pivot + 1])
                if score >= 1 - 1e-9:
                    found.append((at, score))
                at += 1
            for k in range(pivot, -1, -1):
                x = lists[k]
                if x[0] < at:
                    x[1] = bisect_left(x[2], at, x[1])
                    if x[1] < len(x[2]):
                        x[0] = x[2][x[1]]
                    else:
                        del lists[k]
        return found

    def passages(self, words: list[str]):
        """(start, distinct known terms, block) wherever a block can reach the threshold in a passage."""
        get = self.terms.get
        known = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        at = np.flatnonzero(known >= 0)
        if not len(at):
            return
        terms, half, n = known[at], max(self.span, 1), len(self.terms)
        last = max(0, -(-len(words) // half) - 2)  # passages 0..last cover all words
        own = at // half
        cells = np.unique(np.concatenate((own * n + terms, (own - 1) * n + terms)))
        windows, terms = cells // n, cells % n
        live = (windows >= 0) & (windows <= last)
        windows, terms = windows[live], terms[live]
        if not len(windows):
            return
        starts = np.flatnonzero(np.concatenate(([True], windows[1:] != windows[:-1])))
        for k in range(0, len(starts), CHUNK):  # so that memory does not grow with a text
            first, end = starts[k], starts[k + CHUNK] if k + CHUNK < len(starts) else len(windows)
            bounds = np.add.reduceat(self.most[terms[first:end]], starts[k : k + CHUNK] - first, axis=0)
            for row, block in np.argwhere(bounds >= SLACK).tolist():
                a = starts[k + row]
                b = starts[k + row + 1] if k + row + 1 < len(starts) else len(windows)
                yield int(windows[a]) * half, terms[a:b].tolist(), block

    def hits(self, text: str) -> list[tuple[object, float, float, float, int]]:
        """(item id, score, question overlap, answer overlap, first word of the passage):
        the best passage of each item that passes the check."""
        words = words_of(text)
        best: dict[int, tuple[float, float, float, int]] = {}
        for start, terms, block in self.passages(words):
            passage = words[start : start + 2 * self.span]
            for at, score in self.search(terms, block):
                question, answer = (overlap(p, passage) for p in self.parts[at])
                if min(question, answer) >= OVERLAP:
                    row = (score / self.own[at], question, answer, -start)
                    if at not in best or (row[1] + row[2], *row) > (best[at][1] + best[at][2], *best[at]):
                        best[at] = row
        return [(self.ids[at], s, q, a, -start) for at, (s, q, a, start) in sorted(best.items())]


def _items(items: DataFrame, key: str, question: str, answer: str | None) -> DataFrame:
    """(item, uid, question words, answer words, all words) of the distinct items with a word."""

    def work(batch: pa.RecordBatch) -> dict:
        questions, answers = ([words_of(t) for t in texts_of(batch, c)] for c in ("question", "answer"))
        words = [q + a for q, a in zip(questions, answers, strict=True)]
        if not answer:
            questions, answers = zip(*map(split_item, questions), strict=True)
        kind = pa.list_(pa.string())
        return {"item": batch.column("item"), "question": pa.array(questions, kind), "answer": pa.array(answers, kind), "words": pa.array(words, kind)}

    source = items.select(items[key].alias("item"), F.col(question).alias("question"), (F.col(answer) if answer else F.lit("")).alias("answer")).distinct()
    kind = items.schema[key].dataType.simpleString()
    rows = by_batch(source, work, f"item {kind}, question array<string>, answer array<string>, words array<string>").where("size(words) > 0")
    name = F.concat_ws("\x1f", F.col("item").cast("string"), F.array_join("question", " "), F.lit("\x1e"), F.array_join("answer", " "))
    return rows.withColumn("uid", F.concat(F.md5(name.cast("binary")), F.col("item").isNull().cast("string")))


@dataclass(frozen=True)
class Shards:
    """A table (shard, index): the pickled ``Index`` of each shard."""

    table: DataFrame
    kind: str
    count: int

    def __len__(self) -> int:
        return self.count

    @contextmanager
    def sent(self, shard: int) -> Iterator[Broadcast]:
        """One shard on all executors, as bytes; it is taken back at the end."""
        rows = self.table.where(F.col("shard") == shard).select("index").collect()
        shared = self.table.sparkSession.sparkContext.broadcast(_Loaded(bytes(rows[0]["index"]) if rows else None))
        try:
            yield shared
        finally:
            shared.unpersist(blocking=False)


class _Loaded:
    """An index, unpickled where it is first asked for."""

    def __init__(self, data: bytes | None):
        self.data = data
        self.index: Index | None = None

    def __getstate__(self) -> dict:
        return {"data": self.data, "index": None}

    def hits(self, text: str) -> list[tuple]:
        if self.data is not None:
            self.index, self.data = pickle.loads(self.data), None
        return self.index.hits(text) if self.index else []


def indexes(items: DataFrame, key: str = "item_id", question: str = "text", answer: str | None = None) -> Shards:
    """The index in shards of about ``SHARD_ITEMS`` items and ``SHARD_BYTES`` of words at most
    (one item at least).

    Ids are of any type.  Two items with one id are two items, and so are those without
    one; rows that are equal in id and text are one.  Items without a word are left out.
    Document frequencies and the mean length are those of all items.
    """
    kind = items.schema[key].dataType.simpleString()
    rows = written(_items(items, key, question, answer), "items")
    total, mean, size = rows.select(F.count("*"), F.avg(F.size("words")), F.sum(F.length(F.array_join("words", " ")))).first()
    shards = max(-(-total // SHARD_ITEMS), -(-(size or 0) // SHARD_BYTES))
    mine = rows.select("uid", F.explode(F.array_distinct("words")).alias("term"))
    frequency = mine.groupBy("term").agg(F.count("*").alias("n"))
    # A common term meets each item that has it; the pairs of an item are as many as its words.
    counted = mine.join(frequency, "term").groupBy("uid").agg(F.collect_list(F.struct("term", "n")).alias("terms"))
    placed = rows.join(counted, "uid").withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(max(shards, 1))).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("uid")
        known = {t["term"]: t["n"] for own in group.column("terms").to_pylist() for t in own}
        index = Index(list(zip(*(group.column(c).to_pylist() for c in ("item", "question", "answer", "words")), strict=True)), known, total, mean)
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "index": pa.array([pickle.dumps(index, 5)], pa.binary())})

    table = placed.groupBy("shard").applyInArrow(build, "shard int, index binary")
    return Shards(written(table, "indexes"), kind, shards)


def matches(docs: DataFrame, found: Shards, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, score, question_overlap, answer_overlap, passage_start): one row
    per text and item found in it.

    Whole texts are searched; null counts as empty and matches nothing, so does a
    text that has no word.  ``score`` is the share of the item's own score.  Repeated
    rows and null keys give their own rows; an item without an id gives rows with a null
    item_id; without items there are none.  The rows found in a shard are written before
    the next is loaded.
    """
    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, item_id {found.kind}, score double, question_overlap double, answer_overlap double, passage_start bigint"
    item = found.table.sparkSession.createDataFrame([], schema)
    item_type = item.select("item_id").toArrow().schema.field(0).type

    def scan(shared: Broadcast) -> DataFrame:
        def work(batch: pa.RecordBatch) -> dict:
            rows, hits = [], []
            for row, t in enumerate(texts_of(batch, "text")):
                own = shared.value.hits(t)
                rows += [row] * len(own)
                hits += own
            columns = list(zip(*hits, strict=True)) or [[]] * 5
            return {
                "key": batch.column("key").take(pa.array(rows, pa.int64())), "item_id": pa.array(columns[0], item_type),
                **{n: pa.array(c, pa.float64()) for n, c in zip(("score", "question_overlap", "answer_overlap"), columns[1:4], strict=True)},
                "passage_start": pa.array(columns[4], pa.int64()),
            }

        return by_batch(source, work, schema)

    parts = []
    for shard in range(len(found)):
        with found.sent(shard) as shared:
            parts.append(written(scan(shared), f"matches-{shard}"))
    return (reduce(DataFrame.union, parts) if parts else item).withColumnRenamed("key", key)


def without(docs: DataFrame, found: Shards, text: str = "text") -> DataFrame:
    """``docs`` less the rows whose text holds an item; all columns stay as they are.
    Each shard's pass is written before the next is loaded."""
    for shard in range(len(found)):
        with found.sent(shard) as shared:
            docs = written(docs.where(~_holds(shared)(docs[text])), f"without-{shard}")
    return docs


def _holds(shared: Broadcast):
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: bool(shared.value.hits(t))).astype(bool)

    return holds
