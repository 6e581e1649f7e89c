"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of every n-gram (1 to 3 characters, hashed to ``BUCKETS``) by language are
summed in Spark over all training rows.  The matrix of log probabilities has
``BUCKETS`` x languages numbers, whatever the input, and is broadcast; a task sums
the rows of a text's n-grams with numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, texts_of

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
UNDETERMINED = "und"
# More languages than this are refused: the matrix is sent to every executor.
MOST_LANGUAGES = 500
# Characters that are hashed at a time, so that memory does not grow with a text.
CHUNK = 1 << 16

_kept: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Which code points are letters; made once per worker."""
    if "letters" not in _kept:
        _kept["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _kept["letters"]


def ngrams(text: str):
    """Bucket numbers of the n-grams of a text, in pieces.

    The text is lower-cased; every run of other characters than letters is one
    space, and one stands at both ends.  Pieces overlap, so each n-gram occurs once.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_letters()[codes], codes, 32)
    codes = np.concatenate(([32], codes, [32])).astype(np.uint64)
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    for at in range(0, len(codes), CHUNK):
        piece = codes[at : at + CHUNK + max(ORDERS) - 1]
        found, state = [], np.zeros(len(piece), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if len(piece) < n:
                break
            state = (state[: len(piece) - n + 1] + piece[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            state = state ^ (state >> np.uint64(29))
            if n in ORDERS:
                found.append((state[: CHUNK if at + CHUNK < len(codes) else None] >> np.uint64(7)) % np.uint64(BUCKETS))
        yield np.concatenate(found).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prior: np.ndarray
    """Log share of each language among the training rows."""
    table: np.ndarray
    """Log probability by bucket and language."""


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts over all ``rows`` whose language is not null and whose text has a letter."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(texts_of(batch, "text"), batch.column("lang").to_pylist(), strict=True):
                if has_letter(t):
                    own = counts.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    own[BUCKETS] += 1
                    for piece in ngrams(t):
                        own[:BUCKETS] += np.bincount(piece, minlength=BUCKETS)
        for name, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], names=["lang", "cell", "n"])

    known = rows.select(rows[text].alias("text"), rows[lang].alias("lang")).where("lang is not null and text is not null")
    sums = known.mapInArrow(run, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    # One row for each language: its cells fit a row whatever the input.
    found = sums.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells")).limit(MOST_LANGUAGES + 1).toArrow()
    if found.num_rows > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = found.column("lang").to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    counts = np.zeros((BUCKETS + 1, len(names)))
    for k, i in enumerate(order):
        cells = found.column("cells")[i].values
        counts[cells.field("cell").to_numpy(), k] = cells.field("n").to_numpy()
    docs, grams = counts[BUCKETS], counts[:BUCKETS] + 1.0
    prior = np.log(docs / docs.sum()) if len(names) else np.zeros(0)
    return Model(tuple(names[i] for i in order), prior, np.log(grams / grams.sum(0)))


def score(model: Model, text: str) -> tuple[str, float]:
    """The likeliest language and its posterior; ties go to the first by name."""
    if not model.languages or not has_letter(text):
        return UNDETERMINED, 0.0
    total = model.prior.copy()
    for piece in ngrams(text):
        total += model.table[piece].sum(0)
    k = int(total.argmax())
    return model.languages[k], float(1 / np.exp(total - total[k]).sum())


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(key, *extra, lang_pred, score) for every row.

    Whole texts are read.  A text that is null or has no letter is ``und`` with
    score 0, and so is every text if nothing was learned.  Repeated rows and null
    keys stay; other columns are not read unless named in ``extra``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = extra or {}

    def work(batch: pa.RecordBatch) -> dict:
        found = [score(shared.value, t) for t in texts_of(batch, "__text")]
        out = dict(zip(batch.schema.names, batch.columns, strict=True))
        return out | {"lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64())}

    source = docs.select(docs[key].alias(key), *(c.alias(n) for n, c in extra.items()), docs[text].alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__text")
    return by_batch(source, work, f"{fields}, lang_pred string, score double")
