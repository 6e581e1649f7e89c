"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts are taken as labelled; every other text is unlabelled,
a mixture in which toxic texts have the class prior ``pi``.  With ``l`` the logistic
loss, a linear classifier ``g`` over the presence of words and word stems minimises

    pi * E_P[l(g)]  +  max(0, E_U[l(-g)] - pi * E_P[l(-g)])

The second term estimates the risk on clean texts; where a batch makes it negative
(the classifier has begun to learn the sample by heart) the step goes back up on it.

The fit uses a bounded sample (``POSITIVES`` toxic and ``UNLABELLED`` other rows, drawn
by hash over the whole input); the prior is counted over all labelled rows.  Scoring
reads every text whole.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, texts_of, written

POSITIVES = 4000
UNLABELLED = 12000
# Words with the clearest excess among toxic texts.
WORDS = 1024
# Standard errors that the excess of a word must have.
LEAST_EXCESS = 3.0
# Share of a word's unlabelled texts that must be toxic by the prior: pi * P(word | toxic) / P(word).
LEAST_PRECISION = 0.7
# Letters of a stem.
STEM = 4
EPOCHS, BATCHES, RATE, DECAY = 300, 8, 0.05, 1e-4

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """Words in lower case, and the stems of the longer ones: compounds of an insult
    share its first letters."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:STEM] + "-" for w in words if len(w) > STEM}


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    prior: float

    def score(self, text: str) -> float:
        z = self.bias
        if self.weights:
            # In one order, so that equal texts have equal scores.
            z += math.fsum(map(self.weights.__getitem__, words_of(text) & self.weights.keys()))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _drawn(rows: DataFrame, key: str, most: int, total: int) -> DataFrame:
    """All rows, or those of about ``most`` by hash of the key (of the whole row where it has
    none), each in place, without a shuffle."""
    if total <= most:
        return rows
    share = int(most / total * (1 << 40)) + 1
    drawn = F.when(F.col(key).isNull(), F.xxhash64(*rows.columns, F.lit(11))).otherwise(F.xxhash64(F.col(key), F.lit(11)))
    return rows.where(F.pmod(drawn, F.lit(1 << 40)) < share)


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str) -> tuple[DataFrame, float]:
    """(positive, text) rows and the class prior.

    A key with several labels counts as toxic if any of them says so.
    """
    known = labels.groupBy(key).agg(F.max("toxic").alias("toxic"))
    n_toxic, n_known = known.select(F.count(F.when(F.col("toxic") == 1, 1)), F.count("toxic")).first()
    total = docs.count()
    toxic = _drawn(known.where("toxic = 1").select(key), key, POSITIVES, n_toxic)
    source = docs.select(docs[key].alias(key), docs[text].alias("text"))
    # About POSITIVES keys, whatever the number of labels.
    positive = source.join(F.broadcast(toxic), key).select(F.lit(True).alias("positive"), "text")
    unlabelled = _drawn(source, key, UNLABELLED, total).select(F.lit(False).alias("positive"), "text")
    return written(positive.union(unlabelled), "sample"), n_toxic / n_known if n_known else 0.0


def _vocabulary(rows: DataFrame, n_p: int, n_u: int, prior: float) -> list[str]:
    """Words that are clearly more frequent in toxic texts, and mostly toxic where they stand."""

    def run(batches):
        for batch in batches:
            found: dict[str, list[int]] = {}
            for t, positive in zip(texts_of(batch, "text"), batch.column("positive").to_pylist(), strict=True):
                for w in words_of(t):
                    found.setdefault(w, [0, 0])[positive] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array([v[1] for v in found.values()], pa.int64()), pa.array([v[0] for v in found.values()], pa.int64())],
                names=["word", "p", "u"],
            )

    counts = rows.mapInArrow(run, "word string, p bigint, u bigint").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    a, b = F.col("p") / n_p, F.col("u") / n_u
    spread = F.sqrt((a * (1 - a) + 1.0 / n_p) / n_p + (b * (1 - b) + 1.0 / n_u) / n_u)
    top = counts.where("p >= 5").select("word", ((a - b) / spread).alias("excess"), (prior * a / (b + 1.0 / n_u)).alias("precision"))
    top = top.where((F.col("excess") >= LEAST_EXCESS) & (F.col("precision") >= LEAST_PRECISION))
    return [r["word"] for r in top.orderBy(F.desc("excess"), "word").limit(WORDS).collect()]


def _presence(rows: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    at = {w: i for i, w in enumerate(vocabulary)}

    def work(batch: pa.RecordBatch) -> dict:
        found = [sorted(at[w] for w in words_of(t) & at.keys()) for t in texts_of(batch, "text")]
        return {"positive": batch.column("positive"), "at": pa.array(found, pa.list_(pa.int32()))}

    # The driver gets the sample's known words only, in an order that no task decides.
    got = by_batch(rows, work, "positive boolean, at array<int>").toArrow()
    lists = sorted(zip(got.column("positive").to_pylist(), map(tuple, got.column("at").to_pylist()), strict=True))
    x = np.zeros((len(lists), len(vocabulary)), np.float32)
    for i, (_, own) in enumerate(lists):
        x[i, list(own)] = 1
    positive = np.array([p for p, _ in lists], bool)
    return x[positive], x[~positive]


def train(x_p: np.ndarray, x_u: np.ndarray, prior: float, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over mini-batches of the non-negative risk."""
    rng = np.random.default_rng(seed)
    k = x_p.shape[1]
    theta, m, v, step = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1), 0
    theta[k] = math.log(prior / (1 - prior))
    add = lambda x: np.hstack([x, np.ones((len(x), 1), np.float32)])
    x_p, x_u = add(x_p), add(x_u)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    softplus = lambda z: np.logaddexp(0, z)
    for _ in range(EPOCHS):
        for p_at, u_at in zip(np.array_split(rng.permutation(len(x_p)), BATCHES), np.array_split(rng.permutation(len(x_u)), BATCHES), strict=True):
            if not len(p_at) or not len(u_at):
                continue
            p, u = x_p[p_at], x_u[u_at]
            g_p, g_u = p @ theta, u @ theta
            clean_risk = softplus(g_u).mean() - prior * softplus(g_p).mean()
            clean_slope = u.T @ sigmoid(g_u) / len(u) - prior * (p.T @ sigmoid(g_p)) / len(p)
            toxic_slope = prior * (p.T @ -sigmoid(-g_p)) / len(p)
            slope = toxic_slope + clean_slope if clean_risk >= 0 else -clean_slope
            slope[:k] += DECAY * theta[:k]
            step += 1
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:k], float(theta[k])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """``labels`` (key, toxic): rows with toxic = 1 are the confirmed texts.  Rows of
    ``docs`` need no label.  Null labels and null keys count for nothing.  Without a
    toxic or an unlabelled row the model gives every text the prior."""
    rows, prior = sample(docs, labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull()), key, text)
    n = {r["positive"]: r["n"] for r in rows.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if not n.get(True) or not n.get(False):
        return Model({}, -500.0, prior)
    prior = min(max(prior, 1e-4), 0.5)
    vocabulary = _vocabulary(rows, n[True], n[False], prior)
    weights, bias = train(*_presence(rows, vocabulary), prior)
    return Model(dict(zip(vocabulary, map(float, weights), strict=True)), bias, prior)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(key, *extra, score, predicted) for every row; predicted is 1 from score 0.5 on.

    Whole texts are read; null counts as empty.  Repeated rows and null keys stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = extra or {}

    def work(batch: pa.RecordBatch) -> dict:
        scores = [shared.value.score(t) for t in texts_of(batch, "__text")]
        out = dict(zip(batch.schema.names, batch.columns, strict=True))
        return out | {"score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32())}

    source = docs.select(docs[key].alias(key), *(c.alias(n) for n, c in extra.items()), docs[text].alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__text")
    return by_batch(source, work, f"{fields}, score double, predicted int")


def scored(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The score as a column, for filtering ``docs`` in place."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(shared.value.score).astype("float64")

    return score(docs[text])
