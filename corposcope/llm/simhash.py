"""SimHash near-duplicates by the generalised pigeonhole principle.

A 64-bit fingerprint is cut into ``m`` partitions of bits, and partition ``i``
gets a threshold ``t_i`` with ``sum(t_i) = bits - m + 1`` (-1 leaves it out).  Two
fingerprints that differ in at most ``bits`` places then agree up to ``t_i`` in
some partition ``i``: were all above, the difference would be at least
``sum(t_i + 1) = bits + 1``.

* *Partitions.*  The co-occurrence of all bits over all distinct fingerprints is
  summed in Spark (64 x 64 numbers); correlated bits go into one partition, so
  the partitions are as independent of each other as they can be.
* *Thresholds.*  For each partition and threshold the number of candidate pairs
  is estimated from the same counts (bits as a chain, each given the one before);
  dynamic programming shares out the thresholds at the least probes and candidates,
  and the cheapest ``m`` is taken.  The choice moves cost only: any allocation finds
  every pair.
* *Probe and verify.*  Fingerprints that share a key of a partition form a
  bucket.  Buckets of at most ``BUCKET`` fingerprints are compared pair by pair.
  Members of larger buckets instead write every key within ``bits / 2`` flips of
  the whole fingerprint: two of them share such a key exactly if they differ in at
  most ``bits`` places, and no key is shared by more distinct fingerprints than
  the ball has points.  So every link between different fingerprints is in the
  result, directly or through a common key, without pairing off a large group.

Equal fingerprints are one node, whatever their number.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, texts_of, written
from .components import connected

WIDTH = 64
# Buckets up to this size are compared pair by pair, larger ones by shared keys.
BUCKET = 32
# Shingles whose bits are counted at a time: 64 bytes each.
CHUNK = 1 << 15


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint.  Words are split at ASCII white space after
    lower-casing A-Z; a text of fewer words than a shingle is one shingle; without
    words it is 0.  Repeats of a shingle count as often as they stand."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        tokens, words = [b" ".join(tokens)], 1
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)) if words > 1 else iter(tokens)
    digest = xxhash.xxh64_intdigest
    total, ones = 0, np.zeros(WIDTH, np.int64)
    while chunk := [digest(s, seed) for s in islice(shingles, CHUNK)]:
        bits = np.unpackbits(np.array(chunk, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
        total += len(chunk)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp) for every row; a null text counts as empty."""

    def work(batch: pa.RecordBatch) -> dict:
        return {"key": batch.column("key"), "fp": pa.array([fingerprint(t, words, seed) for t in texts_of(batch, "text")], pa.int64())}

    kind = docs.schema[key].dataType.simpleString()
    return by_batch(docs.select(docs[key].alias("key"), docs[text].alias("text")), work, f"key {kind}, fp bigint").withColumnRenamed("key", key)


@dataclass(frozen=True)
class Plan:
    """``parts[i]`` are the bits of partition i, ``limits[i]`` its threshold."""

    parts: tuple[tuple[int, ...], ...]
    limits: tuple[int, ...]
    cost: float


def bit_counts(codes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each two bits, how many have both."""

    def run(batches):
        both, n = np.zeros((WIDTH, WIDTH)), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(values)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(WIDTH * WIDTH + 1), pa.int64()), pa.array(np.append(both.ravel(), n).astype(np.int64))], names=["cell", "n"]
            )

    rows = codes.select("fp").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(WIDTH * WIDTH + 1)
    for row in rows:
        flat[row["cell"]] = row["n"]
    return int(flat[-1]), flat[:-1].reshape(WIDTH, WIDTH)


def _agreement(n: int, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For two fingerprints drawn at random: the chance that bit b agrees, and
    that bits b and c both agree."""
    p = np.diag(both) / max(n, 1)
    p11 = both / max(n, 1)
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    p00 = 1 - p11 - p10 - p01
    return p**2 + (1 - p) ** 2, p11**2 + p10**2 + p01**2 + p00**2


def partitions(m: int, n: int, both: np.ndarray) -> tuple[tuple[int, ...], ...]:
    """``m`` groups of bits of nearly equal width, each grown by the bit that is
    most correlated with those in it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    left, parts = list(range(WIDTH)), []
    for i in range(m):
        size = len(left) // (m - i)
        at = max(left, key=lambda b: (tie[b, left].sum(), -b))
        group = [at]
        left.remove(at)
        while len(group) < size:
            at = max(left, key=lambda b: (tie[b, group].mean(), -b))
            group.append(at)
            left.remove(at)
        parts.append(tuple(group))
    return tuple(parts)


def within(part: tuple[int, ...], limit: int, alone: np.ndarray, pair: np.ndarray) -> float:
    """Chance that two fingerprints differ in at most ``limit`` bits of ``part``."""
    if limit < 0:
        return 0.0
    b = part[0]
    agree, differ = np.zeros(limit + 1), np.zeros(limit + 1)
    agree[0] = alone[b]
    if limit:
        differ[1] = 1 - alone[b]
    for b, c in zip(part, part[1:], strict=False):
        stay = pair[b, c] / max(alone[b], 1e-12)  # c agrees given that b does
        turn = (alone[c] - pair[b, c]) / max(1 - alone[b], 1e-12)
        to_agree = agree * stay + differ * turn
        to_differ = agree * (1 - stay) + differ * (1 - turn)
        agree, differ = to_agree, np.append(0, to_differ[:-1])
    return float(np.clip(agree.sum() + differ.sum(), 0, 1))


def _keys_per(width: int, limit: int) -> float:
    return {-1: 0, 0: 1, 1: 1 + width / 2, 2: 1 + width}.get(limit, float("inf"))


def allocate(parts: tuple[tuple[int, ...], ...], bits: int, n: int, both: np.ndarray) -> Plan:
    """Thresholds of the partitions by dynamic programming over their sum."""
    alone, pair = _agreement(n, both)
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for part in parts:
        grown: dict[int, tuple[float, tuple[int, ...]]] = {}
        for limit in range(-1, min(bits, 2) + 1):
            cost = n * _keys_per(len(part), limit) + n * n / 2 * within(part, limit, alone, pair)
            for used, (spent, chosen) in best.items():
                if used + limit not in grown or spent + cost < grown[used + limit][0]:
                    grown[used + limit] = (spent + cost, (*chosen, limit))
        best = grown
    cost, limits = best.get(bits - len(parts) + 1, (float("inf"), ()))
    return Plan(parts, limits, cost)


def plan(n: int, both: np.ndarray, bits: int) -> Plan:
    options = (allocate(partitions(m, n, both), bits, n, both) for m in range(1, bits + 3))
    return min(options, key=lambda p: p.cost)


def _gather(part: tuple[int, ...]) -> Column:
    mask = sum(1 << b for b in part)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << WIDTH) if mask >> (WIDTH - 1) else mask))


def _bit(b: int) -> Column:
    return F.lit(-(1 << 63) if b == 63 else 1 << b)


def _flip(value: Column, bits: tuple[int, ...]) -> Column:
    for b in bits:
        value = value.bitwiseXOR(_bit(b))
    return value


def _bucket_keys(chosen: Plan) -> Column:
    """Array of (partition, key) of one fingerprint.

    With threshold 1 a fingerprint writes its value and the value with each one set
    bit cleared: of two values one bit apart, one has that bit.  With threshold 2
    it writes its value and each single flip: two values two bits apart meet half way.
    """
    keys: list[Column] = []
    for i, (part, limit) in enumerate(zip(chosen.parts, chosen.limits, strict=True)):
        if limit < 0:
            continue
        value = _gather(part)
        own = [value]
        if limit == 1:
            own += [F.when(value.bitwiseAND(_bit(b)) != 0, _flip(value, (b,))) for b in part]
        elif limit == 2:
            own += [_flip(value, (b,)) for b in part]
        keys += [F.when(k.isNotNull(), F.struct(F.lit(i).alias("part"), k.alias("key"))) for k in own]
    return F.filter(F.array(*keys), lambda k: k.isNotNull())


def links(codes: DataFrame, bits: int = 2) -> DataFrame:
    """Links (a, b) among the distinct fingerprints ``codes.fp``: every two within
    ``bits`` (0, 2 or 4) differing bits are joined by a link or by a chain of links."""
    if bits not in (0, 2, 4):
        raise ValueError("bits must be 0, 2 or 4")
    spark = codes.sparkSession
    if bits == 0:
        return spark.createDataFrame([], "a bigint, b bigint")
    n, both = bit_counts(codes)
    chosen = plan(n, both, bits)
    keys = codes.select("fp", F.explode(_bucket_keys(chosen)).alias("k")).select("fp", "k.part", "k.key")
    shared = keys.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keys.join(shared, ["part", "key"]), "met")

    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= bits
    small = met.where(F.col("n") <= BUCKET).groupBy("part", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    later = F.flatten(F.transform("fps", lambda x: F.transform(F.filter("fps", lambda y: (y > x) & near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = small.select(F.explode(later).alias("l")).select("l.a", "l.b")

    flips = [f for r in range(bits // 2 + 1) for f in combinations(range(WIDTH), r)]
    large = met.where(F.col("n") > BUCKET).select("fp").distinct()
    # A key has at most len(flips) fingerprints, so the list is bounded.
    balls = large.select("fp", F.explode(F.array(*(_flip(F.col("fp"), f) for f in flips))).alias("key"))
    stars = balls.groupBy("key").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select("a", F.explode("fps").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, bits: int = 2, seed: int = 42, more: DataFrame | None = None) -> DataFrame:
    """(key, fp, component_id) for every row: component_id is the smallest key that
    is reached over links.  ``more`` are further links (a, b) between fingerprints.

    Texts are read whole.  Texts without words (null, empty) have fingerprint 0 and
    are linked like any other.  Repeated rows stay, each with its component.  Null
    keys are in their component but never name it, unless no other key is there
    (then it is null).  Other columns of ``docs`` are not read.
    """
    own = written(fingerprints(docs, key, text, words, seed).withColumnRenamed(key, "key"), "fingerprints")
    codes = written(own.groupBy("fp").agg(F.min("key").alias("least")), "codes")
    near = links(codes, bits)
    roots = connected(near if more is None else near.union(more)).withColumnRenamed("node", "fp")
    named = codes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp").select(F.col("key").alias(key), "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
