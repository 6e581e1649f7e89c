"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

* *Candidates.*  ``BANDS`` keys of ``ROWS`` MinHash values each.  A pair at exactly
  0.8 shares no key with a chance of (1 - 0.8^4)^25, two in a million; less above.
* *Verify.*  Every link is checked on the whole sets of shingles.
* *Large buckets.*  Members of buckets above ``BUCKET`` are first compared with the
  ``NEXT`` that follow in an order of the bucket's own, which joins a large group of
  copies.  Where members of several components are left in a bucket, they are dealt
  anew by ``MORE_BANDS`` keys of ``MORE_ROWS`` further MinHash values (a pair at exactly 0.8
  shares none with a chance of 4 in 100,000; two texts that share half their shingles
  share one with a chance of 0.08, two that share a quarter with 0.0001), and every two members of such a smaller
  bucket that are in different components are compared.  So a bucket of texts that have
  one passage in common falls apart, and no link between components is missed.

Texts of the same words are one node, whatever their number.  A node is the 128-bit hash
of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, written
from .components import connected
from .simhash import fingerprint

WORDS = 5
# The least similarity, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 25, 4
MORE_BANDS, MORE_ROWS = 90, 10
BUCKET, NEXT = 32, 8
# Shingles multiplied at a time: 800 bytes each.
CHUNK = 1 << 13
# Up to so many bytes of wanted texts' hashes are broadcast (8 each), more are joined.
WANTED_BYTES = 2 << 20


def _factors(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_FIRST, _MORE = _factors(5, BANDS * ROWS), _factors(6, MORE_BANDS * MORE_ROWS)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def identity(tokens: list[bytes]) -> bytes:
    """128-bit hash of a text's words."""
    return xxhash.xxh3_128_digest(b" ".join(tokens))


def shingles(tokens: list[bytes], words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than a shingle are one."""
    if not tokens:
        return np.zeros(0, np.uint64)
    tokens, words = (tokens, words) if len(tokens) >= words else ([b" ".join(tokens)], 1)
    found = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64))


def band_keys(hashes: np.ndarray, more: bool = False) -> np.ndarray:
    factors, bands, step = (_MORE, MORE_BANDS, CHUNK // 8) if more else (_FIRST, BANDS, CHUNK)
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), step):
        least = np.minimum(least, (factors[:, None] * hashes[None, i : i + step]).min(axis=1))
    rows = least.reshape(bands, -1)
    return np.array([xxhash.xxh3_64_intdigest(rows[i].tobytes(), i) for i in range(bands)], np.uint64).astype(np.int64)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(x) + len(y) - both) > 0


def _keys(texts: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(id, key), once for each distinct text that has words; with ``wanted`` (id) those
    texts only, and by the further keys.  One text's words are held at a time."""
    chosen = _Wanted(wanted) if wanted is not None else None

    def work(batch: pa.RecordBatch) -> dict:
        keys: dict[bytes, np.ndarray] = {}
        for t in batch.column("text"):
            tokens = words_of(t.as_py() or "")
            if tokens and (i := identity(tokens)) not in keys and (chosen is None or i in chosen):
                keys[i] = band_keys(shingles(tokens), more=chosen is not None)
        return {"id": pa.array(list(keys), pa.binary()), "keys": pa.array(list(keys.values()), pa.list_(pa.int64()))}

    found = by_batch(texts, work, "id binary, keys array<bigint>")
    if wanted is None:
        return found.select("id", F.explode("keys").alias("key")).distinct()
    # The keys of an id are those of its words, the same in every row.
    once = found.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("keys").alias("keys"))
    return once.select("id", F.explode("keys").alias("key"))


class _Wanted:
    """A filter on ids: the first half of each wanted id, sorted, or, where they are more
    than ``WANTED_BYTES``, one that lets all pass; a join with the ids follows in both cases."""

    def __init__(self, wanted: DataFrame):
        bound = WANTED_BYTES // 8
        first = F.conv(F.substring(F.hex("id"), 1, 15), 16, 10).cast("bigint")
        halves = wanted.select(first.alias("half")).limit(bound + 1).toArrow().column(0).to_numpy()
        self.halves = wanted.sparkSession.sparkContext.broadcast(np.sort(halves)) if len(halves) <= bound else None

    def __contains__(self, i: bytes) -> bool:
        if self.halves is None:
            return True
        values, half = self.halves.value, int.from_bytes(i[:8]) >> 4
        at = int(np.searchsorted(values, half))
        return at < len(values) and int(values[at]) == half


def _sets(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, fp, hashes) of the texts in ``pairs``."""
    needed = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "needed")
    chosen = _Wanted(needed)

    def work(batch: pa.RecordBatch) -> dict:
        own = {}
        for text in batch.column("text"):
            tokens = words_of(t := text.as_py() or "")
            if (i := identity(tokens)) not in own and i in chosen:
                own[i] = (fingerprint(t), shingles(tokens).astype(np.int64))
        return {
            "id": pa.array(list(own), pa.binary()), "fp": pa.array([v[0] for v in own.values()], pa.int64()),
            "hashes": pa.array([v[1] for v in own.values()], pa.list_(pa.int64())),
        }

    found = by_batch(texts, work, "id binary, fp bigint, hashes array<bigint>").join(needed, "id", "left_semi")
    return written(found.groupBy("id").agg(F.first("fp").alias("fp"), F.first("hashes").alias("hashes")), "sets")


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, fp_a, fp_b) of the pairs that are similar."""
    pairs = written(pairs.distinct(), "pairs")
    sets = _sets(texts, pairs)
    a = sets.select(F.col("id").alias("a"), F.col("fp").alias("fp_a"), F.col("hashes").alias("x"))
    b = sets.select(F.col("id").alias("b"), F.col("fp").alias("fp_b"), F.col("hashes").alias("y"))

    def work(batch: pa.RecordBatch) -> dict:
        x, y = batch.column("x"), batch.column("y")
        at = [i for i in range(batch.num_rows) if similar(x[i].values.to_numpy(), y[i].values.to_numpy())]
        return {n: batch.column(n).take(pa.array(at, pa.int64())) for n in ("a", "b", "fp_a", "fp_b")}

    return written(by_batch(pairs.join(a, "a").join(b, "b"), work, "a binary, b binary, fp_a bigint, fp_b bigint"), "similar")


def _following(large: DataFrame) -> DataFrame:
    """Pairs of a member and the ``NEXT`` after it in its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = np.zeros(0, np.int64), np.zeros(0, object)
        for batch in batches:
            fresh = len(keys)
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            ids = np.concatenate([ids, np.array(batch.column(1).to_pylist(), object)])
            a, b = [], []
            for step in range(1, NEXT + 1):
                right = np.arange(max(fresh, step), len(keys))
                right = right[keys[right] == keys[right - step]]
                a.append(np.minimum(ids[right], ids[right - step]))
                b.append(np.maximum(ids[right], ids[right - step]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.binary()) for x in (a, b)], names=["a", "b"])
            keys, ids = keys[-NEXT:], ids[-NEXT:]

    order = large.select("key", "id", F.xxhash64("key", "id").alias("at")).repartitionByRange("key", "at").sortWithinPartitions("key", "at")
    return order.select("key", "id").mapInArrow(run, "a binary, b binary")


def links(docs: DataFrame, text: str = "text") -> DataFrame:
    """Links (a, b) between the fingerprints (``simhash.fingerprint``) of near copies:
    every two are joined by a link or a chain of links.  Null texts have none."""
    texts = docs.select(docs[text].alias("text"))
    met = _shared(written(_keys(texts), "bands"))
    pairs = _small_pairs(met)
    large = met.where(F.col("n") > BUCKET).select("key", "id")
    any_large = not large.isEmpty()
    found = _verified(texts, pairs.union(_following(large)) if any_large else pairs)
    if any_large:
        roots = written(connected(found.select("a", "b")).withColumnRenamed("node", "id"), "roots")
        placed = _placed(large, roots)
        apart = placed.groupBy("key").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last").select("key")
        wanted = written(placed.join(apart, "key", "left_semi").select("id").distinct(), "apart")
        if not wanted.isEmpty():
            again = _shared(written(_keys(texts, wanted), "more-bands")).select("key", "id")
            found = found.union(_verified(texts, _cross(_placed(again, roots))))
    return found.select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b")).where("a <> b").distinct()


def _shared(keys: DataFrame) -> DataFrame:
    """(key, id, n): the keys with more than one text, and their number of texts."""
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return written(keys.join(shared, "key"), "met")


def _small_pairs(met: DataFrame) -> DataFrame:
    small = met.where(F.col("n") <= BUCKET).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    later = F.flatten(F.transform("ids", lambda x: F.transform(F.filter("ids", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return small.select(F.explode(later).alias("l")).select("l.a", "l.b")


def _placed(members: DataFrame, roots: DataFrame) -> DataFrame:
    return written(members.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), "placed")


def _cross(placed: DataFrame) -> DataFrame:
    """Pairs of members of one bucket that are in different components.  One side of
    each pair is outside the bucket's largest component, which is never paired with itself."""
    u = placed.select("key", F.col("id").alias("u"), F.col("root").alias("root_u"))
    v = placed.select("key", F.col("id").alias("v"), F.col("root").alias("root_v"))
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1").select("key", F.col("top.root").alias("main"))
    strays = u.join(main, "key").where("root_u <> main")
    both = strays.join(v, "key").where("root_u <> root_v and (root_v = main or u < v)")
    return both.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
