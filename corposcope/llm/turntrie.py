"""Prefix trie of conversations, as balanced parentheses per shard.

A conversation is the sequence of its turns, each written as 16 bytes (the digest of
role and text), so sequences compare as bytes and equal ones are one row with a count.

*Shard.*  The distinct sequences are sorted and cut into runs of bounded size.  Walking a
run, every turn beyond the common prefix with the sequence before opens a node and every
turn left behind closes one, which writes the trie in preorder as balanced parentheses.
On the excess (opened less closed) lies a tree of block minima and maxima:

* ``findclose`` of a node finds the end of its subtree;
* the leaf pairs ``()`` up to both ends, by rank, count its leaves;
* cumulative arrays over the preorder give its members and its savings.

*Spines.*  The only nodes that two shards can share lie on the paths of a shard's first
and last sequence.  All other nodes are final.  The two paths go on, with what the
finished subtrees beside them add up to, as sequences of the next round, where the
shares of one node meet.  A shard has at least ``LEAST_SEQUENCES`` sequences, so a round
leaves a small part of them, until one shard holds all; how many turns or conversations
a common prefix has makes no difference.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

DIGEST = 16
# A shard ends with this many turns, but not before it has LEAST_SEQUENCES sequences.
SHARD_TURNS, LEAST_SEQUENCES = 1 << 17, 64
# A round of no more sequences and turns is one shard.
LAST_SEQUENCES, LAST_TURNS = 1 << 12, 1 << 20
# Parentheses of a block of the range min-max tree.
BLOCK = 64
# Conversation ids joined to one row before they are hashed.
IDS = 4096

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_PER_NODE = ("members", "leaves", "saved", "children")
_SEQUENCE = "key binary, sizes array<bigint>, members array<bigint>, leaves array<bigint>, saved array<bigint>, children array<bigint>, least array<bigint>, ends array<string>"
_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_NONE = np.iinfo(np.int64).max


class Parentheses:
    """Balanced parentheses with block minima and maxima of the excess in a tree."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        n = len(opens)
        blocks = max(1, -(-n // BLOCK))
        self.leaves = 1 << (blocks - 1).bit_length()
        excess = np.zeros(self.leaves * BLOCK, np.int64)
        excess[:n] = np.cumsum(np.where(opens, 1, -1))
        self.excess = excess.reshape(self.leaves, BLOCK)
        self.length = n
        # Beyond the end nothing is found.
        inside = np.arange(self.leaves * BLOCK).reshape(self.leaves, BLOCK) < n
        self.low = np.concatenate((np.zeros(self.leaves, np.int64), np.where(inside, self.excess, _NONE).min(axis=1)))
        self.high = np.concatenate((np.zeros(self.leaves, np.int64), np.where(inside, self.excess, -1).max(axis=1)))
        for i in range(self.leaves - 1, 0, -1):
            self.low[i] = min(self.low[2 * i], self.low[2 * i + 1])
            self.high[i] = max(self.high[2 * i], self.high[2 * i + 1])

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The closing partner of each opening parenthesis."""
        out = np.empty(len(at), np.int64)
        for i in range(0, len(at), 1 << 13):
            out[i : i + (1 << 13)] = self._find_close(at[i : i + (1 << 13)])
        return out

    def _find_close(self, at: np.ndarray) -> np.ndarray:
        block, place = at // BLOCK, at % BLOCK
        goal = self.excess[block, place] - 1
        place_in = self._first(block, goal, place)
        out = block * BLOCK + place_in
        far = np.flatnonzero(place_in < 0)
        if len(far):
            node, goal = block[far] + self.leaves, goal[far]
            up = np.ones(len(far), bool)
            while up.any():  # to the next subtree on the right that holds the goal
                i = np.flatnonzero(up)
                right = node[i] + 1
                fits = (node[i] % 2 == 0) & (self.low[right % len(self.low)] <= goal[i]) & (self.high[right % len(self.low)] >= goal[i])
                node[i] = np.where(fits, right, node[i] // 2)
                up[i[fits]] = False
            while (down := node < self.leaves).any():
                i = np.flatnonzero(down)
                child = 2 * node[i]
                node[i] = np.where((self.low[child] <= goal[i]) & (self.high[child] >= goal[i]), child, child + 1)
            block = node - self.leaves
            out[far] = block * BLOCK + self._first(block, goal, np.full(len(far), -1))
        return out

    def _first(self, block: np.ndarray, goal: np.ndarray, after: np.ndarray) -> np.ndarray:
        """First place behind ``after`` in each block with the excess ``goal``; -1 if none."""
        hit = (self.excess[block] == goal[:, None]) & (np.arange(BLOCK) > after[:, None]) & (block[:, None] * BLOCK + np.arange(BLOCK) < self.length)
        return np.where(hit.any(axis=1), hit.argmax(axis=1), -1)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero((a[:n] != b[:n]).any(axis=1))
    return int(differ[0]) if len(differ) else n


class Shard:
    """The trie of sorted distinct sequences.  ``rows``: dicts of the columns of ``_SEQUENCE``."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        keys = [np.frombuffer(r["key"], np.uint64).reshape(-1, 2) for r in rows]
        sizes = [len(k) for k in keys]
        shared = [0] + [_common(a, b) for a, b in zip(keys, keys[1:], strict=False)]
        runs, path_at, total = [sizes[0] + 1], 0, 1 + sizes[0]
        for i in range(1, len(rows)):
            runs += [sizes[i - 1] - shared[i], sizes[i] - shared[i]]
            total += sizes[i] - shared[i]
        runs.append(sizes[-1] + 1)
        opens = np.repeat(np.arange(len(runs)) % 2 == 0, runs)
        self.depth, self.tokens, self.parent = (np.zeros(total, np.int64) for _ in range(3))
        self.own = {c: np.zeros(total, np.int64) for c in _PER_NODE}
        self.least = np.full(total, _NONE)
        self.ends: dict[int, str] = {}
        # A sequence through each node, for its last turn.
        self.source = np.zeros(total, np.int64)
        path = np.zeros(max(sizes) + 1, np.int64)
        self.parent[0], path_at = -1, 1
        for i, row in enumerate(rows):
            a, b = shared[i] + 1, sizes[i] + 1
            fresh = np.arange(path_at, path_at + b - a)
            path[a:b], path_at = fresh, path_at + b - a
            self.parent[fresh] = path[a - 1 : b - 1]
            self.depth[fresh] = np.arange(a, b)
            self.source[fresh] = i
            self.tokens[fresh] = row["sizes"][a - 1 :]
            here = path[:b]
            for c in _PER_NODE:
                self.own[c][here] += row[c]
            self.least[here] = np.minimum(self.least[here], row["least"])
            self.ends.update((int(n), e) for n, e in zip(here, row["ends"], strict=True) if e is not None)
            if i == 0:
                self.first_path = here.copy()
        self.last_path = path[: sizes[-1] + 1].copy()

        at = np.flatnonzero(opens)
        close = Parentheses(opens).find_close(at)
        self.end = np.arange(total) + (close - at + 1) // 2  # of the subtree, in preorder
        pair = opens & ~np.append(opens[1:], True) & True
        pair[at[self.own["children"] > 0]] = False  # its children are finished, not missing
        rank = np.concatenate(([0], np.cumsum(pair)))
        self.n_children = self.own["children"] + np.bincount(self.parent[1:], minlength=total)
        self.n_leaves = rank[close] - rank[at] + self._within(self.own["leaves"])
        self.n_convs = self._within(self.own["members"])
        self.saved = self._within(self.own["saved"] + (self.n_convs - 1) * self.tokens)
        for d in range(int(self.depth.max()), 0, -1):
            level = self._at_depth(d)
            np.minimum.at(self.least, self.parent[level], self.least[level])

    def _within(self, values: np.ndarray) -> np.ndarray:
        """Sum over each subtree."""
        sums = np.concatenate(([0], np.cumsum(values)))
        return sums[self.end] - sums[: len(values)]

    def _at_depth(self, d: int) -> np.ndarray:
        if not hasattr(self, "_levels"):
            order = np.argsort(self.depth, kind="stable")
            self._levels = np.split(order, np.cumsum(np.bincount(self.depth))[:-1])
        return self._levels[d]

    def digests(self, nodes: np.ndarray) -> dict[int, bytes]:
        """Names of nodes that are given with all nodes above them, parents first."""
        out = {-1: b""}
        for n, p, d, i in zip(nodes.tolist(), self.parent[nodes].tolist(), self.depth[nodes].tolist(), self.source[nodes].tolist(), strict=True):
            out[n] = xxhash.xxh3_128_digest(out[p] + self.rows[i]["key"][DIGEST * (d - 1) : DIGEST * d]) if d else b"root"
        return out

    def nodes(self, last: bool, named: bool) -> tuple[dict[str, pa.Array], np.ndarray]:
        """The final nodes; those below a spine tell their parent's digest, not its id."""
        spine = np.zeros(len(self.depth), bool)
        if not last:
            spine[self.first_path] = spine[self.last_path] = True
        at = np.flatnonzero(~spine)
        parent = self.parent[at]
        open_ = (parent >= 0) & spine[parent]
        known = self.least[parent]
        digests = self.digests(np.arange(len(self.depth)) if named else np.flatnonzero(spine))
        columns = {
            "conv_id": pa.array(self.least[at]), "depth": pa.array(self.depth[at]), "parent_conv_id": pa.array(known, mask=open_ | (parent < 0)),
            "n_convs": pa.array(self.n_convs[at]), "n_children": pa.array(self.n_children[at]), "n_leaves": pa.array(self.n_leaves[at]),
            "saved_tokens": pa.array(self.saved[at]), "ends_sha256": pa.array([self.ends.get(n, EMPTY_SHA) for n in at.tolist()]),
            "parent": pa.array([digests[p] if o else None for p, o in zip(parent.tolist(), open_.tolist(), strict=True)], pa.binary()),
            "node": pa.array([digests[n] for n in at.tolist()] if named else [None] * len(at), pa.binary()),
        }
        return columns, at

    def spines(self) -> list[dict]:
        """The first and the last path, each node's own values in one of them."""
        spine = np.zeros(len(self.depth), bool)
        spine[self.first_path] = spine[self.last_path] = True
        beside = np.flatnonzero(~spine)
        beside = beside[spine[self.parent[beside]]]
        totals = {"members": self.n_convs, "leaves": self.n_leaves, "saved": self.saved, "children": np.ones(len(self.depth), np.int64)}
        own = {c: v.copy() for c, v in self.own.items()}
        for c in _PER_NODE:
            np.add.at(own[c], self.parent[beside], totals[c][beside])
        out = []
        both = [(self.rows[0], self.first_path, 0)]
        if len(self.rows) > 1:
            shared = int((self.first_path[: len(self.last_path)] == self.last_path[: len(self.first_path)]).sum())
            both.append((self.rows[-1], self.last_path, shared))
        for row, path, shared in both:
            fresh = np.arange(len(path)) >= shared
            out.append(
                {"key": row["key"], "sizes": row["sizes"], "least": self.least[path]}
                | {c: np.where(fresh, own[c][path], 0) for c in _PER_NODE}
                | {"ends": [self.ends.get(int(n)) if f else None for n, f in zip(path, fresh, strict=True)]}
            )
        return out


_SCHEMA = f"{_NODE}, parent binary, node binary, {_SEQUENCE}"
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    numbers = ("sizes", *_PER_NODE, "least")
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in numbers}
        yield row | {c: batch.column(c)[i].as_py() for c in ("key", "ends")}


def _round(sequences: DataFrame, last: bool, named: bool, shards: int) -> DataFrame:
    """Final nodes (key null) and sequences of the next round (key set) of every shard."""
    types = {"key": pa.binary(), "ends": pa.list_(pa.string())}

    def finish(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        shard = Shard(rows)
        columns, at = shard.nodes(last, named)
        blank = {c: pa.nulls(len(at), types.get(c, pa.list_(pa.int64()))) for c in _COLUMNS[10:]}
        yield from pa.Table.from_pydict({**columns, **blank}).select(_COLUMNS).to_batches(max_chunksize=1 << 14)
        if not last:
            more = shard.spines()
            blank = {c: pa.nulls(len(more), pa.string() if c == "ends_sha256" else pa.binary() if c in ("parent", "node") else pa.int64()) for c in _COLUMNS[:10]}
            filled = {c: pa.array([r[c] for r in more], types.get(c, pa.list_(pa.int64()))) for c in _COLUMNS[10:]}
            yield pa.RecordBatch.from_pydict({c: {**blank, **filled}[c] for c in _COLUMNS})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        turns = 0
        for batch in batches:
            for row in _rows(batch):
                if rows and not last and turns >= SHARD_TURNS and len(rows) >= LEAST_SEQUENCES:
                    yield from finish(rows)
                    rows, turns = [], 0
                rows.append(row)
                turns += len(row["key"]) // DIGEST
        if rows:
            yield from finish(rows)

    dealt = sequences.coalesce(1) if last else sequences.repartitionByRange(shards, "key")
    return dealt.sortWithinPartitions("key").mapInArrow(run, _SCHEMA)


def _ends(sequences: DataFrame) -> DataFrame:
    """(id, members, least, sha) of the sequences' conversations; the hash is of their ids
    in order, comma-joined: first as rows of up to ``IDS`` of them, then over these."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids = None, []

        def row() -> pa.RecordBatch:
            text = ",".join(map(str, ids))
            return pa.RecordBatch.from_pydict({"id": pa.array([name], pa.binary()), "first": pa.array([ids[0]], pa.int64()), "n": pa.array([len(ids)], pa.int64()), "text": pa.array([text])})

        for batch in batches:
            for key, conv in zip(batch.column("id").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (key != name or len(ids) >= IDS):
                    yield row()
                    ids = []
                name = key
                ids.append(conv)
        if ids:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, found, n, first = None, hashlib.sha256(), 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"id": pa.array([name], pa.binary()), "members": pa.array([n], pa.int64()), "least": pa.array([first], pa.int64()), "sha": pa.array([found.hexdigest()])})

        for batch in batches:
            for r in batch.to_pylist():
                if r["id"] != name:
                    if name is not None:
                        yield row()
                    name, found, n, first = r["id"], hashlib.sha256(), 0, r["first"]
                elif n:
                    found.update(b",")
                found.update(r["text"].encode())
                n += r["n"]
        if name is not None:
            yield row()

    ordered = sequences.select("id", "conv_id").repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id")
    rows = ordered.mapInArrow(join, "id binary, first bigint, n bigint, text string")
    return rows.repartition("id").sortWithinPartitions("id", "first").mapInArrow(digest, "id binary, members bigint, least bigint, sha string")


def sequences(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as structs (digest, size).

    Null role or text is ''.  Turns are ordered by ``turn``, null first; those of one
    number by the digest of role and text, so the result does not depend on the order of
    the rows.  Repeated rows are turns of their own.  Rows without a conversation's id
    belong to none and are left out.
    """
    said, by = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in (text, role))
    name = F.unhex(F.md5(F.concat(F.char_length(by).cast("string"), F.lit(":"), by, said).cast("binary")))
    rows = conversations.where(conversations[conv].isNotNull()).select(
        conversations[conv].alias("conv_id"),
        F.struct(conversations[turn].alias("turn"), name.alias("digest"), F.char_length(said).cast("bigint").alias("size")).alias("t"),
    )
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return listed.select("conv_id", F.transform("ts", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def _joined(turns: Column) -> Column:
    """The digests one behind the other, as bytes."""
    return F.unhex(F.array_join(F.transform(turns, lambda t: F.hex(t["digest"])), ""))


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of ``conversations`` (conv_id, turns), one row each.

    conv_id is the smallest member, depth the number of turns (0: the root, which every
    conversation is a member of), parent_conv_id the parent's smallest member (root:
    null), n_convs the members, n_children the children, n_leaves the childless nodes of
    the subtree (a node is in its own), saved_tokens the sum over the subtree of
    (n_convs - 1) x size of the last turn, ends_sha256 the hash of the members that end
    here.  Conversations without turns end at the root; an empty table has no nodes, not
    even a root.  conv_id is unique and not null.
    """
    flat = conversations.select("conv_id", _joined(F.col("turns")).alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    flat = written(flat.withColumn("id", F.unhex(F.md5("key"))), "sequences")
    ends = _ends(flat)
    size = F.size("sizes")
    zeros = F.array_repeat(F.lit(0).cast("bigint"), size + 1)
    at_end = lambda value, kind: F.concat(F.array_repeat(F.lit(None).cast(kind), size), F.array(value))
    now = flat.join(ends.withColumnRenamed("id", "own"), F.col("conv_id") == F.col("least")).select(
        "key", "sizes", F.concat(F.array_repeat(F.lit(0).cast("bigint"), size), F.array("members")).alias("members"), zeros.alias("leaves"), zeros.alias("saved"),
        zeros.alias("children"), F.concat(F.array_repeat(F.lit(int(_NONE)), size), F.array("least")).alias("least"), at_end(F.col("sha"), "string").alias("ends"),
    )
    now = written(now, "round-0")
    done: list[DataFrame] = []
    spread = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        rows, turns = now.select(F.count("*"), F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()
        last = rows <= LEAST_SEQUENCES or (rows <= LAST_SEQUENCES and turns <= LAST_TURNS)
        shards = max(1, min(rows // LEAST_SEQUENCES, max(spread, turns // SHARD_TURNS)))
        out = written(_round(now, last, bool(done), shards), f"shards-{len(done)}")
        done.append(out.where("key is null"))
        if last:
            break
        now = out.where("key is not null").select(*_COLUMNS[10:])
    nodes = _COLUMNS[:8]
    final = done[0].select(*nodes, "parent")
    if len(done) > 1:
        upper = done[1]
        for other in done[2:]:
            upper = upper.union(other)
        final = final.union(upper.select(*nodes, "parent"))
        ids = upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
        settled = final.where("parent is null").select(*nodes)
        pending = final.where("parent is not null").join(ids, "parent").withColumn("parent_conv_id", F.col("above")).select(*nodes)
        final = settled.union(pending)
    return final.select(*nodes)


def rebuilt(own: DataFrame, shared: Column, base: Column, most: int) -> DataFrame:
    """(conv_id, turns) with the first ``shared`` turns (a column of conv_id, up to ``most``)
    taken from the conversation ``base`` (a column of conv_id): all that it has if fewer,
    none if there is no such conversation; then the conversation's own turns behind as many."""
    heads = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    joined = own.select("conv_id", "turns", base.alias("base"), shared.cast("int").alias("h")).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))
