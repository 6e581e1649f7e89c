"""Byte-pair encoding by a deterministic token automaton, and decoding.

The automaton starts as one state with a loop for each of the 256 bytes, which
accepts every spelling.  Merge ``k`` joining ``u`` and ``v`` adds one gadget:

* the target of ``u`` is split, and the new state has no arc ``v``
  (after merge ``k`` the pair may not stand side by side);
* every state that has an arc ``u`` gets an arc ``uv`` whose target is a copy of
  the target of ``v`` as it was before the gadget.

After all merges each byte string has exactly one accepted path, its encoding.
The target of an arc depends on its token only, so a state is named by the token
that leads to it.  The full table would have one cell per pair of tokens (2.5
billion for 50,000); a row is therefore kept as its difference to the row it was
copied from - the cut pairs and the two parts of each token - and a cell is
looked up there on first use and then stored.

A word is encoded by walking the automaton over the trie of arc labels, longest
arc first.  Since the accepted path of a prefix is unique, a position from which
no arc leads on is marked once and never entered again: the work is linear in
the word.  Decoding joins the labels of the arcs.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import by_batch, texts_of

# How the public byte-level tokenizers split text into words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Letters and numbers of the installed regex module that the
# tokenizers library, whose character tables are of Unicode 16, does not know.
UNKNOWN = (
    "\\u0558\\u058B-\\u058C\\u088F\\u0C5C\\u0CDC\\u208F\\u209D-\\u209F\\uA7CE-\\uA7CF\\uA7D2\\uA7D4\\uA7DD\\uA7E2\\uA7F1\\uAB6C-\\uAB6D"
    "\\U000107BB-\\U000107BF\\U00010940-\\U00010959\\U00010EC5-\\U00010EC7\\U00010ED9-\\U00010EEE\\U00011B0A\\U00011DB0-\\U00011DDB"
    "\\U00011DE0-\\U00011DE9\\U00011DF1\\U0001246F\\U00012475-\\U0001247F\\U00012550-\\U00012686\\U00016EA0-\\U00016EB8"
    "\\U00016EBB-\\U00016ED3\\U00016FF2-\\U00016FF6\\U000187F8-\\U000187FF\\U00018CD6-\\U00018CDA\\U00018D09-\\U00018D20"
    "\\U00018D80-\\U00018DF2\\U00018E00-\\U00019191\\U000191A0-\\U000191D2\\U0001B123-\\U0001B128\\U0001B168\\U0001D6A6"
    "\\U0001DF1F-\\U0001DF24\\U0001DF2B-\\U0001DF81\\U0001DF90-\\U0001DF96\\U0001DFCD-\\U0001DFFF\\U0001E6C0-\\U0001E6DE"
    "\\U0001E6E0-\\U0001E6E2\\U0001E6E4-\\U0001E6E5\\U0001E6E7-\\U0001E6ED\\U0001E6F0-\\U0001E6F4\\U0001E6FE-\\U0001E6FF"
    "\\U0002B73A-\\U0002B73F\\U0002B81E\\U0002CEA2-\\U0002CEAD\\U000323B0-\\U00033479\\U0003D000-\\U0003FC3F"
)

_LATE = f"[{UNKNOWN}]"
# For texts with characters beyond the basic plane.
_WIDE = regex.compile(
    WORD.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||{_LATE}]").replace(r" ?\p{L}+", rf" ?[\p{{L}}--{_LATE}]+").replace(r" ?\p{N}+", rf" ?[\p{{N}}--{_LATE}]+"),
    regex.V1,
)


@functools.cache
def _basic() -> re.Pattern:
    """The same rule with its classes written out, which the standard ``re`` runs faster."""

    def members(kind: str) -> str:
        runs: list[list[int]] = []
        for m in regex.compile(rf"[{kind}--{_LATE}]", regex.V1).finditer("".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))):
            if runs and runs[-1][1] == ord(m.group()) - 1:
                runs[-1][1] += 1
            else:
                runs.append([ord(m.group())] * 2)
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)

    space, letters, numbers = members(r"\s"), members(r"\p{L}"), members(r"\p{N}")
    return re.compile(
        WORD.replace(r"\s+(?!\S)|\s+", f"[{space}]+(?![^{space}])|[{space}]+").replace(r"\s\p{L}\p{N}", space + letters + numbers)
        .replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    )


# A worker forgets its stored words and cells beyond these numbers and fills them
# anew; results do not depend on it.
STORED_WORDS = 300_000
STORED_CELLS = 400_000
# Longer words are encoded but not stored.
STORED_LENGTH = 64


def split_words(text: str) -> list[str]:
    if len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text):
        return _WIDE.findall(text)
    return _basic().findall(text)


class Automaton:
    """Compiled merges.  ``labels[token]`` are the bytes of the arc ``token``."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], specials: dict[str, int] | None = None):
        """``merges``: (left, right, product) in order; tokens that no merge makes
        must be single bytes, and no two merges may make the same token."""
        self.labels = dict(labels)
        self.specials = dict(specials or {})
        self.born: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}
        products = {p for _, _, p in merges}
        if len(products) != len(merges):
            raise ValueError("two merges make the same token")
        self.born.update((t, -1) for t, label in labels.items() if t not in products and len(label) == 1)
        unreachable = {t for t in labels if t not in products and len(labels[t]) != 1}
        for k, (u, v, product) in enumerate(merges):
            if u not in self.born or v not in self.born:
                raise ValueError(f"merge {k} uses a token that does not exist yet")
            if labels[u] + labels[v] != labels[product]:
                raise ValueError(f"merge {k} does not spell its token")
            if u in unreachable or v in unreachable or not self._cell(u, v, k):
                unreachable.add(product)
            self.cut.setdefault((u, v), k)
            self.left[product], self.right[product], self.born[product] = u, v, k
        self.arcs: dict[bytes, int] = {}
        for token, label in labels.items():
            if token in unreachable:
                continue
            for n in range(1, len(label)):
                self.arcs.setdefault(label[:n], -1)
            self.arcs[label] = token
        # Key: the two tokens in one number.
        self.table: dict[int, bool] = {}
        for text, token in self.specials.items():
            self.labels[token] = text.encode()

    @functools.cached_property
    def words(self) -> Words:
        """Stored words of this worker.  They hang on the broadcast, so they last from task
        to task and go with it: Spark drops it from a worker that gets other work."""
        return Words(self)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "words"}

    def _cell(self, u: int, v: int, now: int) -> bool:
        """Whether the state of ``u`` has an arc ``v`` once the first ``now`` gadgets are built."""
        born, cut = self.born, self.cut
        while True:
            k = cut.get((u, v))
            if k is not None and k < now:
                return False
            a, b = born[u], born[v]
            if a == b:
                if a < 0:
                    return True
                u, v, now = self.right[u], self.left[v], a
            elif a > b:  # the row of u was copied from its right part's, before gadget a cut it
                now, u = a, self.right[u]
            else:  # the arc v was added where the arc of its left part was left after the cut
                now, v = b + 1, self.left[v]

    def allows(self, u: int, v: int) -> bool:
        found = self.table.get(u << 32 | v)
        if found is None:
            if len(self.table) >= STORED_CELLS:
                self.table.clear()
            found = self.table[u << 32 | v] = self._cell(u, v, len(self.cut))
        return found

    def encode_word(self, word: bytes) -> list[int]:
        arcs, table = self.arcs, self.table
        size, pos, last = len(word), 0, None
        ids: list[int] = []
        back: list[tuple[int, int | None, list[int]]] = []
        dead: set[int] = set()
        open_arcs: list[int] | None = None
        while pos < size:
            if open_arcs is None:
                open_arcs, end = [], pos + 1
                token = arcs.get(word[pos:end])
                while token is not None:
                    if token >= 0:
                        open_arcs.append(token)
                    end += 1
                    token = arcs.get(word[pos:end]) if end <= size else None
            while open_arcs:
                token = open_arcs.pop()
                end = pos + len(self.labels[token])
                if end in dead:
                    continue
                if last is not None:
                    fits = table.get(last << 32 | token)
                    if not (self.allows(last, token) if fits is None else fits):
                        continue
                back.append((pos, last, open_arcs))
                ids.append(token)
                pos, last, open_arcs = end, token, None
                break
            else:
                if not back:
                    raise ValueError(f"no path spells {word[:40]!r}")
                dead.add(pos)
                pos, last, open_arcs = back.pop()
                ids.pop()
        return ids

    def pieces(self, text: str) -> list[str | int]:
        """Words of the text in order; a special token stands as its id."""
        if not any(s in text for s in self.specials):
            return split_words(text)
        out: list[str | int] = []
        found = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))))
        at = 0
        for m in found.finditer(text):
            out += split_words(text[at : m.start()])
            out.append(self.specials[m.group()])
            at = m.end()
        return out + split_words(text[at:])


class Words(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str | int) -> bytes:
        if isinstance(word, int):
            return np.array([word], "<u4").tobytes()
        found = np.array(self.automaton.encode_word(word.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(word) <= STORED_LENGTH:
            if len(self) >= STORED_WORDS:
                self.clear()
            self[word] = found
        return found


def _byte_letters() -> dict[str, int]:
    """The public rule that writes bytes as letters: printable ones as themselves,
    the others in order from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def compile_file(path: str) -> Automaton:
    """The automaton of a byte-level BPE file in the tokenizers library's JSON form."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, letters = spec["model"], _byte_letters()
    vocab = model["vocab"]
    labels = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    return Automaton(labels, merges, {t["content"]: t["id"] for t in spec.get("added_tokens") or []})


def spell(automaton: Automaton, ids) -> str:
    """The labels of the arcs in order, as text."""
    return b"".join(map(automaton.labels.__getitem__, ids)).decode("utf-8", "replace")


def encode(docs: DataFrame, automaton: Automaton, key: str = "doc_id", text: str = "text", decoded: str | None = None) -> DataFrame:
    """One row per row of ``docs``: the key, ``token_ids``, ``n_tokens``, ``ids_sha256``
    (of the ids as little-endian unsigned 32-bit integers) and, if ``decoded`` names a
    column, the text that the ids spell (as ``decode`` gives it, in the same pass).

    Texts are encoded whole.  A null text counts as empty: no ids.  Repeated rows
    and null keys stay; other columns of ``docs`` are not read.
    """
    # Its size is that of the vocabulary.
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def work(batch: pa.RecordBatch) -> dict:
        words = shared.value.words
        get, pieces = words.__getitem__, words.automaton.pieces
        rows = [b"".join(map(get, pieces(t))) for t in texts_of(batch, "text")]
        sizes = np.array([len(r) // 4 for r in rows], np.int64)
        offsets = np.zeros(len(rows) + 1, np.int32)
        np.cumsum(sizes, out=offsets[1:])
        values = pa.array(np.frombuffer(b"".join(rows), "<i4"), pa.int32())
        spelled = {}
        if decoded:
            spelled[decoded] = pa.array([spell(words.automaton, np.frombuffer(r, "<u4").tolist()) for r in rows], pa.string())
        return spelled | {
            "key": batch.column("key"),
            "n_tokens": pa.array(sizes),
            "ids_sha256": pa.array([hashlib.sha256(r).hexdigest() for r in rows]),
            "token_ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values),
        }

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    more = f", `{decoded}` string" if decoded else ""
    out = by_batch(source, work, f"key {kind}, n_tokens bigint, ids_sha256 string, token_ids array<int>{more}")
    return out.withColumnRenamed("key", key)


def decode(encoded: DataFrame, automaton: Automaton, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the column ``out``: the text spelled by the arcs of ``ids``.

    Bytes that are no UTF-8 become U+FFFD; null ids spell ''; an unknown id raises.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(automaton)

    def work(batch: pa.RecordBatch) -> dict:
        texts = [spell(shared.value, row or ()) for row in batch.column(ids).to_pylist()]
        return dict(zip(batch.schema.names, batch.columns)) | {out: pa.array(texts, pa.string())}

    kept = [f for f in encoded.schema.fields if f.name != out]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return by_batch(encoded.drop(out), work, f"{fields}, `{out}` string")
