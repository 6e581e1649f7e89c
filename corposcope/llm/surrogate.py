"""Personal data replaced by keyed surrogates of the same kind, script and format.

An entity is spelled as a list of digits in mixed radix: each letter or digit that
may change gives one, within its own class (digit, lower or upper Latin vowel or
consonant, Cyrillic, ...), and everything else stays as its format.  A keyed
permutation of that domain (a Feistel network walked until it lands in the domain)
gives the surrogate.  A permutation never maps two entities of one format to one
surrogate, and formats are kept, so distinct entities stay distinct; the same entity
has the same canonical form, hence the same surrogate, in every text.

A check over all distinct entities of the input then looks for surrogates that meet
(equal surrogates, or a surrogate that is itself an entity of the input) and gives
those entities the permutation of the next attempt, until none meet.  Where that does
not settle, so many spellings of a format are in use that no free ones are left: all its
entities then take one permutation without fixed points.  Their surrogates stay distinct
and differ from the entity, but may be another entity of the input.

Given names are permuted within lists by gender and script; a title (Mr, Frau, ...)
stays, and so does the gender ending of a Cyrillic surname.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, texts_of, written

# Titles by the gender they state.
TITLES = {"m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Don"), "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "Doña"), "": ("Dr", "Prof")}
# Given names by gender and script.
GIVEN = {
    ("m", "latin"): ("Adam", "Carlos", "Daniel", "David", "Hans", "Jack", "James", "Jean", "John", "José", "Juan", "Karl", "Luis", "Marc", "Michael", "Paul", "Peter", "Pierre", "Robert", "Thomas"),
    ("f", "latin"): ("Alice", "Anna", "Camille", "Carmen", "Claire", "Elena", "Emma", "Eva", "Jane", "Julia", "Laura", "Lucía", "Maria", "Marie", "Mary", "Nina", "Paula", "Rosa", "Sarah", "Sophie"),
    ("m", "cyrillic"): ("Алексей", "Андрей", "Борис", "Виктор", "Дмитрий", "Иван", "Максим", "Николай", "Павел", "Сергей"),
    ("f", "cyrillic"): ("Анна", "Вера", "Галина", "Елена", "Ирина", "Мария", "Надежда", "Наталья", "Ольга", "Татьяна"),
}
# Classes of characters that are exchanged among themselves.
CLASSES = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "àáâäèéêëìíîïòóôöùúûü", "ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
    "ãåæçðñõøýþßÿ", "ÃÅÆÇÐÑÕØÝÞ", "ёйъь", "ЁЙЪЬ",
)
HEX = "0123456789abcdef"

_CLASS = {c: group for group in CLASSES for c in group}
_GENDER = {name: key for key, names in GIVEN.items() for name in names}
ROUNDS = 8
# Attempts of the check; each halves the meeting surrogates many times over.
ATTEMPTS = 20
# The attempt of formats that do not settle.
DENSE = -1
# Up to this many entities with a later attempt are broadcast, more are joined.
BROADCAST_ENTITIES = 50_000

_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+)?"
_TITLE = "|".join(sorted((t for own in TITLES.values() for t in own), key=len, reverse=True))
PATTERNS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")),
    ("token", re.compile(r"\b(?=[0-9A-Fa-f]*[A-Fa-f])(?=[0-9A-Fa-f]*\d)[0-9A-Fa-f]{32,64}\b")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("key", re.compile(r"\bAKIA[0-9A-Z]{16}\b")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]\d{2,4}){1,3}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\w)|(?<![\w+])\+\d{8,14}(?!\w)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("card", re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])")),
    ("account", re.compile(r"(?<![\w.-])\d{8,12}(?![\w-]|\.\d)")),
)
_PERSON = re.compile(rf"\b(?P<title>{_TITLE})(?P<dot>\.?) (?P<name>{_NAME}(?: {_NAME}){{0,2}})|\b(?P<given>{'|'.join(map(re.escape, _GENDER))}) (?P<rest>{_NAME})")
_DIGIT = re.compile(r"\d")
_ENDING = re.compile("(?:ов|ев|ин|ск)(?:а|ая|ий)?$")
_WORD = re.compile(r"\w")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def permute(secret: bytes, tweak: str, value: int, size: int, back: bool = False) -> int:
    """Keyed permutation of 0..size-1, another for each tweak; ``back`` inverts it."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    label = tweak.encode() + b"\0"
    while True:
        a, b = value >> half, value & mask
        if back:
            a, b = b, a
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            block, out = label + bytes([k]) + b.to_bytes(width, "big"), b""
            while len(out) < width:
                out += hmac.digest(secret, block + bytes([len(out) // 32]), hashlib.sha256)
            a, b = b, a ^ (int.from_bytes(out[:width], "big") & mask)
        if back:
            a, b = b, a
        value = a << half | b
        if value < size:
            return value


def _mapped(secret: bytes, kind: str, attempt: int, form: str, value: int, size: int) -> int:
    """The permutation of an attempt; that of ``DENSE`` is one cycle over all values."""
    tweak = f"{kind}\0{attempt}\0{form}"
    value = permute(secret, tweak, value, size)
    return permute(secret, tweak, (value + 1) % size, size, back=True) if attempt == DENSE else value


def _exchange(secret: bytes, kind: str, attempt: int, text: str, classes: list[str | None]) -> str:
    """``text`` with the characters that have a class exchanged within it."""
    size, value = 1, 0
    for c, group in zip(text, classes, strict=True):
        if group:
            value, size = value * len(group) + group.index(c), size * len(group)
    value = _mapped(secret, kind, attempt, _form(text, classes), value, size)
    out = []
    for c, group in zip(reversed(text), reversed(classes), strict=True):
        if group:
            value, at = divmod(value, len(group))
            c = group[at]
        out.append(c)
    return "".join(reversed(out))


def _form(text: str, classes: list[str | None]) -> str:
    return "".join(f"[{group}]" if group else c for c, group in zip(text, classes, strict=True))


def canonical(kind: str, text: str) -> str:
    """What the spellings of one entity have in common."""
    if kind in ("email", "token"):
        return text.lower()
    if kind in ("phone", "card", "iban", "ssn", "account"):
        return re.sub(r"[^0-9A-Za-z+]", "", text)
    return text


def _classes(kind: str, entity: str) -> list[str | None]:
    """For each character of an entity the class within which it is exchanged."""
    classes: list[str | None] = [_CLASS.get(c) for c in entity]
    if kind == "email":  # the top-level domain stays
        end = entity.rindex(".")
        classes = [g if i < end else None for i, g in enumerate(classes)]
    elif kind == "phone":  # the country code stays, other leading digits stay non-zero
        skip = 2 if entity.startswith("+") else 0
        classes = [None if i < skip else g for i, g in enumerate(classes)]
        if skip < len(entity) and entity[skip] in "123456789":
            classes[skip] = "123456789"
    elif kind == "card":
        classes[0] = None  # the network stays
    elif kind == "iban":
        classes = [None if i < 2 else "0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for i, c in enumerate(entity)]
    elif kind == "key":
        classes = [None if i < 4 else "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" for i in range(len(entity))]
    elif kind == "token":
        classes = [HEX] * len(entity)
    return classes


def _stem(kind: str, entity: str) -> str:
    """Of a Cyrillic surname the part before its ending, which alone decides, so both
    genders of a family name go together."""
    ending = _ENDING.search(entity) if kind == "surname" else None
    return entity[: ending.start()] if ending else entity


def format_of(kind: str, entity: str) -> str:
    """Entities of one kind and format share a permutation."""
    if kind == "ip":
        return _block(_number(entity))[0]
    stem = _stem(kind, entity)
    return _form(stem, _classes(kind, stem)) + ("-" if stem != entity else "")


def surrogate(secret: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """Surrogate of a canonical entity, in canonical form."""
    if kind == "ip":
        return _address(secret, attempt, entity)
    if kind == "given":
        pool = GIVEN[_GENDER[entity]]
        return pool[permute(secret, f"given\0{attempt}\0{_GENDER[entity]}", pool.index(entity), len(pool))]
    stem = _stem(kind, entity)
    if stem != entity:
        return _exchange(secret, kind, attempt, stem, _classes(kind, stem)) + entity[len(stem) :]
    classes = _classes(kind, entity)
    step = lambda t: _exchange(secret, kind, attempt, t, classes)
    fits = lambda t: True
    if kind == "card":
        valid = luhn(entity)
        fits = lambda t: luhn(t) == valid
    elif kind == "token":
        fits = lambda t: bool(re.search("[a-f]", t) and _DIGIT.search(t))
    elif kind == "surname":  # no surrogate of a name without an ending gets one
        fits = lambda t: not _ENDING.search(t)
    # Walking on until the form fits keeps the mapping a permutation of the fitting ones.
    out = step(entity)
    while not fits(out):
        out = step(out)
    return out


def _number(address: str) -> int:
    return int.from_bytes(bytes(map(int, address.split("."))), "big")


def _block(value: int) -> tuple[str, int]:
    """The private block of an address and its bits, or ("", 32)."""
    for start, bits in (("10.0.0.0", 24), ("172.16.0.0", 20), ("192.168.0.0", 16), ("127.0.0.0", 24)):
        if _number(start) <= value < _number(start) + (1 << bits):
            return start, bits
    return "", 32


def _address(secret: bytes, attempt: int, entity: str) -> str:
    """Addresses by their number; private ones stay private, public ones public."""
    value = _number(entity)
    start, bits = _block(value)
    low = _number(start) if start else 0
    while True:
        value = low + _mapped(secret, "ip", attempt, start, value - low, 1 << bits)
        if _block(value)[0] == start:
            return ".".join(map(str, value.to_bytes(4, "big")))


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical entity) of the entities, in order, not overlapping.
    Of overlapping matches the kind that is listed first counts.  A surname found once
    is found wherever it stands alone in the text."""
    spans: list[tuple[int, int, str, str]] = []
    if _DIGIT.search(text) or "@" in text:
        for kind, pattern in PATTERNS:
            for m in pattern.finditer(text):
                spans.append((m.start(), m.end(), kind, canonical(kind, m.group())))
    for m in _PERSON.finditer(text):
        if m["title"]:
            at = m.start("name")
            parts = m["name"].split(" ")
        else:
            at, parts = m.start("given"), [m["given"], m["rest"]]
        for i, part in enumerate(parts):
            kind = "given" if part in _GENDER and (i < len(parts) - 1 or len(parts) == 1) else "surname"
            spans.append((at, at + len(part), kind, part))
            at += len(part) + 1
    taken: list[tuple[int, int, str, str]] = []
    ends = bytearray(len(text)) if spans else b""
    for s in spans:
        if not any(ends[s[0] : s[1]]):
            ends[s[0] : s[1]] = b"\1" * (s[1] - s[0])
            taken.append(s)
    # Bare mentions of the surnames found, longer names first.
    for name in sorted({s[3] for s in taken if s[2] == "surname"}, key=lambda n: (-len(n), n)):
        start = text.find(name)
        while start >= 0:
            end = start + len(name)
            if not (_WORD.match(text[max(start - 1, 0) : start]) or _WORD.match(text[end : end + 1]) or any(ends[start:end])):
                ends[start:end] = b"\1" * len(name)
                taken.append((start, end, "surname", name))
            start = text.find(name, end)
    return sorted(taken)


def _dress(kind: str, shown: str, new: str) -> str:
    """The new canonical form in the layout and case of the shown spelling."""
    if kind == "token" and shown.isupper():
        return new.upper()
    if len(shown) == len(new):
        return "".join(n.upper() if s.isupper() and n.islower() else n for s, n in zip(shown, new, strict=True))
    kept = iter(new)
    return "".join(next(kept) if re.match("[0-9A-Za-z+]", c) else c for c in shown)


def replace(secret: bytes, text: str, attempts: dict[tuple[str, str], int] | None = None) -> tuple[str, dict[str, int]]:
    """The text with surrogates, and the number of entities by kind."""
    out, at, counts = [], 0, {}
    for start, end, kind, canon in find(text):
        new = surrogate(secret, kind, canon, (attempts or {}).get((kind, canon), 0))
        out += (text[at:start], new if kind in ("given", "ip") else _dress(kind, text[start:end], new))
        at = end
        counts[kind] = counts.get(kind, 0) + 1
    return "".join((*out, text[at:])), counts


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (kind, entity) of all texts."""

    def work(batch: pa.RecordBatch) -> dict:
        found = sorted({s[2:] for t in texts_of(batch, "text") for s in find(t)})
        return {"kind": pa.array([f[0] for f in found], pa.string()), "entity": pa.array([f[1] for f in found], pa.string())}

    return by_batch(docs.select(docs[text].alias("text")), work, "kind string, entity string").distinct()


def assign(known: DataFrame, secret: bytes) -> DataFrame:
    """(kind, entity, attempt) of the entities whose surrogate of attempt 0 met another
    surrogate or an entity.  Given names are permuted within their list, so they stay out."""

    def at(rows: DataFrame) -> DataFrame:
        def work(batch: pa.RecordBatch) -> dict:
            columns = {n: batch.column(n).to_pylist() for n in ("kind", "entity", "attempt")}
            new = [surrogate(secret, k, e, a) for k, e, a in zip(*columns.values(), strict=True)]
            return {n: batch.column(n) for n in columns} | {"surrogate": pa.array(new, pa.string())}

        return by_batch(rows, work, "kind string, entity string, attempt int, surrogate string")

    known = written(known.where("kind <> 'given'"), "entities")
    current = written(at(known.withColumn("attempt", F.lit(0))), "attempt-0")
    real = known.select("kind", F.col("entity").alias("surrogate"))
    for k in range(1, ATTEMPTS + 2):
        first = current.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "entity")).alias("first"), F.count("*").alias("n")).where("n > 1")
        twice = current.join(first, ["kind", "surrogate"]).where("struct(attempt, entity) <> first").select("kind", "entity")
        met = written(current.join(real, ["kind", "surrogate"], "left_semi").select("kind", "entity").union(twice).distinct(), f"met-{k}")
        if met.isEmpty():
            break
        if k <= ATTEMPTS:
            again = at(met.withColumn("attempt", F.lit(k)))
            current = written(current.join(met, ["kind", "entity"], "left_anti").unionByName(again), f"attempt-{k}")
    else:
        # No surrogate leaves its format, so the other formats are not touched.
        dense = _formats(met).select("kind", "form").distinct()
        settled = _formats(known).join(dense, ["kind", "form"], "left_semi").select("kind", "entity", F.lit(DENSE).alias("attempt"))
        later = current.select("kind", "entity", "attempt").join(settled.select("kind", "entity"), ["kind", "entity"], "left_anti")
        return later.where("attempt > 0").unionByName(settled)
    return current.where("attempt > 0").select("kind", "entity", "attempt")


def _formats(rows: DataFrame) -> DataFrame:
    def work(batch: pa.RecordBatch) -> dict:
        kinds, names = batch.column("kind").to_pylist(), batch.column("entity").to_pylist()
        return {"kind": batch.column("kind"), "entity": batch.column("entity"), "form": pa.array([format_of(k, e) for k, e in zip(kinds, names, strict=True)], pa.string())}

    return by_batch(rows.select("kind", "entity"), work, "kind string, entity string, form string")


def pseudonymise(docs: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n_entities, kinds) for every row: the text with surrogates, how many
    entities it had, and their number by kind as ``kind=n`` in order.

    Whole texts are read; a null text stays null, with no entities.  Repeated rows and
    null keys stay and repeat their surrogates.  Other columns are not read.
    """
    later = written(assign(entities(docs, text), secret), "later")
    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    n = later.count()
    few: dict[tuple[str, str], int] = {}
    if n <= BROADCAST_ENTITIES:
        few = {(r["kind"], r["entity"]): r["attempt"] for r in later.collect()}
        source = source.withColumn("later", F.array().cast("array<struct<kind:string,entity:string,attempt:int>>"))
    else:
        source = _with_later(source, later)
    shared = docs.sparkSession.sparkContext.broadcast(few)

    def work(batch: pa.RecordBatch) -> dict:
        texts, rows = [], []
        for t, own in zip(batch.column("text").to_pylist(), batch.column("later").to_pylist(), strict=True):
            attempts = {(x["kind"], x["entity"]): x["attempt"] for x in own} if own else shared.value
            new, counts = replace(secret, t or "", attempts)
            texts.append(None if t is None else new)
            rows.append(counts)
        return {
            "key": batch.column("key"), "text": pa.array(texts, pa.string()), "n_entities": pa.array([sum(r.values()) for r in rows], pa.int64()),
            "kinds": pa.array([",".join(f"{k}={r[k]}" for k in sorted(r)) for r in rows], pa.string()),
        }

    kind = docs.schema[key].dataType.simpleString()
    return by_batch(source, work, f"key {kind}, text string, n_entities bigint, kinds string").withColumnRenamed("key", key)


def _with_later(source: DataFrame, later: DataFrame) -> DataFrame:
    """Each row with the attempts of its own entities; rows are told apart by their text."""

    def work(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch, "text")
        found = [(h, *pair) for h, t in zip(batch.column("h").to_pylist(), texts, strict=True) for pair in sorted({s[2:] for s in find(t)})]
        columns: Iterable = zip(*found, strict=True) if found else ([], [], [])
        return {n: pa.array(list(c), kind) for n, c, kind in zip(("h", "kind", "entity"), columns, (pa.int64(), pa.string(), pa.string()), strict=True)}

    hashed = source.withColumn("h", F.xxhash64("text"))
    spans = by_batch(hashed.select("h", "text"), work, "h bigint, kind string, entity string").distinct()
    own = spans.join(later, ["kind", "entity"]).groupBy("h").agg(F.collect_set(F.struct("kind", "entity", "attempt")).alias("later"))
    # Texts that share a hash share the union of their entities, which changes nothing.
    return hashed.join(own, "h", "left").drop("h")
