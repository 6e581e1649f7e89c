import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corposcope.llm import bpe
from corposcope.llm.queries import TOKENIZER


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def words():
    return bpe.Words(bpe.compile_file(TOKENIZER))


def ids(words, text):
    return np.frombuffer(b"".join(map(words.__getitem__, words.automaton.pieces(text))), "<u4").tolist()


TEXTS = st.text(st.one_of(st.sampled_from("etaoin shrdlu\n\t'.<|>"), st.characters(exclude_categories=("Cs",))), max_size=80)


@given(text=TEXTS)
@settings(max_examples=300, deadline=None)
def test_same_ids_as_the_library(library, words, text):
    assert ids(words, text) == library.encode(text, add_special_tokens=False).ids
    assert bpe.spell(words.automaton, ids(words, text)) == text


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000, " " * 999, "<|endoftext|>a<|endoftext|> ", "\x1c \x85 x", "\U00010940 ՘a ٠"])
def test_long_words_special_tokens_and_late_characters(library, words, text):
    assert ids(words, text) == library.encode(text, add_special_tokens=False).ids


def merged(symbols, merges):
    """Merges applied one after the other, each from left to right."""
    for u, v, product in merges:
        out = []
        for s in symbols:
            if out and out[-1] == u and s == v and (u != v or out[-1] is not product):
                out[-1] = product
            else:
                out.append(s)
        symbols = out
    return symbols


@pytest.mark.parametrize("seed", range(60))
def test_any_merge_list_gives_what_merging_in_order_gives(seed):
    rng = random.Random(seed)
    labels, merges = {i: bytes([97 + i]) for i in range(3)}, []
    for _ in range(rng.randint(1, 14)):
        u, v = rng.choice(list(labels)), rng.choice(list(labels))
        if labels[u] + labels[v] not in labels.values():
            product = len(labels)
            labels[product] = labels[u] + labels[v]
            merges.append((u, v, product))
    automaton = bpe.Automaton(labels, merges)
    for _ in range(60):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
        assert automaton.encode_word(word) == merged([b - 97 for b in word], merges), (merges, word)


def test_rows(spark, odd, none, words):
    automaton = words.automaton
    found = bpe.encode(odd, automaton, decoded="decoded")
    rows = [(r["doc_id"], r["n_tokens"], r["token_ids"], r["decoded"], r["ids_sha256"]) for r in found.collect()]
    assert sorted(r[3] for r in rows) == sorted(t or "" for t in (r["text"] for r in odd.collect()))
    assert all(n == len(i) and h == hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest() for _, n, i, _, h in rows)
    again = bpe.decode(found.drop("decoded"), automaton)
    assert sorted(r["decoded"] for r in again.collect()) == sorted(r[3] for r in rows)
    assert bpe.encode(none, automaton).collect() == []


def test_bytes_that_are_no_text(words):
    # The two halves of a character, split over tokens and alone.
    assert bpe.spell(words.automaton, ids(words, "é")[:1] if len(ids(words, "é")) > 1 else [words.automaton.arcs[b"\xc3"]]) == "�"


def test_refused_merges():
    with pytest.raises(ValueError):
        bpe.Automaton({0: b"a", 1: b"b", 2: b"xx"}, [(0, 1, 2)])
