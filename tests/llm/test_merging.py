"""Merges of long words, against the library and against merging in rounds."""

import random

import pytest

from gridloom.llm import merging, queries


@pytest.fixture(scope="module")
def merger():
    return merging.RankMerger(queries.tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))


def split(flat, counts):
    ends = counts.cumsum()
    return [flat[e - c : e].tolist() for e, c in zip(ends, counts)]


def some_words():
    r = random.Random(2)
    words = ["", "a", "the", "a" * 700, "ab" * 400, "é" * 600, "日本" * 300, "x" * 511, "x" * 512, "x" * 513]
    return words + ["".join(r.choices("abcdefgh", k=r.choice((1, 5, 30, 600, 3000)))) for _ in range(40)]


def test_long_words_equal_the_library(merger, library):
    words = some_words()
    got = split(*merger.merge([w.encode() for w in words]))
    assert got == [library.encode(w, add_special_tokens=False).ids for w in words]


@pytest.mark.parametrize("long", [0, 1, 7, 10**9])
def test_by_itself_or_in_rounds_is_the_same(merger, monkeypatch, long):
    words = [w.encode() for w in some_words()] + [bytes(random.Random(5).choices(range(256), k=900))]
    want = split(*merger._merge_together(words))
    monkeypatch.setattr(merging, "LONG", long)
    assert split(*merger.merge(words)) == want


def test_a_run_of_letters_without_a_break(merger, library):
    word = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=100_000))
    assert split(*merger.merge([word.encode()]))[0] == library.encode(word, add_special_tokens=False).ids
