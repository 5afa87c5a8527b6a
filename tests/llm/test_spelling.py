"""Spelling variants against all pairs of words, by deleting a code point from each."""

import random
import zlib
from collections import Counter
from itertools import combinations

import pytest

from gridloom.llm import queries, spelling


def one_apart(a, b):
    """Exactly one inserted, deleted or replaced code point, written out."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(rows):
    """Counts by the rule's own words, letter by letter."""
    out = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                word = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
                out[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 97 == 0 else word] += 1
            run = ""
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def brute(vocab):
    near = {w: [] for w in vocab}
    for a, b in combinations(vocab, 2):
        if one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in vocab.items():
        best = min(near[w], key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best is not None and vocab[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), form[w] and vocab[form[w]]) for w, n in vocab.items()}


def found(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def some_words(n, letters, least, most, seed):
    r = random.Random(seed)
    words = {"".join(r.choices(letters, k=r.randint(least, most))) for _ in range(n)}
    for w in list(words)[: n // 2]:
        i = r.randrange(len(w) + 1)
        words |= {w[:i] + r.choice(letters) + w[i:], w[:i] + w[i + 1 :] if len(w) > 1 else w, w[:i] + r.choice(letters) + w[i + 1 :]}
    return sorted(w for w in words if w)


@pytest.mark.parametrize("seed,letters,least,most", [(1, "ab", 1, 7), (2, "abc", 3, 6), (3, "abcdefgh", 5, 12), (4, "é€🙂a", 1, 5)])
def test_the_trie_finds_all_pairs(seed, letters, least, most):
    words = some_words(250, letters, least, most, seed)
    got = sorted(spelling.near_in_trie(words))
    assert got == [(i, j) for (i, a), (j, b) in combinations(enumerate(words), 2) if one_apart(a, b)]


@pytest.mark.parametrize("trie_words", [1, 5, 100_000])
def test_any_cut_of_the_tries_finds_each_pair_once(spark, trie_words):
    words = some_words(300, "abcd", 1, 9, 7) + ["x" * 40, "x" * 41, "x" * 20 + "y" + "x" * 19, "x" * 39 + "y"]
    vocab = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long").repartition(3)
    got = sorted(tuple(sorted((r["word"], r["other"]))) for r in spelling.near_words(vocab, trie_words).collect())
    assert got == sorted(tuple(sorted(p)) for p in combinations(words, 2) if one_apart(*p))


@pytest.mark.parametrize("trie_words", [3, 2048])
def test_forms_and_roots_equal_brute_force(spark, trie_words):
    words = some_words(300, "abc", 5, 8, 11)
    r = random.Random(5)
    vocab = {w: int(3 * 2 ** (r.random() * 8)) for w in words}  # many ties, and chains of forms
    df = spark.createDataFrame(sorted(vocab.items()), "word string, n long").repartition(4)
    want = brute(vocab)
    assert found(spelling.spelling_variants(df, trie_words=trie_words)) == want
    assert any(root not in (w, form) for w, (form, root, *_) in want.items())


def test_the_query_on_texts_of_all_kinds(spark, tmp_path):
    r = random.Random(3)
    base = some_words(60, "abcdeéÀ", 4, 8, 2)
    rows = [(None, "Words words WORDS wordz"), (1, None), (2, ""), (3, " \n12 34"), (4, "a" * 300_000 + " " + "Straße naïve " * 5)]
    rows += [(i, " ".join(r.choices(base, k=200)) + r.choice([".", " Übung-übung", "\x00x"])) for i in range(10, 60)]
    rows += [rows[-1]] * 3
    docs = spark.createDataFrame([(*x, "en", "n") for x in rows], "doc_id long, text string, word string, n string").repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_spelling(spark, str(tmp_path))
    assert dict(out.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    want = brute(words_of(rows))
    assert len(want) > 50 and found(out) == want


def test_no_words(spark):
    none = spark.createDataFrame([(1, None), (2, "one two three")], "doc_id long, text string")
    vocab = spelling.vocabulary(none)
    assert vocab.count() == 0 and spelling.spelling_variants(vocab).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(vocab, ratio=1.0)


def test_a_hot_prefix_is_cut(spark):
    words = ["common" + "".join(p) for p in __import__("itertools").product("abcdefgh", repeat=4)]  # 4096 words share it
    vocab = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    out = spelling.spelling_variants(vocab, trie_words=64)
    assert {r["n_near"] for r in out.collect()} == {28}
