"""Quality rules against counts written out in plain Python, decoding against all labellings."""

import random
from itertools import product

import numpy as np
import pytest

from gridloom.llm import quality, queries

SPACE = " \t\n\x0b\x0c\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_in(text):
    out, word = [], ""
    for c in text + " ":
        if c in SPACE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def counted(text):
    text = text or ""
    words = words_in(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = text.split("\n")
    dup = sum(1 for i, line in enumerate(lines) if words_in(line) and line in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


LONG = " ".join(f"w{i % 97} of thing{i % 1013}" for i in range(9000))
TEXTS = [
    None, "", "  \t\n \n", "one", "\n\none\n\none\n two\n one", "a b c d e f g h a b c d e f g h i", "a b c d e f g h i a b c d e f g h", "x " * 40, "a\x0bb\x0cc\rd\x1ce f g\x85h", "été 日本 🙂 # | <b>&amp;</b>\né\né",
    "same line here\r\nsame line here\nsame line here\r\n", "tail without end of it all\n", "a b c d e f g h", "a b c d e f g", LONG[:2000], "* # $\n" * 30, "\x00 null\x00 \x00",
]


def test_counts_alone_and_together_equal_plain_python():
    together = quality.read_lines(TEXTS).counts
    for i, text in enumerate(TEXTS):
        want = counted(text)
        assert tuple(together[c][i] for c in BASE) == want, repr(text)
        assert tuple(quality.read_lines([text]).counts[c][0] for c in BASE) == want


def test_counts_of_random_texts():
    r = random.Random(4)
    texts = ["".join(r.choices("ab# \n\té", weights=(5, 5, 1, 6, 1, 1, 1), k=r.randint(0, 300))) for _ in range(300)]
    got = quality.read_lines(texts).counts
    assert [tuple(int(got[c][i]) for c in BASE) for i in range(len(texts))] == [counted(t) for t in texts]


def test_features_lie_between_0_and_1_and_don_t_depend_on_neighbours():
    read = quality.read_lines(TEXTS)
    assert read.features.shape[1] == len(quality.FEATURES) and read.features.min() >= 0 and read.features.max() <= 1
    for i, text in enumerate(TEXTS):
        assert np.array_equal(quality.read_lines([text]).features, read.features[read.doc == i])
    shout = quality.read_lines(["HEAR! HEAR!! ME## 12\nplain words of a line."]).features
    at = dict(zip(quality.FEATURES, shout.T))
    assert at["upper"].tolist() == [1, 0] and at["first"].tolist() == [1, 0] and at["last"].tolist() == [0, 1]
    assert at["digits"][0] == 2 / 17 and at["symbols"][0] == 2 / 17 and at["odd_endings"].tolist() == [0.75, 0] and at["no_end"].tolist() == [1, 0]


@pytest.mark.parametrize("seed", range(6))
def test_decoding_is_the_best_of_all_labellings(seed):
    r = np.random.default_rng(seed)
    scores, step, first = r.normal(size=(9, 2)), r.normal(size=(2, 2)), r.normal(size=2)
    worth = lambda y: first[y[0]] + sum(scores[i, a] for i, a in enumerate(y)) + sum(step[a, b] for a, b in zip(y, y[1:]))
    got = quality.viterbi(scores, step, first)
    assert worth(got) == pytest.approx(max(worth(y) for y in product((0, 1), repeat=9)))
    assert quality.viterbi(np.zeros((3, 2)), np.zeros((2, 2)), np.zeros(2)) == [0, 0, 0]  # ties are content
    assert quality.viterbi(np.zeros((0, 2)), step, first) == []


def test_the_likelihood_sums_over_all_labellings_and_its_gradient_is_right():
    r = np.random.default_rng(2)
    size = np.array([5, 3, 1])
    x = r.normal(size=(3, 5, 4))
    y = r.integers(0, 2, size=(3, 5))
    for i, s in enumerate(size):
        x[i, s:], y[i, s:] = 0, 0
    w = r.normal(size=8 + 6)
    field = lambda w: quality.LineField(w[:8].reshape(2, 4), w[8:12].reshape(2, 2), w[12:])

    def brute(w):
        f, total = field(w), 0.0
        for i, s in enumerate(size):
            e = x[i, :s] @ f.emit.T
            worth = lambda y, e=e: f.first[y[0]] + sum(e[t, a] for t, a in enumerate(y)) + sum(f.step[a, b] for a, b in zip(y, y[1:]))
            total += worth(y[i, :s]) - np.log(sum(np.exp(worth(z)) for z in product((0, 1), repeat=int(s))))
        return total

    value, g = quality.likelihood(field(w), x, y, size)
    assert value == pytest.approx(brute(w))
    slope = [(brute(w + d) - brute(w - d)) / 2e-5 for d in np.eye(14) * 1e-5]
    assert np.allclose(np.concatenate((g.emit.ravel(), g.step.ravel(), g.first)), slope, atol=1e-6)


def labelled(spark, n=60):
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 9)))
    good = lambda: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(r.randint(2, 6)))
    bad = lambda: "\n".join(" ".join(word().upper() + "!!" for _ in range(8)) + " | # &" for _ in range(r.randint(2, 6)))
    rows = [(i, good() if i % 2 else bad(), "x", 1) for i in range(n)]
    labels = [(i, i % 2) for i in range(n // 2)] + [(None, 1), (3, None), (10**6, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")


def test_texts_without_a_label_are_told_apart(spark):
    docs, labels = labelled(spark)
    field = quality.fit_lines(docs, labels)
    out = quality.quality_rules(docs, field).collect()
    assert all(r["kept"] == bool(r["doc_id"] % 2) for r in out if r["n_words"] >= 20)
    assert {r["doc_id"] for r in out} == set(range(60))
    mixed = "\n".join(["plain words of a quiet line that goes on and on to its end."] * 1 + ["other words of one more quiet line that goes on to its end too."] + ["BUY!! NOW!! | # & $$ **"] * 3)
    got = quality.quality_rules(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), field).first()
    assert got["labels"] == "ccbbb" and got["n_dup_lines"] == 2 and got["content_share"] == 28 / (28 + 21)


def test_without_labels_of_both_kinds_all_is_content(spark):
    docs, labels = labelled(spark)
    for some in (labels.filter("quality = 1"), labels.filter("false")):
        field = quality.fit_lines(docs, some)
        assert field is quality.CONTENT_ONLY
    out = quality.quality_rules(docs, field).collect()
    assert all(r["kept"] == (r["n_words"] >= 20) and r["content_share"] == 1 for r in out)


def test_rules_on_edges(spark):
    twenty = " ".join(f"word{i}" for i in range(20))
    rows = [(1, None), (2, ""), (3, "too few words"), (4, twenty), (5, twenty), (6, "a b c d e f g h " * 3), (None, twenty), (7, LONG * 40)]
    out = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), quality.CONTENT_ONLY).collect()}
    assert [out[i]["kept"] for i in (1, 2, 3, 4, 5, 6, None, 7)] == [False, False, False, True, True, False, True, False]
    assert out[1]["content_share"] is None and out[1]["labels"] == "" and out[6]["n_repeat_words"] == 24
    assert out[7]["n_words"] == 40 * 27000 - 39 and out[7]["base_failed"]  # the copies repeat each other
    assert quality.quality_rules(spark.createDataFrame([], "doc_id long, text string"), quality.CONTENT_ONLY).count() == 0


def test_the_query(spark, tmp_path):
    docs, labels = labelled(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = queries.op13_quality(spark, str(tmp_path))
    kinds = dict(out.dtypes)
    assert kinds["kept"] == kinds["base_failed"] == "boolean" and all(kinds[c] == "bigint" for c in ("doc_id", *BASE))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out.collect():
        n, chars, symbols, dup, repeat = counted(texts[r["doc_id"]])
        assert tuple(r[c] for c in BASE) == (n, chars, symbols, dup, repeat)
        failed = n < 20 or 100 * repeat > 30 * n
        assert r["base_failed"] == failed and not (failed and r["kept"])
