"""Quality rules: a linear-chain conditional random field labels a text's lines as content or boilerplate.

Its Viterbi decoding decides by the share of words in content lines whether a text is kept; plain counts of a text and
two of the common rules on them stand beside it.  Counts and features are taken from UTF-8 bytes with numpy, many texts
at a time; only the field's weights come from labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import row_slices

#: Whether a byte is whitespace between words, a symbol, an ASCII letter, an upper-case one, a digit, other punctuation.
_SPACE, _SYMBOL, _LETTER, _UPPER, _DIGIT = (np.isin(np.arange(256), list(b)) for b in (b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91)) + bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789"))
_OTHER = (np.arange(256) > 32) & (np.arange(256) < 127) & ~_SYMBOL & ~_LETTER & ~_DIGIT
#: Words of a window that counts as repeated.
WINDOW = 8
#: The features of a line, each from 0 to 1.
FEATURES = ("always", "symbols", "upper", "digits", "marks", "odd_endings", "repeated_windows", "same_words", "same_line", "short", "long_words", "no_end", "first", "last")


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers that are equal where both are."""
    return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1]


@dataclass
class Lines:
    """Texts in parts: counts by text, and by line with a word the text, the words and the features."""

    counts: dict[str, np.ndarray]
    doc: np.ndarray
    words: np.ndarray
    features: np.ndarray


def read_lines(texts: list[str | None]) -> Lines:
    """Counts and line features of one or more whole texts (null: no words)."""
    raw = [(t or "").encode() for t in texts]
    n = len(raw)
    whole = b"\n".join(raw)
    data = np.frombuffer(whole, dtype=np.uint8)
    size = np.array([len(r) for r in raw], dtype=np.int64)
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1])) if n else np.zeros(0, np.int64)
    breaks = np.flatnonzero(data == 10)
    line_at = np.concatenate(([0], breaks + 1))  # where each line begins; a text's first line begins with it
    line_end = np.concatenate((breaks, [len(data)]))
    line_doc = np.searchsorted(start, line_at, side="right") - 1
    by_doc = lambda doc, x: np.bincount(doc, weights=x, minlength=n).astype(np.int64)

    running = lambda table: np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
    in_line = lambda table: (lambda c: c[line_end] - c[line_at])(running(table))
    space = _SPACE[data]
    points = running((np.arange(256) & 0xC0 != 0x80) & ~_SPACE)
    symbols = in_line(_SYMBOL)
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1 if len(data) else np.zeros(0, np.int64)
    word_line = np.searchsorted(line_at, begins, side="right") - 1
    word_doc = line_doc[word_line]
    numbers: dict[bytes, int] = {}
    word = np.fromiter((numbers.setdefault(w, len(numbers)) for w in whole.split()), dtype=np.int64, count=len(begins))
    n_words = np.bincount(word_line, minlength=len(line_at))

    covered = np.zeros(len(word), dtype=bool)
    if len(word) >= WINDOW:
        rank, width = word, 1
        while width < WINDOW:
            rank, width = _ranks(rank[: len(rank) - width], rank[width:]), 2 * width
        inside = word_doc[: len(rank)] == word_doc[WINDOW - 1 :]
        places = np.flatnonzero(inside)
        if len(places):
            _, window, times = np.unique(word_doc[places] * (int(rank.max()) + 1) + rank[places], return_inverse=True, return_counts=True)
            twice = places[times[window] > 1]
            step = np.zeros(len(word) + 1, dtype=np.int64)
            np.add.at(step, twice, 1)
            np.add.at(step, twice + WINDOW, -1)
            covered = np.cumsum(step[:-1]) > 0

    # A line is known by its number among the different ones of its text.
    seen: dict[tuple[int, bytes], int] = {}
    same_line = np.zeros(len(line_at), dtype=bool)
    for i, (d, line) in enumerate(zip(line_doc.tolist(), whole.split(b"\n"), strict=True)):
        if n_words[i]:
            same_line[i] = seen.setdefault((d, line), i) != i
    counts = {
        "n_words": by_doc(line_doc, n_words), "word_chars": by_doc(line_doc, points[line_end] - points[line_at]), "n_symbols": by_doc(line_doc, symbols),
        "n_dup_lines": by_doc(line_doc, same_line), "n_repeat_words": by_doc(word_doc, covered),
    }

    used = np.flatnonzero(n_words)
    of_line = lambda x: np.bincount(word_line, weights=x, minlength=len(line_at))[used]
    size_of, words = np.maximum(1, (points[line_end] - points[line_at])[used]), n_words[used]
    letters = in_line(_LETTER)[used]
    odd = ~(_LETTER[data[ends - 1]] | _DIGIT[data[ends - 1]] | (data[ends - 1] >= 128) | np.isin(data[ends - 1], list(b".,;:"))) if len(ends) else np.zeros(0, bool)
    different = np.bincount(np.unique(np.stack((word_line, word)), axis=1)[0], minlength=len(line_at))[used] if len(word) else np.zeros(0)
    doc = line_doc[used]
    last_word = np.searchsorted(word_line, used, side="right") - 1
    end = np.isin(data[ends[last_word] - 1], list(b".!?:;\"'")) if len(used) else np.zeros(0, bool)
    edge = np.concatenate(([True], doc[1:] != doc[:-1])) if len(used) else np.zeros(0, bool)
    features = np.stack(
        [
            np.ones(len(used)), symbols[used] / size_of, in_line(_UPPER)[used] / np.maximum(1, letters), in_line(_DIGIT)[used] / size_of, in_line(_OTHER)[used] / size_of,
            of_line(odd) / words, of_line(covered) / words, 1 - different / words, same_line[used], words < 5, np.minimum(1, size_of / words / 20), ~end, edge, np.concatenate((edge[1:], [True])) if len(used) else edge,
        ],
        axis=1,
    ).astype(np.float64)
    return Lines(counts, doc, words, features)


@dataclass(frozen=True)
class LineField:
    """A linear-chain field of two labels, content 0 and boilerplate 1: weights of each label's features, of a step from one to another, and of the first."""

    emit: np.ndarray  # 2 by features
    step: np.ndarray  # 2 by 2
    first: np.ndarray  # 2


#: Without labelled texts of both kinds every line is content.
CONTENT_ONLY = LineField(np.array([[1.0] + [0.0] * (len(FEATURES) - 1), [0.0] * len(FEATURES)]), np.zeros((2, 2)), np.zeros(2))


def viterbi(scores: np.ndarray, step: np.ndarray, first: np.ndarray) -> list[int]:
    """The likeliest labels of one text's lines from their scores (line by label); of equal ones content."""
    (s00, s01), (s10, s11) = step.tolist()
    rows = scores.tolist()
    if not rows:
        return []
    a, b = rows[0][0] + float(first[0]), rows[0][1] + float(first[1])
    back: list[tuple[int, int]] = []
    for e0, e1 in rows[1:]:
        from0, from1 = (0 if a + s00 >= b + s10 else 1), (0 if a + s01 >= b + s11 else 1)
        a, b = (a + s00 if from0 == 0 else b + s10) + e0, (a + s01 if from1 == 0 else b + s11) + e1
        back.append((from0, from1))
    label = 0 if a >= b else 1
    out = [label]
    for pair in reversed(back):
        label = pair[label]
        out.append(label)
    return out[::-1]


def _log_add(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def likelihood(field: LineField, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> tuple[float, LineField]:
    """Log-likelihood of labels and its gradient.  ``x`` is text by line by feature, ``y`` text by line, ``size`` lines of each text (falling, none 0)."""
    n, most, _ = x.shape
    live = np.arange(most)[None, :] < size[:, None]
    scores = x @ field.emit.T
    alpha, beta = np.zeros((n, most, 2)), np.zeros((n, most, 2))
    alpha[:, 0] = scores[:, 0] + field.first
    for t in range(1, most):
        m = np.searchsorted(-size, -t, side="left")  # texts with more than t lines
        alpha[:m, t] = scores[:m, t] + _log_add(alpha[:m, t - 1, :, None] + field.step[None], 1)
    pair = np.zeros((2, 2))
    total = _log_add(alpha[np.arange(n), size - 1], 1)
    for t in range(most - 2, -1, -1):
        m = np.searchsorted(-size, -(t + 1), side="left")
        on = (scores[:m, t + 1] + beta[:m, t + 1])[:, None, :]
        beta[:m, t] = _log_add(field.step[None] + on, 2)
        pair += np.exp(alpha[:m, t, :, None] + field.step[None] + on - total[:m, None, None]).sum(axis=0)
    p = np.exp(alpha + beta - total[:, None, None]) * live[..., None]
    truth = np.stack((y == 0, y == 1), axis=2) * live[..., None]
    both = live[:, 1:]
    seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], dtype=float)
    value = (scores * truth).sum() + (field.step * seen).sum() + (field.first * truth[:, 0]).sum() - total.sum()
    return float(value), LineField(np.einsum("ntk,ntf->kf", truth - p, x), seen - pair, (truth - p)[:, 0].sum(axis=0))


def train(x: np.ndarray, y: np.ndarray, size: np.ndarray, *, rounds: int = 150, penalty: float = 0.01, rate: float = 0.2) -> LineField:
    """Maximum likelihood a line with a squared penalty, by Adam's steps from 0; the same input gives the same weights."""
    lines, width = float(size.sum()), x.shape[2]
    w = np.zeros(2 * width + 6)
    part = lambda v: LineField(v[: 2 * width].reshape(2, width), v[2 * width : -2].reshape(2, 2), v[-2:])
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, rounds + 1):
        g = likelihood(part(w), x, y, size)[1]
        g = np.concatenate((g.emit.ravel(), g.step.ravel(), g.first)) / lines - penalty * w
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        w = w + rate * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.999**i)) + 1e-8)
    return part(w)


def fit_lines(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality: str = "quality", *, texts: int = 1500, most_lines: int = 128) -> LineField:
    """Fits the field on at most ``texts`` labelled texts of either quality, those of the lowest hashed ids.

    A text's lines take its label (1: content, 0: boilerplate).  A sampled text of more than ``most_lines`` lines is
    left out of the fit, which bounds what the driver holds; it is judged like any other.  Null labels, ids and texts
    teach nothing; without texts of both qualities every line is content.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(quality).alias("q")).filter("id is not null and q in (0, 1)").distinct()
    lowest = [known.filter(F.col("q") == q).orderBy(F.xxhash64("id"), "id").limit(texts) for q in (0, 1)]
    picked = lowest[0].unionByName(lowest[1])  # at most 2 * texts rows: small enough to send to every task
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").join(F.broadcast(picked), "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch):
                read = read_lines(part.column("text").to_pylist())
                at = np.searchsorted(read.doc, np.arange(len(part) + 1))
                few = [d for d in range(len(part)) if 0 < at[d + 1] - at[d] <= most_lines]
                cols = [pa.array([part.column(c)[d].as_py() for d in few], t) for c, t in (("hash", pa.int64()), ("q", pa.int64()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([read.features[at[d] : at[d + 1]].tobytes() for d in few], pa.binary())], names=["hash", "q", "x"])

    found = rows.select(F.xxhash64("id").alias("hash"), F.col("q").cast("long").alias("q"), "text").mapInArrow(features, "hash long, q long, x binary")
    # Ids that repeat among the documents could be many: again the lowest of either quality.
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("hash", "x"))).filter(F.col("place") <= texts).drop("place")
    sample = sorted(((r["q"], np.frombuffer(r["x"]).reshape(-1, len(FEATURES))) for r in found.collect()), key=lambda s: (-len(s[1]), s[0], s[1].tobytes()))
    if len({q for q, _ in sample}) < 2:
        return CONTENT_ONLY
    size = np.array([len(x) for _, x in sample])
    x, y = np.zeros((len(sample), int(size[0]), len(FEATURES))), np.zeros((len(sample), int(size[0])), dtype=np.int64)
    for i, (q, lines) in enumerate(sample):
        x[i, : len(lines)], y[i] = lines, 1 - q
    return train(x, y, size)


RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean, labels string"


def quality_rules(df: DataFrame, field: LineField, text_col: str = "text", *, least_words: int = 20, most_repeated: int = 30, least_content: float = 0.5) -> DataFrame:
    """Each row with the columns of ``RULES`` (those of the same names are replaced).

    ``labels`` has a letter for each line with a word, c for content and b for boilerplate; ``content_share`` is the share of words
    in content lines, null without words.  A text fails by fewer than ``least_words`` words or more than ``most_repeated``
    percent of them in repeated windows; it is kept if it doesn't fail and its content share is at least ``least_content``.
    Null and empty texts have no words and aren't kept; equal texts get equal results, however often they stand there.
    A text is read whole in one task, which takes some fifty times its bytes for a moment.
    """
    emit, step, first = field.emit, field.step, field.first

    @F.arrow_udf(RULES)
    def judge(column: pa.Array) -> pa.Array:
        rows: dict[str, list] = {c.split()[0]: [] for c in RULES.split(", ")}
        for part in row_slices(pa.RecordBatch.from_arrays([column], names=["text"]), max_bytes=1 << 19):
            read = read_lines(part.column(0).to_pylist())
            at = np.searchsorted(read.doc, np.arange(len(part) + 1))
            scores = read.features @ emit.T
            for name, values in read.counts.items():
                rows[name].extend(values.tolist())
            for d, (words, repeated) in enumerate(zip(read.counts["n_words"].tolist(), read.counts["n_repeat_words"].tolist(), strict=True)):
                labels = viterbi(scores[at[d] : at[d + 1]], step, first)
                content = sum(w for w, label in zip(read.words[at[d] : at[d + 1]].tolist(), labels, strict=True) if label == 0)
                failed = words < least_words or 100 * repeated > most_repeated * words
                rows["base_failed"].append(failed)
                rows["content_share"].append(content / words if words else None)
                rows["kept"].append(not failed and content >= least_content * words)
                rows["labels"].append("".join("cb"[label] for label in labels))
        kinds = (*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.bool_(), pa.string())
        return pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], names=list(rows))

    names = [c.split()[0] for c in RULES.split(", ")]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(*kept, judge(text).alias("_rules")).select(*kept, *[F.col(f"_rules.{c}").alias(c) for c in names])
