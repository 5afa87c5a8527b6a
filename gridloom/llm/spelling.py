"""Spelling variants: a trie of the vocabulary joined with itself by active-node sets, one partition of the trie at a time.

Two words at distance one are the same before and after the edit.  So with s the shorter one's length they share
their first s // 2 code points, or else their last: the vocabulary is cut into tries by prefix, and a second time, read
from the end, by suffix.  A trie that holds more words than a task should hold is cut again in the same way (what is left
of its words shares a half again), down to a single place, where the alphabet bounds it.  No trie is left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import materialise, row_slices

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Words of a trie above which it is cut again.
TRIE_WORDS = 2048


def document_words(doc_id: object, text: str, typo_every: int = 97) -> Counter:
    """Counts of a text's lower-cased runs of letters; a run whose hash with the id is a multiple of ``typo_every`` loses a code point."""
    out: Counter = Counter()
    head = b"" if doc_id is None else str(doc_id).encode()
    for run, times in Counter(_RUN.findall(text)).items():
        word = run.translate(_LOWER)
        h = zlib.crc32(head + b":" + word.encode())
        if typo_every and h % typo_every == 0:
            place = h % len(word)
            word = word[:place] + word[place + 1 :]
        out[word] += times
    return out


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, letters: int = 5, times: int = 3, typo_every: int = 97) -> DataFrame:
    """word, n: runs of letters of at least ``letters`` code points that occur ``times`` or more in the whole texts.

    Null and empty texts have no words, a null id counts as an empty one, repeated rows count each time.  Counts are
    summed a batch at a time in the task and again before the shuffle, so that a frequent word is a row a batch.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, max_bytes=1 << 22):
                found: Counter = Counter()
                for doc_id, text in zip(rows.column("id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    found.update({w: c for w, c in document_words(doc_id, text, typo_every).items() if len(w) >= letters})
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    texts = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: in the trie of its first half and in that of its last, with what is left of it.

    ``s`` is the length left of a trie's shorter words, ``left`` what is left of the word, ``path`` which halves were shared so far.
    """
    half, long = F.floor(F.col("s") / 2).cast("int"), F.char_length("left")
    first = F.struct(F.concat("path", F.lit("F")).alias("path"), F.concat("head", F.substring(F.col("left"), F.lit(1), half)).alias("head"), F.col("tail"), F.substring(F.col("left"), half + 1, long).alias("left"))
    last = F.struct(F.concat("path", F.lit("L")).alias("path"), F.col("head"), F.concat(F.substring(F.col("left"), long - half + 1, half), F.col("tail")).alias("tail"), F.substring(F.col("left"), F.lit(1), long - half).alias("left"))
    spread = rows.select("length", (F.col("s") - half).alias("s"), "word", "n", F.explode(F.array(first, last)).alias("x"))
    return spread.select("length", "s", "word", "n", "x.*")


_TRIE = ["length", "path", "head", "tail"]


def _tries(vocab: DataFrame, most: int) -> Iterator[DataFrame]:
    """Rows of the tries, in tables that don't overlap: those of at most ``most`` words, or of a single place, at each depth."""
    # A word is among the words of its own length, and the longer one among those of one less.
    length = F.char_length("word")
    start = vocab.select(F.explode(F.array(length, length - 1)).alias("length"), "word", "n").filter("length > 0")
    rows = start.select("length", F.col("length").alias("s"), "word", "n", F.lit("").alias("path"), F.lit("").alias("head"), F.lit("").alias("tail"), F.col("word").alias("left"))
    while True:
        rows = _halves(rows)
        sizes = rows.groupBy(*_TRIE, "s").agg(F.count(F.lit(1)).alias("words"))
        # Tries that are too large are few, each has more than ``most`` words; the others need no join.
        large = materialise(sizes.filter((F.col("words") > most) & (F.col("s") > 1)).select(*_TRIE))
        if large.isEmpty():
            yield rows
            return
        yield rows.join(large, _TRIE, "left_anti")
        rows = materialise(rows.join(large, _TRIE, "left_semi"))


def near_in_trie(words: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of places i < j of different ``words`` that differ by exactly one inserted, deleted or replaced code point.

    Walks the words' trie from its root.  Each node carries its active nodes: those whose string is at distance one from
    its own.  A child's active nodes are its parent, its siblings, its own children, and what the letter leads to from
    the parent's active nodes; where a word ends, the active nodes that end a word are its pairs.
    """
    children: list[dict[str, int]] = [{}]
    ends: list[int] = [-1]
    for i, word in enumerate(words):
        at = 0
        for c in word:
            below = children[at].get(c)
            if below is None:
                below = children[at][c] = len(children)
                children.append({})
                ends.append(-1)
            at = below
        ends[at] = i
    todo: list[tuple[int, set[int]]] = [(0, set(children[0].values()))]
    while todo:
        node, active = todo.pop()
        if ends[node] >= 0:
            yield from ((ends[node], ends[other]) for other in active if ends[other] > ends[node])
        below = children[node]
        for c, child in below.items():
            near = {children[other][c] for other in active if c in children[other]}
            near.add(node)
            near.update(other for other in below.values() if other != child)
            near.update(children[child].values())
            todo.append((child, near))


def _shares(path: str, length: int, a: str, b: str) -> bool:
    """Whether a pair belongs to this trie alone: at no turn to a last half did it share the first half, too."""
    s = length
    for turn in path:
        half = s // 2
        if turn == "L":
            if a[:half] == b[:half]:
                return False
            a, b = a[: len(a) - half], b[: len(b) - half]
        else:
            a, b = a[half:], b[half:]
        s -= half
    return True


def _join_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the tries of a partition, whose rows come trie by trie."""
    key, held, out = None, [], []

    def pairs() -> Iterator[tuple[str, int, str, int]]:
        if len(held) > 1:
            for i, j in near_in_trie([left for left, _, _ in held]):
                (_, a, n), (_, b, m) = held[i], held[j]
                if min(len(a), len(b)) == key[0] and _shares(key[1], key[0], a, b):
                    yield a, n, b, m

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "n", "other", "m"])

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in (*_TRIE, "left", "word", "n")]
        for *trie, left, word, n in zip(*cols, strict=True):
            if trie != key:
                out.extend(pairs())
                key, held = trie, []
            held.append((left, word, n))
        if len(out) > 50_000:
            yield flush()
            out = []
    out.extend(pairs())
    yield flush()


def near_words(vocab: DataFrame, trie_words: int = TRIE_WORDS) -> DataFrame:
    """word, n, other, m: each pair of words at distance one, once.  ``vocab`` holds each word once, without nulls."""
    found = None
    for rows in _tries(vocab, trie_words):
        # Most tries have one word: their rows needn't be sent to Python.
        crowd = F.count(F.lit(1)).over(Window.partitionBy(*_TRIE))
        crowded = rows.withColumn("_crowd", crowd).filter("_crowd > 1").select(*_TRIE, "left", "word", "n").sortWithinPartitions(*_TRIE)
        pairs = crowded.mapInArrow(_join_tries, "word string, n long, other string, m long")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def _rooted(forms: DataFrame) -> DataFrame:
    """word, root: the last word that the forms lead to.  Each turn looks twice as far, until nothing moves."""
    at = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialise(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return at


def spelling_variants(vocab: DataFrame, ratio: float = 2.0, trie_words: int = TRIE_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root of a vocabulary (word, n; each word once).

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that n is at least ``ratio``
    times its own, else null; its root is where forms lead in the end, itself without one.  As n doubles with each
    form, no forms go round in a circle.  An empty vocabulary has no rows.
    """
    if ratio <= 1:
        raise ValueError("a form occurs more often than its word")
    vocab = materialise(vocab)
    pairs = near_words(vocab, trie_words)
    turned = F.struct(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m"))
    both = pairs.select(F.explode(F.array(F.struct("word", "n", "other", "m"), turned)).alias("x")).select("x.*")
    alone = vocab.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("m"))
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("m")).alias("less"), F.col("other"))))
    seen = both.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), best.alias("best"))
    named = seen.select("word", "n", "n_near", F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best"))
    named = materialise(named.select("word", "n", "n_near", F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n")))
    roots = _rooted(named.filter("form is not null"))
    return named.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
