"""Near-duplicate documents by bottom-k sketches of word shingles.

One 63-bit hash function serves everything.  A document's set of shingle hashes,
sorted, starts with its bottom-k sketch.  Equal sets are folded into one class
first.  Inverted lists hold each class under its rarest retained values only: as
two linked sketches differ in few values, the rarest value that they share is among
so many rarest ones of both.  Passages that many documents quote are common values
and stay out of the lists, unless a document hardly holds anything else.

The classes that meet another one in a list are listed once more by their whole sets,
where that number is exact.  Every list names a leader, and members are compared with
leaders, never all with all.  Compared pairs pass the similarity estimate from the
union's sketch, then the exact count on whole sets.  What is linked is contracted to
components, and only members of one list that are still in different components meet
again: with other leaders, and at last those for which the place of a shared value
allows a link at all, so that no link is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import id_and_text, let_go, materialise, text_slices
from gridloom.llm.hashing import BASE, mix, span_hashes

SKETCH = 64
LEADER_ROUNDS = 2
#: Sampling deviations by which two sketches may differ more than their sets: one pair in some 10**9 goes beyond.
DEVIATIONS = 6.5
#: The estimate has a deviation below 0.05 at 64 values; pairs further below the threshold than this are dropped.
ESTIMATE_SLACK = 0.3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct hashes of ``width`` adjacent words.

    ``data`` holds the texts' UTF-8 bytes, ``offsets`` their bounds.  A text of fewer words gives one
    hash of its whole sequence, a text without words an empty array.
    """
    n_texts = len(offsets) - 1
    if not len(data):
        yield from (np.zeros(0, np.int64) for _ in range(n_texts))
        return
    word = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(word & np.concatenate(([True], ~word[:-1] | cut[1:-1])))
    ends = np.flatnonzero(word & np.concatenate((~word[1:] | cut[1:-1], [True]))) + 1
    words = span_hashes(_LOWER[data], starts, ends)
    bounds = np.searchsorted(starts, offsets)
    many = len(words) - width + 1
    rolled = words[: max(many, 0)].copy()
    for i in range(1, width):
        rolled = mix(rolled * np.uint64(BASE) + words[i : i + len(rolled)])
    for k in range(n_texts):
        a, b = bounds[k], bounds[k + 1]
        if b - a >= width:
            row = np.unique(rolled[a : b - width + 1])
        elif b > a:
            row = words[a : a + 1]
            for i in range(a + 1, b):
                row = mix(row * np.uint64(BASE) + words[i : i + 1])
            row = mix(row + np.uint64(b - a))
        else:
            row = words[:0]
        yield np.unique(row >> np.uint64(1)).astype(np.int64) if len(row) else np.zeros(0, np.int64)


def sketches(texts: DataFrame, width: int, k: int = SKETCH) -> DataFrame:
    """doc_id, n (size of the whole set), signature (of the whole set), sketch (its k least hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column("text")):
                sizes, marks, parts = [], [], []
                for row in shingle_sets(data, offsets, width):
                    sizes.append(len(row))
                    marks.append(hashlib.blake2b(row.tobytes(), digest_size=16).digest())
                    parts.append(row[:k])
                bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(parts)))],
                    ["doc_id", "n", "signature", "sketch"],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, n long, signature binary, sketch array<long>")


def whole_sets(texts: DataFrame, width: int) -> DataFrame:
    """doc_id, n and row (the sorted whole set), for documents whose sketch meets another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column("text")):
                parts = list(shingle_sets(data, offsets, width))
                sizes = [len(p) for p in parts]
                bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                rows = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), pa.array(sizes, pa.int64()), rows], ["doc_id", "n", "row"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, n long, row array<long>")


def connected_labels(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each node's connected component (edges: a, b).

    Rounds of taking the least label around and then the label's own label, each round checkpointed;
    the rounds grow with the logarithm of a component's diameter.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = materialise(both)
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = materialise(
            labels.join(around, "node")
            .join(jump, "label", "left")
            .select("node", F.least("label", "near", F.coalesce("far", "label")).alias("label"), F.col("label").alias("old"))
        )
        labels = new.select("node", "label")
        if new.filter("label <> old").isEmpty():
            return labels


def _rarest(sets: DataFrame, need: Column, size: Column) -> DataFrame:
    """rep, n, at, weight, value: a row for each value that lists a class.

    ``sets`` has rep, n and the array ``row`` of ``size`` values.  Values are ordered by the classes that hold
    them, then by themselves; ``at`` is a value's place in its class.  Of the ``need`` first of a class those
    that no other class holds list nothing; ``weight`` is how many classes hold a value of this class, on average.
    """
    values = sets.select("rep", F.col("n").cast("int").alias("n"), F.explode("row").alias("value"))
    # Written, so that both sides of the join are plain shuffles: Spark then splits a value that many classes hold.
    shared = materialise(values.groupBy("value").agg(F.count("*").alias("members")).filter("members > 1"))
    # In one number: the count, as far as it orders, above 48 bits of the hash.
    key = F.shiftleft(F.least(F.col("members"), F.lit(32767)).cast("long"), 48) + F.shiftrightunsigned("value", 15)
    # A repeated row counts its values twice, which lists more than is needed; the set keeps each once.
    held = values.join(shared, "value").select("rep", "n", key.alias("key")).groupBy("rep", "n").agg(F.array_sort(F.collect_set("key")).alias("held"))
    alone = size - F.size("held")
    weight = F.aggregate("held", F.lit(0.0), lambda a, x: a + F.shiftright(x, 48)) / size
    few = held.withColumns({"alone": alone, "weight": weight, "rest": need - alone}).filter("rest > 0")
    return few.select("rep", "n", "alone", "weight", F.posexplode(F.slice("held", F.lit(1), F.col("rest"))).alias("place", "value")).select("rep", "n", (F.col("alone") + F.col("place")).alias("at"), "weight", "value")


def whole_need(percent: int) -> Column:
    """Of so many rarest values of a set of n, one at least is among as many of each linked set."""
    return (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")


def sketch_need(percent: int, k: int) -> Column:
    """The same for the sketches.

    Of the k least values of the union of two linked sets each is in both with a probability of percent / 100
    at least, drawn without replacement from a union of at most n * 100 / percent.
    """
    share, n = percent / 100, F.col("n")
    spread = F.greatest(F.lit(0.0), 1 - (k - 1) / F.greatest(F.lit(1.0), n / share - 1))
    common = F.floor(share * k - DEVIATIONS * F.sqrt(share * (1 - share) * k * spread))
    sampled = F.when(n > share * k, F.least(n, F.lit(k)) - common + 1).otherwise(0)
    return F.least(F.lit(k), F.greatest(sampled, F.when(n <= k, whole_need(percent)).otherwise(0))).cast("int")


def _met(lists: DataFrame) -> DataFrame:
    """rep of the classes that share a list with another class."""
    lists = materialise(lists.select("rep", "value"))  # read twice, made once
    several = materialise(lists.groupBy("value").agg(F.count("*").alias("members")).filter("members > 1").select("value"))
    return lists.join(several, "value").select("rep").distinct()


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, sketch: int = SKETCH) -> DataFrame:
    """Components of documents whose sets of ``width``-word shingles overlap by ``percent`` or more.

    Words are maximal runs of characters other than space and U+0009 to U+000D, with A-Z lower-cased.
    Two documents are linked if 100 * intersection >= percent * union; percent must be 80 to 100.
    Returns a row for each input row: the id column, n_shingles, component_id (the least id that links
    reach, its own included) and kept (the id is its component's).  A text without words, or null, has
    no shingles and is linked with nothing; a text of fewer than ``width`` words counts as one shingle.
    Rows that repeat an id should repeat its text, and repeat its result.  Rows with a null id are compared like others; their
    component is the least id that links reach, or null if there is none, and kept is null.  An empty table gives no rows.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100: the sketches are laid out for such links")
    texts = id_and_text(df, id_col, text_col)
    docs = materialise(sketches(texts, width, sketch))
    classes = docs.filter("n > 0").groupBy("signature").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("row"))
    classes = materialise(classes)
    met = materialise(_met(_rarest(classes, sketch_need(percent, sketch), F.least(F.col("n"), F.lit(sketch)))))
    let_go(df.sparkSession)
    sets = whole_sets(texts.join(met.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), width)
    sets = materialise(sets.withColumnRenamed("doc_id", "rep"))
    lists = materialise(_rarest(sets, whole_need(percent), F.col("n")))
    labels = _link(lists, sets, percent, sketch)

    placed = classes.select("signature", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("signature", F.coalesce("label", "rep").alias("component"))
    # Documents without shingles get a key of their own, so that they don't meet in one task.
    signature = F.when(F.col("n") > 0, F.col("signature")).otherwise(F.encode(F.concat(F.lit("empty "), F.col("doc_id").cast("string")), "UTF-8"))
    component = F.coalesce("component", "doc_id")
    return (
        docs.select("doc_id", "n", signature.alias("signature"))
        .join(placed, "signature", "left")
        .select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    )


def _link(lists: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """node, label of the classes that may be linked with others."""
    labels = sets.select(F.col("rep").alias("node"), F.col("rep").alias("label"))
    tested = None
    for turn in range(LEADER_ROUNDS + 1):
        let_go(lists.sparkSession)
        marked = lists.select("rep", "n", "at", "weight", "value").join(labels.withColumnRenamed("node", "rep"), "rep")
        # Lists whose members are all in one component are settled for good.
        of_list = [F.min("label").alias("low"), F.max("label").alias("high"), F.min("at").alias("least_at")]
        still_open = materialise(marked.groupBy("value").agg(*of_list, F.min(_leader(turn)).alias("x")).filter("low <> high").drop("low", "high"))
        lists = materialise(marked.join(still_open, "value"))
        if lists.isEmpty():
            break
        pairs = _pairs(lists, turn, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs)
        found = materialise(_verify(pairs, sets, percent, k))
        tested = pairs.select("a", "b") if tested is None else tested.union(pairs.select("a", "b"))
        if found.isEmpty():
            continue
        # The components so far are the nodes, so what was linked before isn't walked again.
        moved = connected_labels(found.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("least"))
        labels = materialise(labels.join(moved, "label", "left").select("node", F.coalesce("least", "label").alias("label")))
    return labels


#: What a member that is compared with is called.
_OTHER = {"rep": "head", "n": "m", "at": "other_at", "label": "other"}


def _leader(turn: int) -> Column:
    """What is least for a list's leader in this turn, with its columns."""
    # A set whose values many others hold leads first: of copies with edits the one with the fewest.
    first = -F.col("weight") if turn == 0 else F.xxhash64("rep").cast("double")
    return F.struct(first.alias("first"), *_OTHER)


def _pairs(marked: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs a < b to compare in this turn, with their labels; marked has value, rep, n, at, weight, label, x (the list's leader) and least_at, of lists with several labels."""
    # In the list of the first value that both hold, nothing before it is common: so two linked sets pass in one list at least.
    fits = F.expr(f"100 * least(n - at, m - other_at) >= {percent} * (n + m - least(n - at, m - other_at)) and label <> other")
    ordered = F.expr("struct(least(rep, head) as a, greatest(rep, head) as b, if(rep < head, label, other) as label_a, if(rep < head, other, label) as label_b)")
    if turn < LEADER_ROUNDS:
        meet = marked.select("*", *[F.col(f"x.{c}").alias(as_) for c, as_ in _OTHER.items()]).filter(fits)
        if turn:
            return meet.select(ordered.alias("p")).select("p.*").distinct()
        # At first each class meets only the leader with which it shares most lists.
        votes = meet.groupBy("rep", "label", "head", "other").agg(F.count("*").alias("votes"))
        best = votes.groupBy("rep", "label").agg(F.min(F.struct(-F.col("votes"), F.col("head"), F.col("other"))).alias("best"))
        return best.select("rep", "label", "best.head", "best.other").select(ordered.alias("p")).select("p.*").distinct()
    # Members that leaders left in different components: what is not compared yet is compared now.  A partner's first
    # common value has ``least_at`` values before it at least, so who can't fit even the best partner meets none.
    marked = marked.filter(f"100 * (n - at) >= {percent} * (n + least_at)")
    other = marked.select("value", *[F.col(c).alias(as_) for c, as_ in _OTHER.items()])
    return marked.join(other, "value").filter(fits & (F.col("rep") < F.col("head"))).select(ordered.alias("p")).select("p.*").distinct()


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs that are linked, with their labels: the union's sketch estimates, whole sets decide."""
    ends = ["a", "b", "label_a", "label_b"]
    drawn = pairs
    for name in ("a", "b"):
        drawn = drawn.join(sets.select(F.col("rep").alias(name), F.slice("row", 1, k).alias(f"sketch_{name}")), name)
    drawn = drawn.withColumn("u", F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k))
    both = F.size(F.array_intersect(F.array_intersect("u", "sketch_a"), "sketch_b"))
    whole = drawn.filter(both >= (percent / 100 - ESTIMATE_SLACK) * F.size("u")).select(*ends)
    for name in ("b", "a"):
        whole = whole.join(sets.select(F.col("rep").alias(name), F.col("row").alias(f"whole_{name}")), name)
    # A set's values are distinct, so the two sizes and that of the intersection tell the union's.
    whole = whole.withColumn("common", F.size(F.array_intersect("whole_a", "whole_b"))).withColumn("total", F.size("whole_a") + F.size("whole_b") - F.col("common"))
    return whole.filter(f"100 * common >= {percent} * total").select(*ends)
