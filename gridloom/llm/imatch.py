"""I-Match document fingerprints in DataFrame operations only.

Terms are hashed to 64 bits and each term's documents are counted over all rows.  Those within
a band of inverse document frequency are the lexicon.  A document keeps its terms of the
lexicon, sorted and distinct, and hashes them under randomised subsets of the lexicon at several
rates: long documents are told apart and found again by thin subsets, short ones by thick ones.

The lexicon's size is bounded at every input size: as a term is in one of 13,000 documents at
least, there are no more than 13,000 terms for each distinct term of a document on average.  Tasks
get it as one value, of some 20 bytes a term, and look terms up in it exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import id_and_text, materialise

SUBSETS = 16
#: One subset of a scale keeps one of so many terms of the lexicon.
RATES = (4, 16, 64, 256, 1024)
#: Terms in more than a tenth of the documents, or in fewer than one of 13,000, are outside the band.
MIN_IDF, MAX_IDF = math.log(10), math.log(13_000)
#: Bytes of text that a task joins at a time.
TASK_BYTES = 1 << 25


def term_hashes(text: Column) -> Column:
    """Sorted distinct 64-bit hashes of the lower-cased runs without white space or ASCII punctuation."""
    words = F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda w: w != "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def lexicon(texts: DataFrame, *, min_idf: float = MIN_IDF, max_idf: float = MAX_IDF) -> DataFrame:
    """The hashes of the terms in the band, as a written table of ``term``; document counts are those of each term over all rows."""
    counted = texts.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(float(max(texts.count(), 1))) / F.col("df"))
    return materialise(counted.filter((idf >= min_idf) & (idf <= max_idf)).select("term"))


def shelves(terms: DataFrame) -> tuple[Column, int]:
    """The terms dealt to 2**bits shelves by their leading bits, and the bits: 2 to 4 terms a shelf, some 20 bytes a term.

    The column is a scalar subquery, of one row: Spark hands its value to tasks, and a plan's text shows its name only.
    """
    bits = max(1, (terms.count() // 4).bit_length())
    place = F.shiftrightunsigned("term", 64 - bits)
    filled = terms.groupBy(place.alias("at")).agg(F.collect_list("term").alias("held"))
    every = terms.sparkSession.range(1 << bits).select(F.col("id").alias("at")).join(filled, "at", "left")
    held = F.coalesce("held", F.array().cast("array<bigint>")).alias("held")
    row = every.agg(F.sort_array(F.collect_list(F.struct("at", held))).alias("shelves"))
    return row.select(F.transform("shelves", lambda s: s["held"]).alias("shelves")).scalar(), bits


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_terms(df: DataFrame, text: Column, text_col: str, terms_col: str, shelves: Column, bits: int) -> DataFrame:
    """Adds the text and its terms in the lexicon, sorted and distinct; all its terms if none is in the lexicon.

    The shelves are a column that is named once, over the input's own columns, and dropped: the optimizer puts the
    subquery in its place, so that no row carries them.  (Written there, Spark refuses a subquery beside lambdas.)
    """

    def stands(t: Column, shelves: Column) -> Column:
        return F.exists(F.get(shelves, F.shiftrightunsigned(t, 64 - bits).cast("int")), lambda held: held == t)

    def chosen(row: Column) -> Column:
        every = term_hashes(row["text"])
        known = lambda terms: F.filter(terms, lambda t: stands(t, row["shelves"]))
        pick = lambda terms: _let(known(terms), lambda own: F.when(F.size(own) > 0, own).otherwise(terms))
        return F.struct(row["text"].alias("text"), _let(every, pick).alias("terms"))

    kept = [c for c in df.columns if c != text_col]
    found = _let(F.struct(F.col("_shelves").alias("shelves"), text.alias("text")), chosen).alias("_found")
    out = df.withColumn("_shelves", shelves).select(*kept, found)
    return out.select(*kept, F.col("_found.text").alias(text_col), F.col("_found.terms").alias(terms_col))


def fingerprint(text: Column, text_col: str, out_col: str, terms: tuple[Column, int]):
    """A function of DataFrames that adds ``text`` as ``text_col`` and its 80 hashes as ``out_col``, 0 for an empty subset.

    ``terms`` is ``shelves`` of the lexicon.  A text without a term in the lexicon is hashed by all its terms; one
    without terms has zeros only.
    """

    def hashed(terms: Column) -> Column:
        return F.when(F.size(terms) == 0, 0).otherwise(F.hash(terms))

    def add(df: DataFrame) -> DataFrame:
        df = with_terms(df, text, text_col, "_terms", *terms)
        parts = []
        for rate in RATES:
            if rate < SUBSETS:
                # Independent subsets: subset j reads bits of its own.
                bits = rate.bit_length() - 1
                parts.append(f"transform(sequence(0, {SUBSETS - 1}), j -> filter(_terms, t -> (shiftright(t, {bits} * j) & {rate - 1}) = 0))")
            else:
                # Disjoint: what a thin rate keeps is dealt by two bits, and each hand by two more.
                kept = "_terms" if rate == SUBSETS else f"filter(_terms, t -> (shiftright(t, 36) & {rate // SUBSETS - 1}) = 0)"
                hands = "transform(sequence(0, 3), i -> filter({0}, t -> (shiftright(t, {1}) & 3) = i))"
                df = df.withColumn(f"_r{rate}", F.expr(kept)).withColumn(f"_h{rate}", F.expr(hands.format(f"_r{rate}", 34)))
                parts.append(f"flatten(transform(_h{rate}, h -> {hands.format('h', 32)}))")
        sets = F.concat(*[F.expr(p) for p in parts])
        df = df.withColumn(out_col, F.transform(sets, hashed))
        return df.drop("_terms", *[f"_{x}{r}" for r in RATES for x in "rh"])

    return add


def fingerprint_text(signature: str) -> Column:
    """The signature's hashes in hexadecimal, joined by commas."""
    return F.array_join(F.transform(signature, lambda x: F.when(x == 0, "").otherwise(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))))), ",")


def likeness(a: str, b: str) -> Column:
    """0 to 1 of two signature arrays: 1 if equal, else the best scale's share of equal non-empty subsets."""
    shares = []
    for i in range(len(RATES)):
        pairs = f"zip_with(slice({a}, {i * SUBSETS + 1}, {SUBSETS}), slice({b}, {i * SUBSETS + 1}, {SUBSETS}), (x, y) -> named_struct('hit', x = y and x <> 0, 'any', x <> 0 or y <> 0))"
        shares.append(f"size(filter({pairs}, p -> p.hit)) / greatest(size(filter({pairs}, p -> p.any)), 4)")
    return F.expr(f"case when {a} = {b} then 1.0D else cast(greatest({', '.join(shares)}) as double) end")


def next_keys(named: DataFrame) -> DataFrame:
    """Of rows that ``k1`` and ``k2`` name, who follows whom: k1, k2, n, n1, n2 (the next row's name) and times.

    Rows are ordered by doc_id (null first), then name; after the last comes the first.  Equal rows (same id and text) follow
    one another: they are one name, whose ``times`` - 1 = copies - 1 rows are followed by their like.  Only ids, names
    and lengths are sorted: in ranges, of which each one's last row gets the next range's first.
    """
    narrow = named.groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies"))
    ranged = materialise(narrow.repartitionByRange("doc_id", "k1", "k2").withColumn("part", F.spark_partition_id()))
    name = F.struct("k1", "k2")
    heads = ranged.groupBy("part").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("head"))
    parts = Window.orderBy("part")  # a row for each range
    ring = heads.select("part", F.coalesce(F.lead("head").over(parts), F.first("head").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    follow = F.lead(name).over(Window.partitionBy("part").orderBy("doc_id", "k1", "k2"))
    placed = ranged.withColumn("after", follow).join(ring, "part").withColumn("after", F.coalesce("after", F.struct("head.k1", "head.k2")))
    link = lambda to, times: F.struct(to["k1"].alias("n1"), to["k2"].alias("n2"), times.cast("int").alias("times"))
    last = link(F.col("after"), F.lit(1))
    links = F.when(F.col("copies") > 1, F.array(last, link(name, F.col("copies") - 1))).otherwise(F.array(last))
    return placed.select("k1", "k2", "n", F.explode(links).alias("link")).select("k1", "k2", "n", "link.*")


def next_likeness(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = TASK_BYTES) -> DataFrame:
    """Fingerprints of each text and of the same text with its last quarter replaced by the next text's start.

    Returns the id column, n_chars, edited, fingerprint, edited_fingerprint, near_edited and near_next (likeness to
    the edited text and to the next row's text) and next_id, for each row.  Rows are ordered by id, of any type that can be ordered, null
    first; rows of one id follow in an order by a hash of their texts, and equal rows give equal results but for
    the last of them.  A null text is empty, and has no terms; a text of 1 to 3 characters has no quarter and is
    its own edited text.  An empty table gives no rows; a single row is its own next one.

    Whole texts are shuffled once, by the hashes that name them.  Each row is joined to the name of the row before it and sends
    that one its first characters and its fingerprint, by a second, smaller shuffle.
    """
    texts = id_and_text(df, id_col, text_col)
    terms = shelves(lexicon(texts))
    name = {k: F.xxhash64(F.lit(i), "doc_id", "text") for i, k in enumerate(("k1", "k2"))}
    quarter = F.floor(F.col("n") / 4).cast("int")
    named = texts.select("doc_id", F.length("text").alias("n"), *[c.alias(k) for k, c in name.items()])
    links = next_keys(named)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = fingerprint(F.col("text"), "text", "print", terms)(texts.withColumns(name))
    # A name's partition is fixed here, so that both joins below read one and the same shuffle.
    rows = rows.repartition(max(2, math.ceil(size / task_bytes)), "k1", "k2").dropDuplicates(["k1", "k2"])
    sent = rows.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), "doc_id", "text", "print").join(links.hint("shuffle_hash"), ["n1", "n2"])
    sent = sent.select("k1", "k2", "n", "times", F.col("doc_id").alias("next_id"), F.substring("text", F.lit(1), quarter).alias("start"), F.col("print").alias("next_print"))
    paired = rows.join(sent, ["k1", "k2"]).select("doc_id", "text", "start", "n", "times", "next_id", "print", "next_print")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - quarter), "start")
    out = fingerprint(edited, "edited", "edited_print", terms)(paired).drop("text", "start")
    out = out.select(
        F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_chars"), "edited", fingerprint_text("print").alias("fingerprint"), fingerprint_text("edited_print").alias("edited_fingerprint"),
        likeness("print", "edited_print").alias("near_edited"), likeness("print", "next_print").alias("near_next"), "next_id", "times",
    )
    return out.withColumn("times", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("times")
