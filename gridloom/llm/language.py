"""Language identification by compression.

For each language some labelled text is kept as a raw-content dictionary.  A text is
compressed with every dictionary; the smallest result names the language, and a narrow
margin to the next one makes the prediction a rejected one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.llm.common import id_and_text, row_slices

NO_LANGUAGE = "und"
LEVEL = 12
WINDOW = 4096
_LETTERS = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def letters_only(text: str) -> bytes:
    """Lower-cased UTF-8 with everything in ASCII but letters as single spaces, and one at each end."""
    return b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "


def fit_dictionaries(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", docs: int = 256, size: int = 110_000, most_labels: int = 256) -> dict[str, tuple[int, bytes]]:
    """Label -> (labelled rows, dictionary) from rows whose label and text aren't null.

    The dictionaries are made of a bounded sample: of each label the ``docs`` rows of least hash of id
    (ties by id), each giving at most ``size`` / 8 characters, until ``size`` bytes are full.  So at most
    ``most_labels`` * ``docs`` short strings reach the driver, whatever the input.  Row counts cover all rows.
    Of more labels than ``most_labels`` the most frequent are learned (ties by name); the others' rows get one of
    these, or are rejected.  Repeated rows count as often as they stand and are sampled once, of an id with several texts the least.  Without a labelled row there is no dictionary.
    """
    labelled = df.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    counted = labelled.groupBy("label").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id", 0.05).alias("ids")).orderBy(F.desc("n"), "label").limit(most_labels).collect()
    rows = {r["label"]: r["n"] for r in counted}
    if not rows:
        return {}
    # The ids are chosen on narrow rows; only then are their texts fetched, by a broadcast of at most labels * docs rows.
    # A bound on the hash leaves about twice the ids asked for of a label, and those are ranked.
    drawn = F.xxhash64(F.col("doc_id").cast("string"))
    share = F.create_map(*[F.lit(x) for r in counted for x in (r["label"], min(1.0, (2.0 * docs + 64) / max(r["ids"], 1)))])
    few = labelled.select(F.col("doc_id").alias("id"), F.col("label").alias("of"), drawn.alias("drawn")).filter((F.shiftrightunsigned("drawn", 11) / float(1 << 53)) < F.try_element_at(share, F.col("of"))).distinct()
    chosen = few.withColumn("place", F.row_number().over(Window.partitionBy("of").orderBy("drawn", "id"))).filter(F.col("place") <= docs).drop("drawn")
    found = labelled.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("label") == F.col("of")))
    sample = found.groupBy("label", "place").agg(F.min(F.substring("text", 1, size // 8)).alias("text")).orderBy("label", "place")
    out: dict[str, bytes] = {}
    for r in sample.toLocalIterator():
        if len(out.setdefault(r["label"], b"")) < size:
            out[r["label"]] += letters_only(r["text"])
    return {k: (rows[k], out.get(k, b" ")[:size]) for k in sorted(rows)}


def identify(df: DataFrame, dictionaries: dict[str, tuple[int, bytes]], *, id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.002, keep: str | None = None) -> DataFrame:
    """The id column, lang_pred, score, margin and rejected of each row, and ``keep``, if named: a struct of all its columns.

    Whole texts count: they are compressed in windows of 4096 bytes.  ``margin`` is the share by which the
    best result is smaller than the next; equal results go to the label with more labelled rows.  ``score`` is
    the best label's share when each byte more halves a label's weight.  Rejected are margins below
    ``min_margin`` and texts that are null or have no letter, whose lang_pred is ``und`` and score 0.
    With one label known its margin is 1; with none every text is ``und``.
    Texts of any length are read whole; equal rows give equal rows, ids may be null or repeat; an empty table gives no rows.
    """
    langs = sorted(dictionaries, key=lambda k: (-dictionaries[k][0], k))
    contents = [dictionaries[k][1] for k in langs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = []
        for content in contents:
            raw = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        for batch in batches:
            for piece in row_slices(batch):
                found = []
                for text in piece.column("text").to_pylist():
                    if not coders or not any(map(str.isalpha, text)):
                        found.append((NO_LANGUAGE, 0.0, 0.0))
                        continue
                    data = letters_only(text)
                    windows = [data[i : i + WINDOW] for i in range(0, len(data), WINDOW)]
                    sizes = [sum([len(c(w)) for w in windows]) for c in coders]
                    best = min(sizes)
                    rest = sorted(sizes)[1] if len(sizes) > 1 else None
                    found.append((langs[sizes.index(best)], 1 / sum(2.0 ** max(best - s, -1000) for s in sizes), 1.0 if rest is None else (rest - best) / rest))
                names, scores, margins = zip(*found, strict=True)
                found = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept.names), *found], schema.names)

    texts = id_and_text(df, id_col, text_col)
    if keep:
        texts = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    kept = texts.drop("text").schema
    schema = StructType(kept.fields).add("lang_pred", "string").add("score", "double").add("margin", "double")
    out = texts.mapInArrow(run, schema)
    rejected = (F.col("margin") < min_margin) | (F.col("lang_pred") == NO_LANGUAGE)
    return out.select(F.col("doc_id").alias(id_col), "lang_pred", "score", "margin", rejected.alias("rejected"), *([F.col("row").alias(keep)] if keep else []))


def fold(id_col: str = "doc_id", folds: int = 4) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
