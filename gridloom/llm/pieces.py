"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model has the white-space marker after another character, so a
chunk (a run of markers and what follows up to the next one) is segmented the
same way wherever it stands.  Each distinct chunk of a task is segmented once by
the library; a text's ids are its chunks' ids joined by position.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import BoundedTable, id_and_text, once_a_worker, row_slices

MARKER = "▁"


class ChunkEncoder:
    def __init__(self, path: str, limit: int):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = next((p for i in range(self.model.get_piece_size()) if MARKER in (p := self.model.id_to_piece(i)).lstrip(MARKER)), None)
        if crossing:
            raise ValueError(f"the piece {crossing!r} crosses a white-space marker: chunks of this model can't be segmented apart")
        if self.model.encode("a  b ", out_type=str) != self.model.encode(f"a{MARKER}{MARKER}b{MARKER}", out_type=str) or self.model.encode("a", out_type=str)[0][0] != MARKER:
            raise ValueError("the model must keep white space as it is and put a marker before a text")
        self.runs = re.compile(" +[^ ]*").findall
        self.table = BoundedTable(limit)

    def chunks(self, text: str) -> list[str]:
        """Each chunk without its first marker, spaces standing for markers; none for an empty text."""
        if not text:
            return []
        text = text.replace(MARKER, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in self.runs(" " + text)]
        return text.split(" ")

    def prepare(self, lists: list[list[str]]) -> None:
        """Puts all chunks of the lists into the table."""
        known = self.table
        new = set(chain.from_iterable(lists)).difference(known)
        known.make_room(len(new), lambda: set(chain.from_iterable(lists)))
        new = list(new)
        for chunk, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            known[chunk] = (ids, " ".join(map(str, ids)))
        if "" in known:  # a marker alone; the library returns nothing for the empty string
            alone = [self.model.piece_to_id(MARKER)]
            known[""] = (alone, str(alone[0]))

    def encode(self, chunks: list[str]) -> tuple[list[int], str]:
        """Ids, and their decimals joined by spaces."""
        rows = list(map(self.table.__getitem__, chunks))
        return list(chain.from_iterable([r[0] for r in rows])), " ".join([r[1] for r in rows])


def encode_pieces(df: DataFrame, *, model: str, id_col: str = "doc_id", text_col: str = "text", table_rows: int = 400_000, digests: bool = False) -> DataFrame:
    """Each row's piece ids with the end id, as the library encodes its text, and what they decode to.

    Returns the id column, n_tokens, ids (array of int) and decoded (string); with ``digests`` ids_sha256
    (of the decimal ids joined by one space) and decoded_sha256 instead of the last two.  Null and empty
    texts give the end id alone and decode to the empty text.  ``table_rows`` bounds a task's table.
    Texts of any length are read whole; equal rows give equal rows, ids may be null or repeat; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = once_a_worker(ChunkEncoder, model, table_rows)
        end = coder.model.eos_id()
        for batch in batches:
            for piece in row_slices(batch, max_bytes=1 << 21):
                cut = [coder.chunks(t) for t in piece.column("text").to_pylist()]
                coder.prepare(cut)
                rows = [coder.encode(c) for c in cut]
                ids = [r[0] + [end] for r in rows]
                decoded = coder.model.decode(ids, num_threads=1)
                if digests:
                    marks = [hashlib.sha256(f"{r[1]} {end}".lstrip().encode()).hexdigest() for r in rows]
                    out = [pa.array(marks), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
                else:
                    out = [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(list(map(len, ids)), pa.int64()), *out], names)

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kind = df.schema[id_col].dataType.simpleString()
    out = id_and_text(df, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"))
    return out.withColumnRenamed("doc_id", id_col)


def decode_pieces(df: DataFrame, *, model: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``, the library's text for the ids of each row; null ids decode to the empty text."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = sentencepiece.SentencePieceProcessor(model_file=model)
        for ids in batches:
            yield pd.Series(coder.decode([[] if x is None else [int(i) for i in x] for x in ids], num_threads=1), dtype=object)

    return df.withColumn("decoded", decoded(F.col(ids_col)))
