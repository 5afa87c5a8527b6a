"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging.

The pre-tokens that a batch has and the task has not met are laid out as one
ragged numpy array of symbols.  In each round every sequence finds its pair of
lowest rank and merges all that pair's occurrences, all sequences at once; what
has no ranked pair left is finished, and its surviving symbols are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import BoundedTable, id_and_text, once_a_worker, row_slices
from gridloom.llm.merging import RankMerger

#: The byte-level pre-tokeniser's public pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

class Counter:
    """Counts a text's tokens; knows each distinct space-led chunk's count after its first use."""

    def __init__(self, path: str, limit: int):
        self.merger, self.find = RankMerger(path), regex.compile(PATTERN).findall
        self.odd = regex.compile(r"\s \s").search
        self.special = regex.compile("|".join(map(regex.escape, self.merger.specials))).split if self.merger.specials else lambda x: [x]
        self.chunks, self.words = BoundedTable(limit), BoundedTable(limit)

    def _word_counts(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.words]
        if new:
            self.words.update(zip(new, self.merger.merge([w.encode() for w in new])[1].tolist(), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        # A chunk is what follows one space.  Cut there, pre-tokens stay whole unless white space stands
        # on both sides of the space; texts with such a place, and a text's first chunk, are matched whole.
        plans, new, loose = [], set(), []
        for text in texts:
            parts = self.special(text)
            cut, whole = [], []
            for part in parts:
                if self.odd(part):
                    whole.append(self.find(part))
                else:
                    first, *rest = part.split(" ")
                    whole.append(self.find(first))
                    cut.append(rest)
                    new.update(x for x in rest if x not in self.chunks)
            loose.extend(w for ws in whole for w in ws)
            plans.append((len(parts) - 1, cut, whole))
        self.chunks.make_room(len(new), lambda: {x for _, cut, _ in plans for rest in cut for x in rest})
        split = {x: self.find(" " + x) for x in new}
        needed = {w for ws in split.values() for w in ws} | set(loose)
        self.words.make_room(len(needed), lambda: needed)
        self._word_counts(needed)
        known = self.words.__getitem__
        for x, ws in split.items():
            self.chunks[x] = sum(map(known, ws))
        known_chunk = self.chunks.__getitem__
        return [n + sum(sum(map(known_chunk, rest)) for rest in cut) + sum(sum(map(known, ws)) for ws in whole) for n, cut, whole in plans]


def token_counts(df: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, table_rows: int = 600_000) -> DataFrame:
    """The id column, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of each row.

    ``tokenizer`` is the path of a byte-level BPE tokenizer.json.  No tokens are added; an added token's own
    string inside a text counts as that one token.  Null or empty texts have 0 bytes and 0 tokens.
    ``table_rows`` bounds each of a task's two tables of known strings.
    Texts of any length are read whole; equal rows give equal rows, ids may be null or repeat; an empty table gives no rows.
    """

    kind = df.schema[id_col].dataType.simpleString()
    texts = id_and_text(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once_a_worker(Counter, tokenizer, table_rows)
        for batch in batches:
            for piece in row_slices(batch, max_bytes=1 << 22):
                texts = piece.column("text")
                n = counter.counts(texts.to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = texts.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
