"""Small helpers that the text operators share."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Collection, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns in use, named ``doc_id`` and ``text``; null text becomes empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def hex_sha256(col: Column) -> Column:
    return F.sha2(F.encode(col, "UTF-8"), 256)


#: Removes a query's shuffle files at its end.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for rows written between steps; a temporary one where there is only this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="gridloom-")


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that the cluster names.

    When it is written nothing reads the shuffles before it any more, and Spark may remove their files.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    conf = df.sparkSession.conf
    before = conf.get(_SHUFFLE_CLEANUP)
    conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.set(_SHUFFLE_CLEANUP, before)


def let_go(spark: SparkSession) -> None:
    """Before a step writes: Spark removes the shuffles, broadcasts and checkpoints of earlier ones when their plans are collected as garbage."""
    gc.collect()
    spark._jvm.System.gc()


def text_slices(column: pa.Array, max_bytes: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a text column into runs of rows of about ``max_bytes`` (a longer text is a run of its own).

    Yields first row, end row, the run's UTF-8 bytes and its rows' offsets in them.
    """
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + n + 1)[column.offset :] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def row_slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``max_bytes`` of text."""
    for first, end, _, _ in text_slices(batch.column(column), max_bytes):
        yield batch.slice(first, end - first)


class BoundedTable(dict):
    """A lookup table of at most ``limit`` entries, or what one batch needs: only speed depends on it."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def make_room(self, more: int, wanted: Callable[[], Collection]) -> None:
        """Before ``more`` new entries are put in: if they don't fit, only entries in ``wanted`` stay."""
        if len(self) + more > self.limit:
            kept = {k: self[k] for k in wanted() if k in self}
            self.clear()
            self.update(kept)


@lru_cache(maxsize=4)
def once_a_worker(kind: type, *args: object) -> object:
    """The object of that kind and arguments that this Python worker keeps for all its tasks."""
    return kind(*args)
