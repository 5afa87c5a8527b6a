"""Embedding whitening: exact integer sums, a second pass of centred outer products, and a projection on the strongest components.

Each pass works on Arrow batches inside the tasks and leaves one small state a partition; ``treeAggregate`` merges
the states on the executors, so that the driver gets one state of a pass, whatever the number of partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Entries of vectors that are looked at together in a task.
_BLOCK = 1 << 19


@dataclass(frozen=True)
class Whitening:
    """What is fitted: n vectors, exact sums by dimension, components by falling eigenvalue, their eigenvalues, and the trace."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # dimension by component
    values: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace > 0 else np.zeros_like(self.values)

    @property
    def usable(self) -> np.ndarray:
        """Whether a component's eigenvalue stands above rounding, so that it can be divided by."""
        least = self.values.max(initial=0.0) * len(self.sums) * np.finfo(float).eps
        return self.values > least


def is_whole(vector: Column) -> Column:
    """Whether a vector is there, has an entry, and holds finite numbers only."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def _matrices(column: pa.Array, width: int | None = None) -> Iterator[np.ndarray]:
    """A batch of vectors as matrices of exact integers, some ``_BLOCK`` entries at a time."""
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    if not len(lengths):
        return
    width = width or int(lengths[0])
    if (lengths != width).any():
        raise ValueError("vectors of one table have one length")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    step = max(1, _BLOCK // width) * width
    for at in range(0, len(flat), step):
        scaled = np.floor(SCALE * flat[at : at + step].astype(np.float64))
        if np.abs(scaled).max() >= 2.0**52:
            raise ValueError("an entry is too large for whole numbers to be exact")
        yield (scaled.astype(np.int64) + OFFSET).reshape(-1, width)


def _merged(df: DataFrame, state: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], merge: Callable[[tuple, tuple], tuple], zero: tuple) -> tuple:
    """The states of all partitions, merged on the executors in rounds."""
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in state(batches):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(s)], pa.binary())], names=["state"])

    states = df.mapInArrow(run, "state binary").rdd.map(lambda row: pickle.loads(bytes(row["state"])))
    return states.treeAggregate(zero, merge, merge, depth=3)


def exact_sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors and the exact sum of each dimension (Python's integers, which don't overflow)."""

    def state(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        n, sums = 0, None
        for batch in batches:
            for x in _matrices(batch.column(0), None if sums is None else len(sums)):
                s = x.sum(axis=0).astype(object)  # a block's sums are below 2**52 * 2**19 / width, and mostly far below
                if np.abs(x).max() >= 2**43:
                    s = x.astype(object).sum(axis=0)
                n, sums = n + len(x), s if sums is None else sums + s
        if n:
            yield n, sums

    def merge(a: tuple, b: tuple) -> tuple:
        if a[0] == 0 or b[0] == 0:
            return b if a[0] == 0 else a
        if len(a[1]) != len(b[1]):
            raise ValueError("vectors of one table have one length")
        return a[0] + b[0], a[1] + b[1]

    return _merged(vectors, state, merge, (0, np.zeros(0, dtype=object)))


def _gaps(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: in 64 bits where that holds it, else in Python's integers."""
    largest = max(int(np.abs(x).max()) * n, max((abs(int(s)) for s in sums), default=0))
    return n * x - sums.astype(np.int64) if largest < 2**62 else n * x.astype(object) - sums


def _outer_sum(vectors: DataFrame, centred: Callable[[pa.Array], Iterator[np.ndarray]], width: int) -> np.ndarray:
    """Sum of the outer products of centred rows, by one matrix product a block."""

    def state(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        total = None
        for batch in batches:
            for c in centred(batch.column(0)):
                total = c.T @ c if total is None else total + c.T @ c
        if total is not None:
            yield (total,)

    return _merged(vectors, state, lambda a, b: (a[0] + b[0],), (np.zeros((width, width)),))[0]


def fit_whitening(df: DataFrame, vector: str = "embedding", components: int = 8, most_dimensions: int = 4096) -> Whitening | None:
    """Fits mean and the ``components`` strongest unit eigenvectors of the covariance (divisor n) of all whole vectors.

    Vectors that are null, empty or hold a null or non-finite entry are left out.  Repeated rows count as often as
    they stand there.  None, if no vector is whole.  The driver holds one matrix of dimensions squared, which
    ``most_dimensions`` bounds (128 MB); vectors of different lengths, or longer ones, are an error.
    """
    vectors = df.filter(is_whole(F.col(vector))).select(vector)
    n, sums = exact_sums(vectors)
    if n == 0:
        return None
    if len(sums) > most_dimensions:
        raise ValueError(f"at most {most_dimensions} dimensions")
    centred = lambda column: ((_gaps(x, n, sums) / n).astype(np.float64) for x in _matrices(column, len(sums)))
    cov = _outer_sum(vectors, centred, len(sums)) / n
    values, turned = np.linalg.eigh((cov + cov.T) / 2)
    k = min(components, len(sums))
    return Whitening(n, tuple(int(s) for s in sums), np.ascontiguousarray(turned[:, ::-1][:, :k]), values[::-1][:k].copy(), float(np.trace(cov)))


def whiten(df: DataFrame, fitted: Whitening | None, vector: str = "embedding", whitened: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """The rows of whole vectors with all their columns, ``whitened`` (an array, a value a component) and ``deviation``.

    A value is (x - S/n) on the component over the root of its eigenvalue, null where the eigenvalue is 0 up to
    rounding (fewer different vectors than components).  ``deviation`` is the exact sum over dimensions of
    (n x - S)**2.  Columns of these two names are replaced.  Without a fit there are no rows.
    """
    kept = df.drop(whitened, deviation).filter(is_whole(F.col(vector)))
    if fitted is None:
        return kept.filter(F.lit(False)).select("*", F.lit(None).cast("array<double>").alias(whitened), F.lit(None).cast("decimal(38,0)").alias(deviation))
    # The model is dimensions by components, at most 4096 by 8 numbers or so: its size doesn't grow with the rows.
    shared = df.sparkSession.sparkContext.broadcast((fitted.n, np.array(fitted.sums, dtype=object), fitted.components / np.sqrt(np.where(fitted.usable, fitted.values, 1.0)), fitted.usable))

    @F.arrow_udf("whitened array<double>, deviation string")
    def project(column: pa.Array) -> pa.Array:
        n, sums, scaled, usable = shared.value
        out, exact = [], []
        for x in _matrices(column, len(sums)):
            gaps = _gaps(x, n, sums)
            values = (gaps / n).astype(np.float64) @ scaled
            rows = values.tolist() if usable.all() else [[v if u else None for v, u in zip(row, usable, strict=True)] for row in values.tolist()]
            out.extend(rows)
            # Squares in 64 bits where their sum stays below 2**62.
            small = gaps.dtype != object and int(np.abs(gaps).max()) ** 2 * gaps.shape[1] < 2**62
            squares = np.einsum("ij,ij->i", gaps, gaps) if small else (gaps.astype(object) ** 2).sum(axis=1)
            exact.extend(str(int(s)) for s in squares)
        return pa.StructArray.from_arrays([pa.array(out, pa.list_(pa.float64())), pa.array(exact, pa.string())], names=["whitened", "deviation"])

    name = "_projected"
    return kept.withColumn(name, project(F.col(vector).cast("array<double>"))).select(*[F.col(f"`{c}`") for c in kept.columns], F.col(f"{name}.whitened").alias(whitened), F.col(f"{name}.deviation").cast("decimal(38,0)").alias(deviation))


def identity_error(projected: DataFrame, fitted: Whitening | None, whitened: str = "whitened") -> float | None:
    """Largest absolute entry of the whitened rows' own covariance (about their mean, divisor n) minus the identity, on usable components."""
    if fitted is None or not fitted.usable.any():
        return None
    k, usable = len(fitted.values), np.flatnonzero(fitted.usable)

    def values(column: pa.Array) -> Iterator[np.ndarray]:
        x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, k)[:, usable]
        yield np.hstack([x, np.ones((len(x), 1))])  # the column of ones gathers sums and the count

    total = _outer_sum(projected.select(whitened), values, len(usable) + 1)
    n, mean = total[-1, -1], total[-1, :-1] / total[-1, -1]
    return float(np.abs(total[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(usable))).max())
