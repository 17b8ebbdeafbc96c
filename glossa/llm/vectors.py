"""What the vector operators share: valid rows, and passes over groups of sorted Arrow rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(rows: DataFrame, vector: str) -> F.Column:
    """True for vectors that take part: of numbers only, all finite, not all zero."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def main_length(rows: DataFrame, vector: str) -> int:
    """The most frequent vector length (the larger on ties), 0 if there is none."""
    found = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def matrix(column: pa.Array, dtype, length: int) -> np.ndarray:
    """A column of packed vectors as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, length)


def list_matrix(column: pa.Array, length: int) -> np.ndarray:
    """A column of lists of `length` numbers as a float64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


#: Closer to a threshold than this, a product of unit vectors doesn't decide.
DOUBT = 1e-9


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of `a` with the same row of `b`: one value a pair, whichever side is which and whatever else is compared."""
    dot, aa, bb = (a * b).sum(1), (a * a).sum(1), (b * b).sum(1)
    with np.errstate(over="ignore", under="ignore"):
        both = aa * bb
    plain = np.isfinite(both) & (both > 1e-200)
    return dot / np.where(plain, np.sqrt(np.where(plain, both, 1.0)), np.sqrt(aa) * np.sqrt(bb))


def near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows have `cosines` of at least the threshold: by a product of unit vectors, pairs near the threshold one by one."""
    found = (x / np.sqrt((x * x).sum(1, keepdims=True))) @ (y / np.sqrt((y * y).sum(1, keepdims=True))).T
    close = found >= threshold
    i, j = np.nonzero(np.abs(found - threshold) < DOUBT)
    for at in range(0, len(i), 10_000):
        some = slice(at, at + 10_000)
        close[i[some], j[some]] = cosines(x[i[some]], y[j[some]]) >= threshold
    return close


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column, which the rows are sorted by.

    Holds one group and one batch at a time.
    """
    carry: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        key = batch.column(0).to_numpy()
        cuts = [*np.flatnonzero(key[1:] != key[:-1]) + 1]
        if carry and carry[-1].column(0)[0].as_py() != key[0]:
            yield pa.concat_tables(carry).combine_chunks()
            carry = []
        at = 0
        for cut in cuts:
            part = table.slice(at, cut - at)
            yield pa.concat_tables([*carry, part]).combine_chunks() if carry else part
            carry, at = [], int(cut)
        carry.append(table.slice(at))
    if carry:
        yield pa.concat_tables(carry).combine_chunks()


def batched(rows: Iterator[tuple], names: list[str], types: list, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Tuples of equally long arrays, gathered to record batches."""
    held, count = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(t) for c, t in zip(zip(*held), types)], names)

    for row in rows:
        if len(row[0]):
            held.append(row)
            count += len(row[0])
        if count >= size:
            yield out()
            held, count = [], 0
    if held:
        yield out()
