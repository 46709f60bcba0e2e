"""Vectors as columns: which take part in a search, and how Arrow lists become matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, without null or non-finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix of these rows) for each length in a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), rows, matrix(column if len(rows) == len(column) else column.take(pa.array(rows)))


def sample_by_length(df: DataFrame, id_col: str, vector_col: str, rows: int) -> tuple[dict[int, int], dict[int, np.ndarray]]:
    """(vectors of each length, a sample of them), the same at every run, by a hash of the id; all if there are fewer.

    The driver holds about ``rows`` vectors, of all lengths together: each length has an equal
    share, and a share below one may leave a length without a sample.
    """
    size = F.size(vector_col)
    counts = {r["n"]: r["c"] for r in df.groupBy(size.alias("n")).agg(F.count("*").alias("c")).collect()}
    if not counts:
        return {}, {}
    cuts = F.create_map(*[F.lit(int(x)) for n, c in counts.items() for x in (n, min(1.0, rows / len(counts) / c) * (1 << 30))])
    picked = df.where(F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1 << 30)) < F.element_at(cuts, size))
    found: dict[int, list] = {n: [] for n in counts}
    for r in sorted(picked.select(F.col(id_col).alias("i"), F.transform(vector_col, lambda x: x.cast("double")).alias("v")).collect()):
        found[len(r["v"])].append(r["v"])
    return counts, {n: np.array(v, np.float64).reshape(len(v), n) for n, v in found.items()}
