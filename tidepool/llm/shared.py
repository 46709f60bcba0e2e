"""What several corpus operators need: scratch tables, Arrow text batches, splits."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.sources.shared import shared_folder

#: Bytes of text that a Python worker handles at a time, whatever the size of an Arrow batch.
SLICE_BYTES = 2 << 20


#: Most rows of a table that is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000

#: Rows of an Arrow batch where rows hold whole texts or sets.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds what a task holds of long rows at once; queries and stages call it, operators don't."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


class Scratch:
    """Intermediate tables in the shared folder, which survive a lost executor.

    ``keep`` writes a frame as Parquet and reads it back, so lineage ends there;
    ``drop`` deletes what is no longer read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def join_sized(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins by broadcast if ``small`` has at most BROADCAST_ROWS rows, else by a shuffle."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def in_fold(id_col: str, mod: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves ``fold``; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % mod == fold


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of rows of about ``size`` bytes.

    Yields (first row, end row, bytes, offsets); null counts as empty. A row is never
    cut: a text longer than a slice gets a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(n, max(end, row + 1))
        lo, hi = int(offsets[row]), int(offsets[end])
        yield row, end, raw[lo:hi], offsets[row : end + 1] - lo
        row = end


def map_text(
    df: DataFrame,
    id_cols: list[str],
    text_col: str,
    schema: str,
    make: Callable[[], Callable[[np.ndarray, np.ndarray], dict[str, object]]],
) -> DataFrame:
    """Maps texts to columns in Arrow batches, without a shuffle.

    ``make()`` runs once per task and gives f(bytes, offsets) -> {column: values}, one
    value per text. Only ``id_cols`` and the text are read; the ids come back first.
    ``schema`` describes the ids and the new columns together.
    """
    names = list(id_cols) if text_col in id_cols else [*id_cols, text_col]
    at = names.index(text_col)  # a text that is also passed through is sent once
    source = df.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)])
    source = source.withColumn(f"_c{at}", F.col(f"_c{at}").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            ids = [batch.column(i) for i in range(len(id_cols))]
            for row, end, data, offsets in text_slices(batch.column(at)):
                out = f(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [c.slice(row, end - row) for c in ids]
                    + [v if isinstance(v, pa.Array) else pa.array(v) for v in out.values()],
                    names=[*id_cols, *out],
                )

    return source.mapInArrow(run, schema)
