"""The folder that driver and executors share, for tables that outlive a query's plan."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on one machine alone a temporary one where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables are written there")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidepool-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and it survives a lost executor.

    The folder's owner clears it; nothing here deletes what a returned plan may still read.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str, most: int) -> tuple[DataFrame, int, int]:
    """(``df`` dealt by ``key`` if its partitions are uneven, its rows, its partitions that hold rows).

    A file is split by bytes, but read by row groups, so of many splits one may hold all rows.
    Rows of each partition are counted, without their columns; the table is shuffled only
    where one holds more than twice its share of pieces for all cores, of ``most`` rows or fewer.
    """
    counts = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    total, largest, held = counts.agg(F.sum("n"), F.max("n"), F.count("*")).first()
    if not total:
        return df, 0, 1
    pieces = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(total / most))
    return (df.repartition(pieces, key), total, pieces) if largest > 2 * total / pieces else (df, total, held)
