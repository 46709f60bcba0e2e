"""How often a key occurs, next to each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_repeats(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """``rows`` with the count of rows of the same key (null is a key), null for a key of one row.

    Counts are pre-aggregated and joined back, so a hot key isn't one window partition.
    """
    keyed = rows.withColumn(f"_{name}", key)
    many = keyed.groupBy(F.col(f"_{name}").alias("_key")).agg(F.count("*").alias(name)).where(F.col(name) > 1)
    return keyed.join(many, keyed[f"_{name}"].eqNullSafe(many["_key"]), "left").drop("_key", f"_{name}")
