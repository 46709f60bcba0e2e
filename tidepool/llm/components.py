"""Connected components of a large link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.shared import BROADCAST_ROWS, Scratch

MOST_ROUNDS = 60


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(F.broadcast(least) if few else least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(F.broadcast(least) if few else least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) for every id of edges (a, b) but the smallest of each component.

    ``component`` is the smallest id reachable. Minima are pre-aggregated before their
    shuffle and joined back: by broadcast while there are at most BROADCAST_ROWS of them
    (two for each edge at most), so that a hub's edges stay where they are, else by a
    shuffle whose skew Spark splits. Each round is written to the shared folder, which cuts
    lineage. Self-links and nulls are ignored.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(F.col("a").cast("long"), F.col("b").cast("long")).distinct()
    now, before = scratch.keep(edges, f"{name}/0"), None
    for r in range(1, MOST_ROUNDS + 1):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            break
        before, few = mark, 2 * mark[0] <= BROADCAST_ROWS
        now = scratch.keep(_small_star(_large_star(now, few), few), f"{name}/{r}")
        scratch.drop(f"{name}/{r - 1}")
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
