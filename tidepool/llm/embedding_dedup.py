"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.components import components
from tidepool.llm.shared import Scratch
from tidepool.llm.vectors import by_length, matrix, sample_by_length, usable


@dataclass(frozen=True)
class Cells:
    """Unit centroids, and how far from a border a vector still visits the cell behind it."""

    centroids: np.ndarray
    reach: float

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, is_home) for homes and for visits, which go to lower-numbered cells only.

        A link across the border of cells c > d is found in d, so one direction is enough.
        """
        unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        near = unit @ self.centroids.T
        home = near.argmax(1)
        every = np.arange(len(rows))
        gap = np.sqrt(np.maximum(0, 2 - 2 * (self.centroids @ self.centroids.T)))
        visit = near[every, home][:, None] - near <= self.reach * gap[home]
        visit &= np.arange(len(self.centroids))[None, :] < home[:, None]
        row, cell = np.nonzero(visit)
        return (
            np.concatenate([every, row]),
            np.concatenate([home, cell]),
            np.concatenate([np.ones(len(rows), bool), np.zeros(len(row), bool)]),
        )


def fit_cells(sample: np.ndarray, total: int, cosine: float, per_cell: int = 6000, most_cells: int = 1024, sigmas: float | None = None, rounds: int = 8, seed: int = 7) -> Cells:
    """Spherical k-means on a bounded sample of vectors.

    Two vectors with at least ``cosine`` that fall in cells c and d are within
    sin(angle) * |c - d| of the border; that reach finds every link and is the default.
    ``sigmas`` cuts it, for vectors whose differences point in random directions only: what
    one adds along c - d then has a deviation of 1 / sqrt(dimensions) of that.
    """
    rng = np.random.default_rng(seed)
    sample = sample if len(sample) else np.eye(1, sample.shape[1])  # a length without a sample is one cell
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    k = max(1, min(most_cells, math.ceil(total / per_cell), len(unit)))
    centroids = unit[rng.choice(len(unit), k, replace=False)]
    for _ in range(rounds if k > 1 else 0):
        home = (unit @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, unit)
        size = np.linalg.norm(sums, axis=1)
        centroids = np.where((size > 1e-9)[:, None], sums / np.maximum(size, 1e-9)[:, None], centroids)
    full = math.sqrt(max(0.0, 1 - cosine * cosine))
    share = 1.0 if sigmas is None else min(1.0, sigmas / math.sqrt(sample.shape[1]) / max(cosine, 1e-9))
    return Cells(centroids, full * share + 1e-9)


#: Rows of a block that meet all others at a time.
STRIP = 256


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of a and b, pair by pair, in place; root[i] is the smallest member of i's group."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root[:] = further


def block_links(rows: pa.Table, cosine: float, alone: bool) -> pa.Table:
    """Links within a block, if it is ``alone``, else between its two sides: per vector their weight and a smaller id of its group."""
    v, ids = matrix(rows.column("v")), rows.column("id").to_numpy()
    weight, side = rows.column("weight").to_numpy(), rows.column("side").to_numpy()
    order = np.argsort(ids, kind="stable")
    v, ids, weight, side = v[order], ids[order], weight[order], side[order]
    size = np.sqrt((v * v).sum(1))
    n = len(ids)
    # Single precision decides all pairs but those at the threshold, which doubles decide.
    unit = (v / size[:, None]).astype(np.float32)
    root, linked = np.arange(n), np.zeros(n, np.int64)
    here, there = (np.flatnonzero(side == s) for s in (0, 1))
    for lo in range(0, len(here), STRIP):  # each pair once: with the other side, or with what follows on the own one
        some, others = here[lo : lo + STRIP], here[lo:] if alone else there
        near = unit[some] @ unit[others].T
        a, b = np.nonzero(near >= cosine - 1e-4)
        close = near[a, b]
        if alone:
            once = b > a
            a, b, close = a[once], b[once], close[once]
        a, b = some[a], others[b]
        edge = np.flatnonzero(close < cosine + 1e-4)
        if len(edge):
            x, y = a[edge], b[edge]
            exact = np.einsum("ij,ij->i", v[x], v[y]) / (size[x] * size[y])
            keep = np.ones(len(a), bool)
            keep[edge] = exact >= cosine
            a, b = a[keep], b[keep]
        for x, y in ((a, b), (b, a)):
            linked += np.bincount(x, weight[y], n).astype(np.int64)
        unite(root, a, b)  # so a strip's links are all that is held, however dense a block
    has = linked > 0
    return pa.table({"id": ids[has], "links": linked[has], "to": ids[root[has]]})


def link_vectors(
    vectors: DataFrame,
    cosine: float = 0.9,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = 16384,
    block: int = 4096,
    **cells,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: its near-duplicates by cosine.

    Equal vectors are compared once, with their number as weight. The distinct ones get a
    cell, and visit cells across near borders; a cell's vectors meet in blocks, so a crowded
    cell is many tasks, and a block returns per vector the number of its links and one link
    towards the smallest id of its group, never pairs. Every pair meets in one block at most.

    Vectors that are null, empty, zero or hold null or non-finite components have 0 links
    and stand alone, kept; so does a row without id, with a null component. Repeated rows
    are copies and link to each other. Vectors of several lengths are compared each among
    its own, in cells fitted to that length. Ties of cells go to the lower number; no rows
    give no rows; other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "cells")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("e"))
    fine = usable(F.col("e")) & F.col("vec_id").isNotNull()
    groups = rows.where(fine).groupBy("e").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    distinct = scratch.keep(groups, "distinct")
    counts, samples = sample_by_length(distinct, "id", "e", sample_rows)
    models, begin = {}, 0
    for n in sorted(counts):  # cells of all lengths are numbered through
        fitted = fit_cells(samples[n], counts[n], cosine, **cells)
        models[n] = begin, fitted
        begin += len(fitted.centroids)
    shared = spark.sparkContext.broadcast(models)  # most_cells x dimensions for each length: bounded by the parameters

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, which, v in by_length(b.column(2)):
                first, fitted = shared.value[n]
                row, cell, home = fitted.assign(v)
                row = which[row]
                for at in range(0, len(row), 20_000):
                    part = slice(at, at + 20_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((first + cell[part]).astype(np.int32)), pa.array(home[part]), *(c.take(pa.array(row[part])) for c in b.columns)],
                        ["cell", "home", "id", "weight", "v"],
                    )

    # Vectors travel in their own type; a block makes doubles of them.
    placed = distinct.select("id", "weight", F.col("e").alias("v"))
    placed = placed.mapInArrow(place, f"cell int, home boolean, id long, weight long, v {distinct.schema['e'].dataType.simpleString()}")
    parts = lambda c: F.ceil(F.count_if(c) / block).cast("int")
    shape = placed.groupBy("cell").agg(parts(F.col("home")).alias("hb"), parts(~F.col("home")).alias("gb"))
    shape = F.broadcast(shape)  # a row for each cell: most_cells at most for each length
    where = placed.join(shape, "cell").withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("hb")).otherwise(F.col("gb"))).cast("int"))
    spot = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    zero, one = F.lit(0), F.lit(1)
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(zero, F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    own = F.col("own")
    homes = F.transform(
        upto("hb"), lambda j: spot("home", F.least(own, j), F.greatest(own, j), F.when(own > j, one).otherwise(zero))
    )
    visited = F.transform(upto("gb"), lambda g: spot("visit", own, g, zero))
    visits = F.transform(upto("hb"), lambda j: spot("visit", j, own, one))
    spots = F.when(F.col("home"), F.concat(homes, visited)).otherwise(visits)
    tasks = where.select("cell", F.explode(spots).alias("s"), "id", "weight", "v").select("cell", "s.*", "id", "weight", "v")
    def meet(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        _, kind, i, j = (k.as_py() for k in key)
        return block_links(t, cosine, kind == "home" and i == j)

    found = tasks.groupBy("cell", "kind", "i", "j").applyInArrow(meet, "id long, links long, to long")
    found = scratch.keep(found, "found")
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")), scratch, "star")
    known = (
        distinct.join(linked, "id", "left").join(named, "id", "left")
        .select("e", "id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    )
    known = scratch.keep(known, "known")
    scratch.drop("distinct", "found", "star")
    usable_rows = rows.where(fine).join(known, "e").select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    others = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable_rows.unionByName(others).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: DuckDB SQL: all pairs, then the smallest id reachable.
LINKS_SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
sized AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM fine),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sized a JOIN sized b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
many AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(m.n, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON e.vec_id = l.a LEFT JOIN many m ON e.vec_id = m.a
"""
