"""Approximate nearest neighbours: a forest of random-projection trees, then exact reranking."""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.shared import Scratch
from tidepool.llm.vectors import by_length, matrix, sample_by_length, usable


#: Parts of a query's leaves that are merged first, each to its k best.
MERGES = 64


@dataclass(frozen=True)
class Forest:
    """planes[tree, node] and cuts[tree, node] of complete trees; ``visits`` leaves per query."""

    planes: np.ndarray
    cuts: np.ndarray
    depth: int
    visits: int

    @property
    def trees(self) -> int:
        return len(self.planes)

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((self.trees, len(rows)), np.int32)
        for t in range(self.trees):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", rows, self.planes[t, node]) > self.cuts[t, node]
                node = 2 * node + 1 + side
            out[t] = node - (2**self.depth - 1)
        return out

    def search(self, q: np.ndarray, visits: int | None = None) -> list[tuple[int, int]]:
        """Leaves of all trees from one queue, by the smallest distance to a cut on the way."""
        inner = 2**self.depth - 1
        margin = self.planes @ q - self.cuts if inner else None
        queue, found = [(-math.inf, t, 0) for t in range(self.trees)], []
        while queue and len(found) < (visits or self.visits):
            far, t, node = heapq.heappop(queue)
            while node < inner:
                m = margin[t, node]
                near, other = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(far, abs(m)), t, other))
                node = near
            found.append((t, node - inner))
        return found


def fit_forest(
    sample: np.ndarray, total: int, trees: int = 8, leaf: int = 2048, most_depth: int = 12, k: int = 20, recall: float = 0.95, seed: int = 7
) -> Forest:
    """Fits on a bounded sample: each node cuts at the median along two random rows' difference.

    The depth aims at ``leaf`` rows a leaf of ``total``, at ``most_depth`` at most. 128 rows
    of the sample search all leaves; the place in the queue at which they have met ``recall``
    of their k nearest in the sample is the number of leaves to visit. That is measured for
    2, 4, ... up to ``trees`` trees, and the number that visits the fewest rows is taken.
    """
    rng = np.random.default_rng(seed)
    depth = max(0, min(most_depth, round(math.log2(max(1, total) / leaf)), int(math.log2(max(1, len(sample) / 16)))))
    inner, dim = 2**depth - 1, sample.shape[1]
    planes, cuts = np.zeros((trees, inner, dim)), np.zeros((trees, inner))
    for t in range(trees):
        rows = [np.arange(len(sample))]
        for node in range(inner):
            r = rows[node]
            w = np.subtract(*sample[rng.choice(r, 2, replace=False)]) if len(r) > 1 else np.zeros(dim)
            if not (size := np.linalg.norm(w)) > 0:
                w = rng.normal(size=dim)
                size = np.linalg.norm(w)
            planes[t, node] = w / size
            p = sample[r] @ planes[t, node]
            cuts[t, node] = np.median(p) if len(p) else 0.0
            rows += [r[p <= cuts[t, node]], r[p > cuts[t, node]]]
    if not depth:
        return Forest(planes[:1], cuts[:1], 0, 1)
    own = rng.choice(len(sample), min(128, len(sample)), replace=False)
    asked = sample[own]
    score = asked @ sample.T
    score[np.arange(len(own)), own] = -np.inf  # a query is no candidate of its own
    best = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    where = Forest(planes, cuts, depth, 0).leaves(sample)
    found: Forest | None = None
    for many in sorted({min(trees, 2 << i) for i in range(trees.bit_length())}):
        forest = Forest(planes[:many], cuts[:many], depth, many << depth)
        place, met = np.zeros((many, 1 << depth), np.int64), []
        for q, b in zip(asked, best, strict=True):
            for i, (t, x) in enumerate(forest.search(q)):
                place[t, x] = i
            met.append(place[np.arange(many)[:, None], where[:many, b]].min(0))
        visits = int(np.quantile(np.concatenate(met), recall, method="higher")) + 1
        if found is None or visits < found.visits:
            found = Forest(forest.planes, forest.cuts, depth, visits)
    return found


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = 16384,
    block: int = 4096,
    **forest,
) -> DataFrame:
    """The k nearest found for each query: (query_id, rank, vec_id, score), by inner product.

    Both tables have ``id_col`` and ``vector_col``; a query's own id is no candidate. Equal
    vectors are indexed once, with their k + 1 smallest ids, which is all that a search can
    need of them. The forest is fitted on about ``sample_rows`` distinct vectors and every
    vector is indexed in every tree. A leaf's members and its queries meet in blocks, so a
    crowded leaf is many tasks; each gives the k best of a block, and the best of all are
    kept by merges of short lists in two levels. Queries whose leaves hold fewer than
    k candidates visit eight times as many, until they have k or have seen all. Scores are double sums in element order; ties go to the smaller id. Vectors that
    are null, empty, zero, or hold null or non-finite components, and rows without id, take
    no part. Vectors of several lengths are searched each among its own, with a forest for
    each length. Repeated rows are one; no rows give no rows; other columns, whatever their
    names, are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    clean = lambda df: df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")
    )
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    kept = clean(vectors).distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1)
    distinct = scratch.keep(kept.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "distinct")
    todo = clean(queries).distinct()
    schema = "query_id long, rank int, vec_id long, score double"
    counts, samples = sample_by_length(distinct.select(F.col("ids")[0].alias("id"), "v"), "id", "v", sample_rows)
    if not counts:
        return spark.createDataFrame([], schema)
    element = distinct.schema["v"].dataType.elementType.simpleString()
    models = {n: fit_forest(samples[n], counts[n], k=k, **forest) for n in counts}
    shared = spark.sparkContext.broadcast(models)  # trees x 2^depth planes for each length: bounded by the parameters

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, rows, v in by_length(b.column(1)):
                model, part = shared.value[n], b.take(pa.array(rows))
                bounds = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * model.trees)
                leaves = pa.ListArray.from_arrays(bounds, pa.array(model.leaves(v).T.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), leaves], ["ids", "v", "leaf"])

    def probe(times: int):
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("tree", pa.int32()), ("leaf", pa.int32())]))
            for b in batches:
                for n, rows, v in by_length(b.column(1)):
                    if n not in shared.value:  # no candidates of this length
                        continue
                    part, model = b.take(pa.array(rows)), shared.value[n]
                    found = pa.array([[{"tree": t, "leaf": x} for t, x in model.search(q, times * model.visits)] for q in v], kind)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found], ["id", "v", "hits"])

        return f

    members = distinct.select("ids", "v").mapInArrow(index, f"ids array<long>, v array<{element}>, leaf array<int>")
    members = members.select("ids", "v", F.size("v").alias("dim"), F.posexplode("leaf").alias("tree", "leaf"))
    kind = todo.schema["v"].dataType.elementType.simpleString()
    # Blocks of a leaf, from counts: trees x 2^depth rows at most, for each length.
    spot = ["dim", "tree", "leaf"]
    parts = lambda n: F.ceil(F.coalesce(F.col(n), F.lit(0)) / block).cast("int")
    many = members.groupBy(spot).agg(F.count("*").alias("n"))

    def rank_block(rows: pa.Table) -> pa.Table:
        asked_here = rows.column("id").is_valid()
        q, m = rows.filter(asked_here), rows.filter(pa.compute.invert(asked_here))
        out_kind = pa.list_(pa.struct([("less", pa.float64()), ("vec_id", pa.int64())]))
        if not q.num_rows or not m.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "best": pa.array([], out_kind)})
        where = [rows.column(x)[0].as_py() for x in ("tree", "leaf", "i")]
        part_of = np.full(q.num_rows, (where[0] * 7919 + where[1] * 31 + where[2]) % MERGES, np.int32)
        a, b = matrix(q.column("v")), matrix(m.column("v"))
        qid = q.column("id").to_numpy()
        lists = m.column("ids").combine_chunks()
        first, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
        few = min(len(b), k + 1)
        bounds, best_less, best_id = [0], [], []
        for at in range(0, len(a), 512):
            part = a[at : at + 512]
            rough = part @ b.T
            edge = np.partition(rough, -few, axis=1)[:, -few] - 1e-9 * (1 + np.abs(rough).max(1))
            r, c = np.nonzero(rough >= edge[:, None])
            score = np.zeros(len(r))
            for d in range(b.shape[1]):  # in element order, as a plain sum would
                score += part[r, d] * b[c, d]
            many = first[c + 1] - first[c]  # the copies of a vector
            spot = np.repeat(first[c], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            r, less, found = np.repeat(r, many), -np.repeat(score, many), ids[spot]
            other = found != qid[at + r]
            r, less, found = r[other], less[other], found[other]
            order = np.lexsort((found, less, r))
            r, less, found = r[order], less[order], found[order]
            size = np.bincount(r, minlength=len(part))
            top = np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size) < k
            best_less.append(less[top])
            best_id.append(found[top])
            bounds.extend((bounds[-1] + np.cumsum(np.minimum(size, k))).tolist())
        hits = pa.StructArray.from_arrays([pa.array(np.concatenate(best_less)), pa.array(np.concatenate(best_id))], fields=list(out_kind.value_type))
        return pa.table({"query_id": qid, "part": part_of, "best": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), hits)})

    def merge(found: DataFrame, *by: str) -> DataFrame:
        """The k best of the lists of each query; equal finds of several trees are one."""
        rows = found.groupBy("query_id", *by).agg(F.array_sort(F.flatten(F.collect_list("best"))).alias("all"))
        before = lambda i: F.get("all", i - 1)
        once = F.filter("all", lambda x, i: (i == 0) | (x["vec_id"] != before(i)["vec_id"]))
        return rows.select("query_id", F.slice(once, 1, k).alias("best"))

    def meet(asked: DataFrame) -> DataFrame:
        """(query_id, rank, vec_id, less): the k best of the leaves that (id, v, hits) visit."""
        asked = asked.select("id", "v", F.size("v").alias("dim"), F.explode("hits").alias("h"))
        asked = asked.select("id", F.col("v").cast(f"array<{element}>").alias("v"), "dim", "h.tree", "h.leaf")
        shape = asked.groupBy(spot).agg(F.count("*").alias("q")).join(many, spot)
        shape = F.broadcast(shape.select(*spot, parts("n").alias("nb"), parts("q").alias("qb")))
        none = F.lit(0)
        left = members.join(shape, spot).select(
            *spot, F.pmod(F.xxhash64(F.col("ids")[0]), F.col("nb")).cast("int").alias("i"),
            F.explode(F.sequence(none, F.col("qb") - 1)).alias("j"), "ids", "v", F.lit(None).cast("long").alias("id"),
        )
        right = asked.join(shape, spot).select(
            *spot, F.explode(F.sequence(none, F.col("nb") - 1)).alias("i"),
            F.pmod(F.xxhash64("id"), F.col("qb")).cast("int").alias("j"), F.lit(None).cast("array<long>").alias("ids"), "v", "id",
        )
        tasks = left.unionByName(right).groupBy(*spot, "i", "j")
        found = tasks.applyInArrow(rank_block, "query_id long, part int, best array<struct<less:double,vec_id:long>>")
        # In two levels, so that no list is long however many leaves a query visits.
        merged = merge(merge(found, "part")).select("query_id", F.posexplode("best").alias("at", "hit"))
        return merged.select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.less")

    best, times = [], 1
    while True:
        asked = todo.mapInArrow(probe(times), f"id long, v array<{kind}>, hits array<struct<tree:int,leaf:int>>")
        asked = scratch.keep(asked, f"asked{times}")
        found = scratch.keep(meet(asked), f"found{times}")
        best.append(found)
        partial = [d for d, x in models.items() if times * x.visits < x.trees << x.depth]
        if not partial:
            break
        full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
        short = asked.where(F.size("v").isin(partial)).select("id", "v").join(full, "id", "left_anti")
        if short.isEmpty():
            break
        todo = scratch.keep(short, f"short{times}")
        best[-1] = found.join(todo.select(F.col("id").alias("query_id")), "query_id", "left_anti")
        times *= 8
    whole = functools.reduce(DataFrame.unionByName, best)
    return whole.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", (-F.col("less")).alias("score"))


#: DuckDB SQL: exact search, which the forest equals where one leaf holds the table.
NEAREST_SQL = """
WITH fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM fine q JOIN fine c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
