"""Word search in blocks of postings: from the rarest term on, skipping blocks that cannot reach the k best.

A segment's texts lie in buckets of similar length. A block holds a term's postings in one
bucket, with the largest count and the shortest text among them, from which the largest
possible score follows whatever the corpus' statistics are by then. A query reads headers of
blocks first, in the buckets of its rarest term only; postings are read where a bucket has all
of its terms and can still hold one of its k best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.operators.search import B, K1, query_terms, term_sum, top_k
from tidepool.sources.shared import kept, spread

#: Texts of a bucket, and classes of length that have most texts, about.
BUCKET_TEXTS, CLASSES = 256, 8
#: Texts of a task, about, and those whose postings it holds and sorts at a time.
PIECE_TEXTS, CHUNK_TEXTS = 32_768, 8192
#: A query's first buckets hold at least so many times k postings of its rarest term.
PROBE = 2
#: Postings of a rarest term in a bucket that other terms' postings are looked up in one by one.
FEW = 32
#: Slack of a bound against rounding.
SLACK = 1e-9
BLOCKS = "segment int, term string, bucket long, n int, most_tf long, least_tokens int, ids array<{id}>, tfs array<long>, lengths array<int>"


def posting_blocks(texts: DataFrame, segment: int) -> DataFrame:
    """The blocks of the texts (asset_id, text) of a segment, sorted by term within a chunk of CHUNK_TEXTS texts.

    Only texts that lie unevenly are shuffled, before they are tokenized, to pieces of about
    PIECE_TEXTS at most. A bucket is a class of lengths within a chunk, cut to about
    BUCKET_TEXTS by a hash of the id. Null texts and those without tokens have no block; ids
    are unique and not null.
    """
    kind = texts.schema["asset_id"].dataType.simpleString()
    texts, n, parts = spread(texts, "asset_id", PIECE_TEXTS)
    full = min(n / parts, CHUNK_TEXTS) / CLASSES / BUCKET_TEXTS  # buckets that a class of lengths has texts for
    cuts, steps = min(1 << 15, max(1, round(full))), min(2.0, max(0.5, full))
    rows = texts.select("asset_id", T.tokens(F.col("text")).alias("t"), F.pmod(F.xxhash64("asset_id"), F.lit(cuts)).alias("share"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK_TEXTS:
                yield from _blocks(pa.Table.from_batches(held), steps, segment, (part << 42) + (chunk << 22))
                chunk, held, size = chunk + 1, [], 0
        if size:
            yield from _blocks(pa.Table.from_batches(held), steps, segment, (part << 42) + (chunk << 22))

    return rows.mapInArrow(build, BLOCKS.format(id=kind))


def _blocks(texts: pa.Table, steps: float, segment: int, first: int) -> Iterator[pa.RecordBatch]:
    """The blocks of some texts (asset_id, t, share), by term and bucket; their buckets are numbered from ``first`` on."""
    ids, t = texts["asset_id"].combine_chunks(), texts["t"].combine_chunks()
    sizes = pa.compute.fill_null(t.value_lengths(), 0).to_numpy().astype(np.int32)
    coded = t.flatten().dictionary_encode()
    if not len(coded):
        return
    order = pa.compute.array_sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    length = np.floor(steps * np.log2(np.maximum(sizes, 1))).astype(np.int64)
    buckets, own = np.unique((length << 16) + texts["share"].to_numpy(), return_inverse=True)
    # One number for term, bucket and text: sorted and counted at once, and small enough for 64 bits.
    text = np.repeat(np.arange(len(ids)), sizes)
    at, tf = np.unique((place[coded.indices.to_numpy()] * len(buckets) + own[text]) * len(ids) + text, return_counts=True)
    block, text = at // len(ids), at % len(ids)
    heads = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    tokens, terms = sizes[text], coded.dictionary.take(order)
    for i in range(0, len(heads), 1 << 14):
        some = heads[i : i + (1 << 14)]
        end = heads[i + (1 << 14)] if i + (1 << 14) < len(heads) else len(at)
        rows, begins, bounds = slice(some[0], end), some - some[0], pa.array((np.append(some, end) - some[0]).astype(np.int32))
        lists = {"ids": ids.take(pa.array(text[rows])), "tfs": pa.array(tf[rows]), "lengths": pa.array(tokens[rows])}
        columns = {
            "segment": pa.array(np.full(len(some), segment, np.int32)),
            "term": terms.take(pa.array(block[some] // len(buckets))),
            "bucket": pa.array(first + buckets[block[some] % len(buckets)]),
            "n": pa.array(np.diff(np.append(some, end)).astype(np.int32)),
            "most_tf": pa.array(np.maximum.reduceat(tf[rows], begins)),
            "least_tokens": pa.array(np.minimum.reduceat(tokens[rows], begins)),
            **{name: pa.ListArray.from_arrays(bounds, values) for name, values in lists.items()},
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def term_frequencies(blocks: DataFrame) -> DataFrame:
    """(term, df) of blocks, from their headers."""
    return blocks.groupBy("term").agg(F.sum(F.col("n").cast("long")).alias("df"))


def impact(tf: Column, tokens: Column, mean: Column) -> Column:
    """What a term's count and a text's length give; it grows with the count and falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * tokens / mean))


def weighted_terms(queries: DataFrame, frequencies: DataFrame, statistics: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = kept) -> DataFrame:
    """(query_id, term, n_terms, weight, avg_tokens, place): the terms of each usable query whose every term occurs, rarest first.

    ``weight`` is the term's count in the query times its idf. The asked terms and the result
    are written, so their size is known and Spark broadcasts them to larger tables only
    while they are small.
    """
    asked = keep(query_terms(queries), "asked")
    known = frequencies.where(F.col("df") > 0).join(asked.select("term").distinct(), "term", "left_semi")
    rows = asked.join(known, "term").crossJoin(F.broadcast(statistics))  # one row
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    own = Window.partitionBy("query_id")  # at most 32 terms
    rows = rows.withColumn("place", F.row_number().over(own.orderBy("df", "term"))).withColumn("found", F.count("*").over(own))
    rows = rows.where(F.col("found") == F.col("n_terms"))
    return keep(rows.select("query_id", "term", "n_terms", (F.col("times") * idf).alias("weight"), "avg_tokens", "place"), "terms")


def candidate_buckets(terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, segment, bucket, bound, rare): buckets with all terms of a query, and the largest score there.

    ``rare`` is the rarest term's number of postings. Only buckets of the rarest term are
    looked up for the others, and only headers are read.
    """
    heads = blocks.select("term", "segment", "bucket", "n", "most_tf", "least_tokens").join(terms.select("term").distinct(), "term", "left_semi")
    first = terms.where("place = 1").join(heads, "term")
    most = F.col("weight") * impact(F.col("most_tf"), F.col("least_tokens"), F.col("avg_tokens"))
    first = first.select("query_id", "segment", "bucket", "n_terms", F.col("n").alias("rare"), most.alias("most"))
    rest = first.select("query_id", "segment", "bucket").join(terms.where("place > 1"), "query_id").join(heads, ["term", "segment", "bucket"])
    every = first.unionByName(rest.select("query_id", "segment", "bucket", "n_terms", F.lit(None).cast("int").alias("rare"), most.alias("most")))
    found = every.groupBy("query_id", "segment", "bucket").agg(
        F.count("*").alias("n"), F.max("n_terms").alias("n_terms"), F.sum("most").alias("bound"), F.max("rare").alias("rare")
    )
    return found.where(F.col("n") == F.col("n_terms")).drop("n", "n_terms")


def bucket_scores(
    buckets: DataFrame, terms: DataFrame, blocks: DataFrame, tombstones: DataFrame, searchable: DataFrame | None, keep: Callable[[DataFrame, str], DataFrame] = kept
) -> DataFrame:
    """(query_id, asset_id, score) of the texts in ``buckets`` (query_id, segment, bucket) that hold every term.

    Where the rarest term has at most FEW postings in a bucket, only those texts' postings of
    the other terms are taken further. What is to be read is written first, so its size is
    known: while it is small it is broadcast, and blocks are not shuffled.
    """
    key = ["term", "segment", "bucket"]
    asked = blocks.join(terms.select("term").distinct(), "term", "left_semi")  # before any shuffle, while the terms are few
    first = keep(buckets.select("query_id", "segment", "bucket").join(terms.where("place = 1").select("query_id", "term"), "query_id"), "first")
    rare = first.join(asked.select(*key, "ids"), key).select("query_id", "segment", "bucket", F.when(F.size("ids") <= FEW, F.col("ids")).alias("rare"))
    wanted = keep(rare.join(terms, "query_id").drop("place"), "wanted")
    rows = wanted.join(asked.select(*key, "ids", "tfs", "lengths"), key)
    each = rows.select(
        "query_id", "segment", "n_terms", "weight", "avg_tokens", "rare",
        F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("lengths").alias("tokens"))).alias("p"),
    )
    each = each.where(F.col("rare").isNull() | F.array_contains("rare", F.col("p.id")))
    part = F.col("weight") * impact(F.col("p.tf"), F.col("p.tokens"), F.col("avg_tokens"))
    hits = each.groupBy("query_id", "segment", F.col("p.id").alias("asset_id")).agg(
        F.count("*").alias("n"), F.first("n_terms").alias("n_terms"), term_sum(part).alias("score")
    )
    hits = hits.where(F.col("n") == F.col("n_terms"))
    dead = tombstones.select("asset_id", F.col("segment").alias("_until"))
    hits = hits.join(dead, (hits["asset_id"] == dead["asset_id"]) & (hits["segment"] < dead["_until"]), "left_anti")
    if searchable is not None:
        hits = hits.join(searchable.select("asset_id").distinct(), "asset_id", "left_semi")
    return hits.select("query_id", "asset_id", "score")


def bounded_top_k(
    queries: DataFrame,
    blocks: DataFrame,
    frequencies: DataFrame,
    statistics: DataFrame,
    tombstones: DataFrame,
    searchable: DataFrame | None = None,
    k: int = 100,
    keep: Callable[[DataFrame, str], DataFrame] = kept,
) -> tuple[DataFrame, DataFrame]:
    """(the k best texts of each query with score and rank, the buckets that were read).

    Scores are those of bm25_scores, rank 1 the smallest, ties to the smaller id. The
    buckets with the largest bounds are read first, until they hold PROBE times k postings of
    the rarest term; their k-th score then rules out every bucket whose bound is below it.
    If they hold fewer than k hits nothing is ruled out. So results are those of all
    postings. Queries out of bounds, and those with a term that no text has, find nothing.
    ``keep(df, name)`` writes an intermediate table, of headers or hits; the second result is
    (query_id, segment, bucket, bound, rare, phase), for reports.
    """
    terms = weighted_terms(queries, frequencies, statistics, keep)
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "bucket")
    before = F.coalesce(F.sum("rare").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = keep(candidate_buckets(terms, blocks), "buckets")
    # Each bucket has a posting of the rarest term, so these are enough; the filter prunes before the shuffle.
    likely = buckets.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= PROBE * k)
    likely = keep(likely.withColumn("before", before).where(F.col("before") < PROBE * k).drop("nth", "before"), "likely")
    first = keep(bucket_scores(likely, terms, blocks, tombstones, searchable, keep), "probed")
    ranked = top_k(first, k, "score", ascending=True)
    edge = ranked.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("edge")).where(F.col("n") == k).select("query_id", "edge")
    rest = buckets.join(likely.select("query_id", "segment", "bucket"), ["query_id", "segment", "bucket"], "left_anti").join(edge, "query_id", "left")
    rest = rest.where(F.col("edge").isNull() | (F.col("bound") >= -F.col("edge") - SLACK)).drop("edge")
    second = bucket_scores(rest, terms, blocks, tombstones, searchable, keep)
    read = likely.withColumn("phase", F.lit(1)).unionByName(rest.withColumn("phase", F.lit(2)))
    return top_k(ranked.drop("rank").unionByName(second), k, "score", ascending=True), read


def all_matches(queries: DataFrame, blocks: DataFrame, frequencies: DataFrame, statistics: DataFrame, tombstones: DataFrame, searchable: DataFrame | None = None) -> DataFrame:
    """(query_id, asset_id, score) of every text that holds all terms of a query, from the rarest term on."""
    terms = weighted_terms(queries, frequencies, statistics)
    return bucket_scores(candidate_buckets(terms, blocks), terms, blocks, tombstones, searchable)


def work_report(read: DataFrame, terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, postings, postings_read): how many postings a query's terms have, and in the buckets that were read."""
    heads = blocks.select("term", "segment", "bucket", "n").join(terms.select("term").distinct(), "term", "left_semi")
    every = heads.groupBy("term").agg(F.sum("n").alias("df"))
    asked = terms.join(every, "term").groupBy("query_id").agg(F.sum("df").alias("postings"))
    used = read.select("query_id", "segment", "bucket").join(terms.select("query_id", "term"), "query_id").join(heads, ["term", "segment", "bucket"])
    return asked.join(used.groupBy("query_id").agg(F.sum("n").alias("postings_read")), "query_id", "left").na.fill(0, ["postings_read"])
