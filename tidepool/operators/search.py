"""Hybrid retrieval for whole tables of queries: exact cosine, BM25 words, reciprocal-rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.functions import vectors as V
from tidepool.sources.shared import spread

K1, B = 1.2, 0.75
#: Candidates of each channel in a combined search, results of one, and the fusion constant.
CANDIDATES, RESULTS, FUSION = 100, 50, 60
#: Most results that a caller may ask for.
RESULTS_LIMIT = 100
#: Digits of a word score that don't depend on how a logarithm is rounded.
SCORE_DIGITS = 12
#: Queries that meet a batch of assets at a time, and most bytes of query vectors that are broadcast.
QUERY_BLOCK, MOST_BROADCAST_BYTES = 256, 64 << 20
#: Products of queries and assets that are held at a time.
PRODUCTS = 4 << 20
#: Queries, and assets, of a block where more queries than that meet the assets block by block.
MEET = 4096
#: Assets of a partition, about; pairs of a batch where all are returned, and vectors of a block on either side of them.
ASSETS, PAIRS, PAIRED = 65_536, 1 << 16, 1024
#: Pairs of a task, about, and assets that all queries meet before the next ones: ids that repeat so closely take hardly any bytes of a column file.
TASK_PAIRS, TILE = 1 << 26, 256
#: Most query terms that are broadcast; more join by a shuffle.
MOST_BROADCAST_TERMS = 500_000


def top_k(scored: DataFrame, k: int, score: str, ascending: bool = False, by: str = "query_id", tie: str = "asset_id") -> DataFrame:
    """The k best of each query with ``rank`` from 1; the filter on the window prunes before the shuffle."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order, tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def compatible(queries: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries of a model space that the index has, the others)."""
    models = vectors.select("model_id").distinct()
    return queries.join(models, "model_id", "left_semi"), queries.join(models, "model_id", "left_anti")


def cosine_scores(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, asset_id, similarity) of every pair in one model space; 1 where a vector has no direction or another length.

    The result is as long as both tables multiplied, so it is made in pieces of PAIRS rows: TILE assets
    meet some queries at a time, in element order. Assets are dealt to tasks of TASK_PAIRS pairs, so
    what a task writes, or leaves when it is lost, doesn't grow with the tables. Queries are broadcast
    up to MOST_BROADCAST_BYTES of vectors; beyond it blocks of queries meet blocks of assets.
    """
    q, a = (x.select(name, "model_id", V.normalized(F.col("embedding")).alias("v")) for x, name in ((queries, "query_id"), (vectors, "asset_id")))
    kinds = [x.schema[name].dataType.simpleString() for x, name in ((q, "query_id"), (a, "asset_id"))]
    schema = f"query_id {kinds[0]}, asset_id {kinds[1]}, similarity float"
    if _vector_bytes(q) > MOST_BROADCAST_BYTES:
        return _pairs_in_blocks(q, a, schema)
    asked = q.toArrow()
    most = min(ASSETS, max(1, TASK_PAIRS // max(1, len(asked))))
    shared = queries.sparkSession.sparkContext.broadcast({m: _by_length(t, "query_id") for m, t in _by_model(asked)})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for model, part in _by_model(pa.Table.from_batches([b])):
                if model in shared.value:
                    yield from _pairs(shared.value[model], _by_length(part, "asset_id"))

    # Spread before the vectors are computed on: they shuffle as floats.
    a = spread(vectors.select("asset_id", "model_id", "embedding"), "asset_id", most)[0]
    return a.select("asset_id", "model_id", V.normalized(F.col("embedding")).alias("v")).mapInArrow(meet, schema)


def _vector_bytes(q: DataFrame) -> int:
    return q.agg(F.sum(8 * F.greatest(F.size("v"), F.lit(1)).cast("long"))).first()[0] or 0


def _by_model(table: pa.Table) -> list[tuple[str, pa.Table]]:
    """The rows of each model that is not null."""
    models = pa.compute.unique(table["model_id"]).drop_null().to_pylist()
    return [(m, table.filter(pa.compute.equal(table["model_id"], m))) for m in models]


def _by_length(table: pa.Table, name: str) -> list[tuple[int, pa.Array, np.ndarray]]:
    """(length, ids, matrix) of the rows of each length; vectors that are null have length 0."""
    ids, v = table[name].combine_chunks(), table["v"].combine_chunks()
    sizes = pa.compute.fill_null(v.value_lengths(), 0).to_numpy()
    pieces = []
    for n in np.unique(sizes):
        rows = pa.array(np.flatnonzero(sizes == n))
        flat = v.take(rows).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        pieces.append((int(n), ids.take(rows), flat.reshape(len(rows), -1)))
    return pieces


def _cosines(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Float cosines of every row with every column, as sums in element order give them.

    The matrix product sums in another order. Both orders are off by less than half the slack, so only a
    sum that a float's edge lies so near to is made again in order, or all of them where there are many.
    """
    rough = rows @ columns
    slack = (len(columns) + 2) * 2.0**-52 * np.sqrt((rows * rows).sum(1).max() * (columns * columns).sum(0).max())
    found, most = (np.clip(x, -1, 1).astype(np.float32) for x in (rough - slack, rough + slack))
    unsure = found != most
    if 16 * np.count_nonzero(unsure) < unsure.size:
        r, c = np.nonzero(unsure)
        total = np.zeros(len(r))
        for d in range(len(columns)):
            total += rows[r, d] * columns[d, c]
        found[r, c] = np.clip(total, -1, 1)
        return found
    total, product = np.zeros(rough.shape), np.empty(rough.shape)
    for d in range(len(columns)):
        np.multiply(rows[:, d, None], columns[d], out=product)
        total += product
    return np.clip(total, -1, 1).astype(np.float32)


def _pairs(queries: list[tuple[int, pa.Array, np.ndarray]], assets: list[tuple[int, pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Every pair of queries and assets by length, PAIRS rows at a time, or those of one query and TILE assets."""
    for dim, names, matrix in assets:
        for first in range(0, len(names), TILE):
            tile, columns = names[first : first + TILE], np.ascontiguousarray(matrix[first : first + TILE].T)
            few = max(1, PAIRS // len(tile))
            for dim_q, ids, block in queries:
                for at in range(0, len(ids), few):
                    part = block[at : at + few]
                    found = _cosines(part, columns) if dim and dim == dim_q else np.ones((len(part), len(tile)), np.float32)
                    left, right = np.repeat(np.arange(at, at + len(part)), len(tile)), np.tile(np.arange(len(tile)), len(part))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(left)), tile.take(pa.array(right)), pa.array(found.ravel())], ["query_id", "asset_id", "similarity"])


def _pairs_in_blocks(q: DataFrame, a: DataFrame, schema: str) -> DataFrame:
    """All pairs where each block of PAIRED queries meets each block of PAIRED assets of its model, a group of its own."""
    blocks = lambda x, name: x.groupBy("model_id").agg(F.ceil(F.count("*") / PAIRED).cast("int").alias(name))
    shape = F.broadcast(blocks(q, "qb").join(blocks(a, "ab"), "model_id"))  # a row for each model
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    model = F.col("model_id").alias("_model_id")  # a new column: queries may come from the assets' own table
    left = q.join(shape, "model_id").select(model, own("query_id", "qb").alias("i"), upto("ab").alias("j"), "query_id", "v")
    right = a.join(shape, "model_id").select(model, upto("qb").alias("i"), own("asset_id", "ab").alias("j"), "asset_id", "v")

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        kinds = [x.schema.field("query_id").type, y.schema.field("asset_id").type, pa.float32()]
        none = pa.table([pa.array([], t) for t in kinds], ["query_id", "asset_id", "similarity"])
        return pa.concat_tables([none, *(pa.Table.from_batches([b]) for b in _pairs(_by_length(x, "query_id"), _by_length(y, "asset_id")))])

    key = ["_model_id", "i", "j"]
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(meet, schema)


def _nearest(block: np.ndarray, names: np.ndarray, matrix: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of ``block``, asset, similarity) of the k nearest of ``matrix`` for each row, ties to the smaller id."""
    order = np.argsort(names, kind="stable")
    names, matrix = names[order], matrix[order]
    step = max(1, min(QUERY_BLOCK, PRODUCTS // max(1, len(names))))
    for at in range(0, len(block), step):
        part_q = block[at : at + step]
        rough = part_q @ matrix.T
        few = min(k, len(names))
        edge = np.partition(rough, -few, axis=1)[:, -few] - 1e-6
        r, c = np.nonzero(rough >= edge[:, None])
        exact = np.zeros(len(r))
        for d in range(matrix.shape[1]):
            exact += part_q[r, d] * matrix[c, d]
        yield _cut(r + at, names[c], np.clip(exact, -1, 1).astype(np.float32), k)


def _cut(rows: np.ndarray, names: np.ndarray, similarity: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row by similarity, then by name."""
    best = np.lexsort((names, -similarity, rows))
    rows = rows[best]
    begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    place = np.arange(len(rows)) - np.repeat(begins, np.diff(np.append(begins, len(rows))))
    best = best[place < k]
    return rows[place < k], names[best], similarity[best]


def _meet_in_blocks(q: DataFrame, a: DataFrame, k: int, schema: str) -> DataFrame:
    """Candidates of each query from each block of assets: every block of queries meets every block of its model."""
    q, a = (x.withColumn("dim", F.size("v")) for x in (q, a))
    space = ["model_id", "dim"]
    blocks = lambda x, name: x.groupBy(space).agg(F.ceil(F.count("*") / MEET).cast("int").alias(name))
    shape = blocks(q, "qb").join(blocks(a, "ab"), space)
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    named = [F.col(c).alias(f"_{c}") for c in space]  # new columns: queries may come from the assets' own table
    left = q.join(shape, space).select(*named, own("query_id", "qb").alias("i"), upto("ab").alias("j"), "query_id", "v")
    right = a.join(shape, space).select(*named, upto("qb").alias("i"), own("asset_id", "ab").alias("j"), "asset_id", "v")
    matrix = lambda column: column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    names = ["query_id", "asset_id", "similarity"]

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        kinds = [x.schema.field("query_id").type, y.schema.field("asset_id").type, pa.float32()]
        empty = pa.table([pa.array([], t) for t in kinds], names)
        if not x.num_rows or not y.num_rows:
            return empty
        ids, assets = x.column("query_id").to_pylist(), np.array(y.column("asset_id").to_pylist())
        ids = pa.array(ids, kinds[0])
        found = _nearest(matrix(x.column("v")), assets, matrix(y.column("v")), k)
        return pa.concat_tables([pa.table([ids.take(pa.array(r)), pa.array(n, kinds[1]), pa.array(v)], names) for r, n, v in found])

    key = ["_model_id", "_dim", "i", "j"]
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(meet, schema)


def semantic_top_k(queries: DataFrame, vectors: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(query_id, asset_id, similarity, rank): the k nearest assets of each query by cosine.

    Assets are dealt to all cores. Each partition multiplies its vectors, about ASSETS at most, with a
    block of queries of their model at a time and gives k candidates per query; a window merges the partitions.
    The product only picks candidates: similarities are summed in element order. Queries are
    broadcast while their vectors take at most MOST_BROADCAST_BYTES; more meet the assets in
    blocks, each a task that returns k candidates per query, never all pairs.
    """
    found, schema = nearest_in_partitions(queries, vectors, k)
    return top_k(found, k, "similarity")


def nearest_in_partitions(queries: DataFrame, vectors: DataFrame, k: int) -> tuple[DataFrame, str]:
    """Candidates of each query: at most k from a partition of assets, or from a block of them."""
    unit = lambda x, name: x.select(name, "model_id", V.doubles(V.normalized(F.col("embedding"))).alias("v")).where(F.col("v").isNotNull())
    q = unit(queries, "query_id")
    kind = queries.schema["query_id"].dataType.simpleString()
    asset_kind = vectors.schema["asset_id"].dataType.simpleString()
    schema = f"query_id {kind}, asset_id {asset_kind}, similarity float"
    if _vector_bytes(q) > MOST_BROADCAST_BYTES:
        return _meet_in_blocks(q, unit(vectors, "asset_id"), k, schema), schema
    spaces = {(m, piece[0]): piece[1:] for m, t in _by_model(q.toArrow()) for piece in _by_length(t, "query_id")}
    shared = queries.sparkSession.sparkContext.broadcast(spaces)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[pa.Array, np.ndarray]]] = {}
        for b in batches:
            for model, part in _by_model(pa.Table.from_batches([b])):
                for dim, names, matrix in _by_length(part, "asset_id"):
                    if (model, dim) in shared.value:
                        held.setdefault((model, dim), []).append((names, matrix))
        for space in list(held):
            names, matrices = zip(*held.pop(space), strict=True)
            names, matrix = pa.concat_arrays(names), np.concatenate(matrices)
            ids, block = shared.value[space]
            places = np.array(names.to_pylist())
            for r, found, similarity in _nearest(block, places, matrix, k):
                columns = [ids.take(pa.array(r)), pa.array(found, names.type), pa.array(similarity)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "asset_id", "similarity"])

    # Spread before the vectors are computed on: they shuffle as floats. A task holds its partition's vectors.
    a = spread(vectors.select("asset_id", "model_id", "embedding"), "asset_id", ASSETS)[0]
    return unit(a, "asset_id").mapInArrow(search, schema), schema


def postings(texts: DataFrame) -> DataFrame:
    """(term, asset_id, tf, n_tokens) of every indexed text (asset_id, text); ids are unique.

    A text's tokens are sorted and counted within its row, so nothing is shuffled.
    """
    sorted_ = texts.select("asset_id", F.array_sort(T.tokens(F.col("text"))).alias("t"))
    begins = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    rows = sorted_.select("asset_id", "t", F.size("t").alias("n_tokens"), begins.alias("at"))
    counted = F.transform("at", lambda i, k: F.struct(
        F.get("t", i).alias("term"), (F.coalesce(F.get("at", k + 1), F.col("n_tokens")) - i).cast("long").alias("tf")
    ))
    # An inner explode would make the optimizer filter on the tokens first, and tokenize twice.
    each = rows.select("asset_id", "n_tokens", F.explode_outer(counted).alias("p"))
    return each.select("p.term", "asset_id", "p.tf", "n_tokens").where(F.col("term").isNotNull())


def corpus_statistics(texts: DataFrame) -> DataFrame:
    """One row: n_docs and avg_tokens over all indexed texts, whatever their version."""
    # Folding moves no token boundary, so tokens are counted on the text as it is.
    texts = spread(texts.select("asset_id", "text"), "asset_id", ASSETS)[0]
    return texts.agg(F.count("*").alias("n_docs"), F.avg(T.n_terms(F.col("text"))).alias("avg_tokens"))


def document_frequencies(texts: DataFrame) -> DataFrame:
    return postings(texts).groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times, n_terms) of usable queries (query_id, text); repeated terms count again."""
    usable = queries.where(T.query_status(F.col("text")) == "ok").select("query_id", T.tokens(F.col("text")).alias("t"))
    words = usable.select("query_id", F.size(F.array_distinct("t")).alias("n_terms"), F.explode("t").alias("term"))
    return words.groupBy("query_id", "term").agg(F.count("*").alias("times"), F.first("n_terms").alias("n_terms"))


def _asked_postings(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, term, times, n_terms, asset_id, tf, n_tokens, df) where query terms occur; others are dropped at once."""
    asked = query_terms(queries)
    return _with_frequencies(asked, _wanted(asked, postings(texts)))


def _wanted(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose term a query asks for; the terms are broadcast up to a checked number."""
    terms = asked.select("term").distinct()
    if terms.limit(MOST_BROADCAST_TERMS + 1).count() <= MOST_BROADCAST_TERMS:
        terms = F.broadcast(terms)
    return rows.join(terms, "term", "left_semi")


def _with_frequencies(asked: DataFrame, found: DataFrame) -> DataFrame:
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    return found.join(asked.join(df, "term"), "term")


def bm25_scores(queries: DataFrame, texts: DataFrame, searchable: DataFrame | None = None) -> DataFrame:
    """(query_id, asset_id, score): BM25 of the matches, negative, smaller is better.

    The statistics cover all texts; only ``searchable`` (asset_id) may be found. This is the
    plain form, which reads every posting of every term; word_index.py searches an index.
    """
    return _bm25(_asked_postings(queries, texts), corpus_statistics(texts), searchable)


def term_sum(part: Column) -> Column:
    """The negative sum of the parts of a hit, the same in whatever order they come.

    The part of each number that is a multiple of 2^-20 sums up exactly, and what is left is too small
    for the order to matter.
    """
    coarse = F.rint(part * (1 << 20)) / (1 << 20)
    return F.round(-(F.sum(coarse) + F.sum(part - coarse)), SCORE_DIGITS)


def _bm25(rows: DataFrame, statistics: DataFrame, searchable: DataFrame | None) -> DataFrame:
    stats = F.broadcast(statistics)  # one row
    if searchable is not None:
        rows = rows.join(searchable.select("asset_id").distinct(), "asset_id", "left_semi")
    rows = rows.crossJoin(stats)
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    length = 1 - B + B * F.col("n_tokens") / F.col("avg_tokens")
    part = F.col("times") * idf * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * length))
    hits = rows.groupBy("query_id", "asset_id").agg(
        F.count("*").alias("n"), F.first("n_terms").alias("n_terms"), term_sum(part).alias("score")
    )
    return hits.where(F.col("n") == F.col("n_terms")).select("query_id", "asset_id", "score")


def fuse(visual: DataFrame, words: DataFrame, limit: int = RESULTS) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, asset_id, rank, ...): score 1 / (60 + rank) summed.

    An asset listed twice in a channel counts once, at its first rank; later ranks keep
    theirs. Payloads of both channels survive; ties go by id.
    """

    def channel(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in ("query_id", "asset_id", "rank")]
        best = df.groupBy("query_id", "asset_id").agg(F.min_by(F.struct("rank", *rest), "rank").alias("b"))
        return best.select("query_id", "asset_id", F.col("b.rank").alias(f"{name}_rank"), *[F.col(f"b.{c}").alias(c) for c in rest])

    both = channel(visual, "visual").join(channel(words, "text"), ["query_id", "asset_id"], "full_outer")
    share = lambda c: F.coalesce(1 / (FUSION + F.col(c)), F.lit(0.0))
    return top_k(both.withColumn("fused", share("visual_rank") + share("text_rank")), limit, "fused")


def search_text(words: DataFrame, assets: DataFrame) -> DataFrame:
    """Text-only search from ranked word hits: (query_id, asset_id, rank, fused, the assets' metadata).

    The caller's limit applied to the hits; the score is 1 / (60 + rank). Queries out of
    bounds find nothing, and a hit without a record is an error.
    """
    hits = words.select("query_id", "asset_id", "rank", (1 / (FUSION + F.col("rank"))).alias("fused"))
    return with_metadata(hits, assets)


def search_combined(vector_queries: DataFrame, vectors: DataFrame, words: DataFrame, limit: int = RESULTS) -> DataFrame:
    """Combined search: CANDIDATES of each channel, fused and cut; a channel may be missing.

    ``vectors`` are those of complete stages of the current version, ``words`` the ranked
    hits among assets whose recognised text is complete and current. A query out of the
    bounds of the text channel still searches visually.
    """
    check_limit(limit, RESULTS_LIMIT)
    visual = semantic_top_k(vector_queries, vectors, CANDIDATES)
    return fuse(visual, words.withColumnRenamed("score", "bm25"), limit)


def check_limit(limit: int, most: int) -> None:
    """Refuses a number of results outside 1 to ``most``, before anything is read."""
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= most:
        raise ValueError(f"a limit is a whole number from 1 to {most}, not {limit!r}")


def with_metadata(matches: DataFrame, assets: DataFrame) -> DataFrame:
    """Matches with their assets' columns; a match whose asset is missing fails the query that reads it."""
    there = assets.withColumn("_there", F.lit(True))
    joined = matches.join(there, "asset_id", "left")
    missing = F.raise_error(F.concat(F.lit("no record of asset "), F.col("asset_id").cast("string")))
    # The check is a column that the filter needs, so no plan can leave it out.
    return joined.where(F.when(F.col("_there"), F.lit(True)).otherwise(missing.cast("boolean"))).drop("_there")


def with_records(matches: DataFrame, assets: DataFrame, texts: DataFrame) -> DataFrame:
    """Fused matches with the assets' metadata, and the recognised text of those that the text channel found."""
    found = matches.where(F.col("text_rank").isNotNull()).select("query_id", "asset_id").join(texts.select("asset_id", "text"), "asset_id")
    return with_metadata(matches, assets).join(found, ["query_id", "asset_id"], "left")


def accessible(matches: DataFrame, indexed: DataFrame, visible: DataFrame, metadata: list[str]) -> DataFrame:
    """Matches whose asset is still visible with the metadata that was indexed."""
    now = visible.select("asset_id", *[F.col(c).alias(f"_now_{c}") for c in metadata])
    same = indexed.select("asset_id", *metadata).join(now, "asset_id")
    for c in metadata:
        same = same.where(F.col(c).eqNullSafe(F.col(f"_now_{c}")))
    return matches.join(same.select("asset_id"), "asset_id", "left_semi")


_GRAPHEME, _WORD = regex.compile(r"\X"), regex.compile(r"[\p{L}\p{N}]")
SNIPPET_LENGTH, SNIPPET_BEFORE = 200, 24


def excerpt(text: str | None, wanted: set[str], fold) -> list[tuple[str, bool]] | None:
    """Segments (text, is_match) around the first wanted word; null if there is none.

    At most 200 graphemes: 24 before the match, whole words at both ends, blanks folded,
    an ellipsis where something is left out. ``fold`` maps words as the index does.
    """
    if not text or not wanted:
        return None
    chars = _GRAPHEME.findall(text)
    wordy = [bool(_WORD.match(c)) for c in chars]
    words, i = [], 0
    while i < len(chars):
        j = i
        while j < len(chars) and wordy[j]:
            j += 1
        if j > i:
            words.append((i, j))
        i = max(j, i + 1)
    hits = [(a, b) for a, b in words if fold("".join(chars[a:b])) in wanted]
    if not hits:
        return None
    first = hits[0]
    lo = max(0, first[0] - SNIPPET_BEFORE)
    lo = next((min(b, first[0]) for a, b in words if a < lo < b), lo)
    hi = min(len(chars), lo + SNIPPET_LENGTH - 4)
    if first[1] <= hi:
        hi = next((max(a, first[1]) for a, b in words if a < hi < b), hi)
    marks = [False] * len(chars)
    for a, b in hits:
        marks[a:b] = [True] * (b - a)
    flow = [("…", False), (" ", False)] if lo else []
    flow += list(zip(chars[lo:hi], marks[lo:hi], strict=True))
    flow += [(" ", False), ("…", False)] if hi < len(chars) else []
    out: list[tuple[str, bool]] = []
    blank = False
    for c, hit in flow:
        if c.isspace():
            blank = bool(out)
            continue
        for piece, mark in ([(" ", False)] if blank else []) + [(c, hit)]:
            if out and out[-1][1] == mark:
                out[-1] = (out[-1][0] + piece, mark)
            else:
                out.append((piece, mark))
        blank = False
    return out


def fold_word(word: str) -> str:
    """A word as the index folds it."""
    table = str.maketrans(*T._latin_fold())
    return regex.sub(r"(?<=[a-z])\p{Mn}", "", word.lower().translate(table))


def snippets(matches: DataFrame, texts: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, asset_id, segments) for matches (query_id, asset_id); only matches reach Python."""
    rows = matches.select("query_id", "asset_id").join(texts.select("asset_id", "text"), "asset_id")
    words = queries.where(T.query_status(F.col("text")) == "ok").select("query_id", T.tokens(F.col("text")).alias("words"))
    rows = rows.join(words, "query_id", "left")

    @F.pandas_udf("array<struct<text:string,is_match:boolean>>")
    def cut(text: pd.Series, wanted: pd.Series) -> pd.Series:
        def one(t, w):
            found = excerpt(t, set(w) if w is not None else set(), fold_word)
            return None if found is None else [{"text": a, "is_match": b} for a, b in found]

        return pd.Series([one(t, w) for t, w in zip(text, wanted, strict=True)], dtype=object)

    return rows.select("query_id", "asset_id", cut("text", "words").alias("segments"))
