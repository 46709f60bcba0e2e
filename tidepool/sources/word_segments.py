"""The word index as segments: changed texts are tokenized, others are left as they are.

A segment holds the posting blocks of the texts that it added, signed differences of term
and corpus counts, and tombstones of the texts of earlier segments that it replaced or
removed. Many segments are merged into one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.operators.search import postings
from tidepool.operators.word_index import BLOCKS, posting_blocks, term_frequencies
from tidepool.sources.tables import current, publish

#: Segments beyond which an update merges them.
MOST_SEGMENTS = 8
LIST = "segment int, blocks string, frequencies string, tombstones string, n_docs long, tokens long, id_kind string"


@dataclass(frozen=True)
class WordIndex:
    """Blocks, (term, df), one row of (n_docs, avg_tokens) and (asset_id, segment) tombstones of all segments."""

    blocks: DataFrame
    frequencies: DataFrame
    statistics: DataFrame
    tombstones: DataFrame
    segments: tuple[int, ...]


def _listed(spark: SparkSession, root: str) -> list:
    try:
        return current(spark, f"{root}/segments").orderBy("segment").collect()  # a row a segment
    except FileNotFoundError:
        return []


def read_words(spark: SparkSession, root: str) -> WordIndex:
    """The published segments as one index."""
    rows = _listed(spark, root)
    if not rows:
        raise FileNotFoundError(f"no word index is published in {root}")
    kind = rows[0]["id_kind"]
    load = lambda name, schema: spark.read.schema(schema).parquet(*[r[name] for r in rows])
    n_docs, tokens = sum(r["n_docs"] for r in rows), sum(r["tokens"] for r in rows)
    statistics = spark.createDataFrame([(n_docs, tokens / n_docs if n_docs else None)], "n_docs long, avg_tokens double")
    frequencies = load("frequencies", "term string, df long")
    if len(rows) > 1:
        frequencies = frequencies.groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") > 0)
    return WordIndex(load("blocks", BLOCKS.format(id=kind)), frequencies, statistics, load("tombstones", f"asset_id {kind}, segment int"), tuple(r["segment"] for r in rows))


def _write(rows: list, added: DataFrame, gone: DataFrame, root: str, segment: int) -> None:
    """Writes one segment and publishes the list with it; readers see the list before or after."""
    spark, kind = added.sparkSession, added.schema["asset_id"].dataType.simpleString()
    blocks = publish(posting_blocks(added, segment), f"{root}/blocks")
    stored = spark.read.schema(BLOCKS.format(id=kind)).parquet(blocks)
    counts = term_frequencies(stored)
    n_docs, tokens = added.count(), stored.agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    if rows:
        counts = counts.unionByName(postings(gone).groupBy("term").agg((-F.count("*")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") != 0)
        away = gone.agg(F.count("*"), F.sum(F.size(T.tokens(F.col("text"))).cast("long"))).first()
        n_docs, tokens = n_docs - away[0], tokens - (away[1] or 0)
    frequencies = publish(counts.sortWithinPartitions("term"), f"{root}/frequencies")
    tombstones = publish(gone.select("asset_id", F.lit(segment).alias("segment")), f"{root}/tombstones")
    kept = [tuple(r) for r in rows]
    publish(spark.createDataFrame([*kept, (segment, blocks, frequencies, tombstones, n_docs, tokens, kind)], LIST).coalesce(1), f"{root}/segments")


def build_words(texts: DataFrame, root: str) -> WordIndex:
    """Publishes one segment of all texts (asset_id, text); ids are unique, null texts have no words.

    No texts give an index of one empty segment.
    """
    _write([], texts, texts.limit(0), root, 0)
    return read_words(texts.sparkSession, root)


def update_words(stored: DataFrame, now: DataFrame, diff: DataFrame, root: str, source: str | None = None, most: int = MOST_SEGMENTS) -> WordIndex:
    """Publishes a segment of what a snapshot changed, given stored and present texts and (asset_id, change).

    Present texts of added and changed assets are tokenized into blocks, stored ones of
    changed and removed assets are counted once more to take them out of the counts; all
    others are not read by the tokenizer. Where nothing changed nothing is written. Earlier
    segments are those of ``source`` (``root`` itself if not given), which stays as it is. With
    ``most`` segments already there, one segment of all present texts replaces them. An
    asset that the diff calls changed but that has no stored text counts as added.
    """
    spark = stored.sparkSession
    rows = _listed(spark, source or root)
    if not rows or len(rows) >= most:
        segment = rows[-1]["segment"] + 1 if rows else 0
        _write([], now, now.limit(0), root, segment)
        return read_words(spark, root)
    touched = diff.where(F.col("change") != "unchanged").select("asset_id")
    added = now.join(touched, "asset_id", "left_semi").select("asset_id", "text")
    gone = stored.join(touched, "asset_id", "left_semi").select("asset_id", "text")
    if not added.isEmpty() or not gone.isEmpty():
        _write(rows, added, gone, root, rows[-1]["segment"] + 1)
        return read_words(spark, root)
    return read_words(spark, source or root)
