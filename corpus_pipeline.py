"""From raw documents to token ids: the stages of a training corpus, each an operator of tidepool.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as
Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.bpe import decode_ids, encode_texts
from tidepool.llm.language_id import fit_languages, identify_languages
from tidepool.llm.mixing import WORD, mix_sources
from tidepool.llm.near_dups import near_duplicates
from tidepool.llm.passages import dedup_passages
from tidepool.llm.shared import Scratch, join_sized, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Names each document's language; those that the classifier rejects go.

    Rejected are null texts, texts without a letter and narrow margins (ties among them).
    Each row is judged by its whole text alone, however long: repeated rows fare alike and
    null ids don't matter. ``lang`` becomes the found language, other columns stay; further
    columns, whatever their names, go. No rows give no rows.
    """
    small_batches(spark)
    found = identify_languages(docs, fit_languages(docs), keep=("text", "source", "n_chars"))
    return found.where(~F.col("rejected")).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that occur before, by id and line; a document left without words by that goes.

    Null and empty texts stay as they are, and so do rows without id; rows of equal id and
    text are one document, cut alike. Very long texts are cut like others. ``n_chars`` is
    counted anew, null for a null text; further columns go. No rows give no rows.
    """
    small_batches(spark)
    cut = dedup_passages(docs)
    cut = cut.where((F.col("removed_lines") == 0) | F.col("text").rlike(WORD))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by shingles of four words, as op4 has them, the one with the smallest id stays.

    Rows without id, and null, empty and blank texts, link with nothing and stay. Different
    texts of one id are one document and stay together; rows equal in id and text are one
    row, of which one stays. Whole texts are compared, however long; further columns go. No
    rows give no rows.
    """
    small_batches(spark)
    kept = near_duplicates(docs, words=4).where(F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.where(F.col("doc_id").isNotNull()).select(COLUMNS).dropDuplicates(["doc_id", "text"])
    rows = named.join(kept, named["doc_id"] == kept["_kept"], "left_semi")
    return rows.unionByName(docs.where(F.col("doc_id").isNull()).select(COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time a document is taken, cut after its last word taken.

    The queue holds no texts: a row's key in it is its id with a hash of its text, and texts
    are joined once, by that key. Rows equal in id, text and source are taken one by one; only
    such rows' texts are shuffled to find them.
    Null and empty texts have no words and are never taken; a null source is a source; a
    very long text queues in packets. Further columns go. No rows give no rows.
    """
    small_batches(spark)
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("doc_id", "text", "source"))
    keyed = docs.select(*COLUMNS, key.alias("_key"))
    taken = mix_sources(keyed, id_col="_key").select("doc_id", "size", F.explode("takes").alias("t")).where(F.col("t.taken") > 0)
    taken = taken.groupBy(F.col("doc_id").alias("_key")).agg(F.collect_list(F.struct("size", "t.taken")).alias("_items"))
    copied = keyed.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select("_key")
    once = join_sized(keyed, copied, ["_key"], "left_anti").unionByName(join_sized(keyed, copied, ["_key"], "left_semi").dropDuplicates(["_key"]))
    rows = once.join(taken, "_key").select(*COLUMNS, F.explode("_items").alias("_item"))
    words = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("_item.taken").cast("int")), "")
    text = F.when(F.col("_item.taken") < F.col("_item.size"), cut).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it.

    Null and empty texts have no tokens (and decode to nothing, which counts as true);
    repeated rows are encoded each, null ids stay null, whole texts are encoded however
    long. Further columns go. No rows give no rows.
    """
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode_texts(docs, path, keep=("lang", "source", "text"))
    whole = decode_ids(F.col("ids"), path) == F.coalesce("text", F.lit("")).cast("binary")
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), whole.alias("round_trip"))


STAGES = [("language", language), ("lines", lines), ("near", near), ("mix", mix), ("tokens", tokens)]

#: Compression has no SQL form, so the whole run has none; tests hold each stage against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
