"""Queries and SQL of the corpus operators, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.ann import NEAREST_SQL, nearest
from tidepool.llm.bpe import decode_ids, encode_texts
from tidepool.llm.divergence import AUDIT_SQL, audit_sources
from tidepool.llm.embedding_dedup import LINKS_SQL, link_vectors
from tidepool.llm.language_id import fit_languages, identify_languages
from tidepool.llm.mixing import MIX_SQL, mix_sources, mixed_totals
from tidepool.llm.near_dups import NEAR_SQL, near_duplicates
from tidepool.llm.passages import dedup_passages
from tidepool.llm.prefix_trie import TRIE_SQL, prefix_trie
from tidepool.llm.quality import fit_quality, score_quality
from tidepool.llm.secrets import KINDS, scan_secrets, spans_text
from tidepool.llm.shared import in_fold, small_batches
from tidepool.llm.token_counts import count_tokens
from tidepool.llm.toxicity import fit_toxicity, score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), in_fold("doc_id", 5, 0)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(~in_fold("doc_id", 4, 2)))
    found = identify_languages(docs, model)
    return found.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_lines")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = scan_secrets(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans")
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(encode_texts(table(spark, sf_dir, "documents"), path), path)


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """n_tokens and the digests of ids and of the decoded bytes."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(decode_ids(F.col("ids"), path), 256).alias("decoded_sha256"),
    )


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_totals(mix_sources(table(spark, sf_dir, "documents")))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), in_fold("doc_id", 5, 0)
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_toxicity": op2_toxicity,
        "op3_language_id": op3_language_id,
        "op4_near_dups": op4_near_dups,
        "op5_line_dedup": op5_line_dedup,
        "op6_secrets": op6_secrets,
        "op7_bpe": op7_bpe,
        "op8_nearest": op8_nearest,
        "op9_mixing": op9_mixing,
        "op10_embedding_dedup": op10_embedding_dedup,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_source_divergence": op12_source_divergence,
        "op13_quality": op13_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_near_dups": NEAR_SQL, "op8_nearest": NEAREST_SQL, "op9_mixing": MIX_SQL, "op10_embedding_dedup": LINKS_SQL, "op11_prefix_trie": TRIE_SQL, "op12_source_divergence": AUDIT_SQL}
