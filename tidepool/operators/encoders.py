"""Pluggable models: encoders, recognisers, language detectors and translators as Arrow functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.text import MOST_QUERY_BYTES, script

Encoder = Callable[[list[str]], np.ndarray]
#: Most bytes of a translation.
MOST_TEXT_BYTES = 16_384


def encoder_udf(make: Callable[[], Encoder], dimension: int, batch_size: int = 256):
    """text -> unit vector; ``make`` loads the model once in each worker."""

    def load():
        encode = make()

        def predict(texts: np.ndarray) -> np.ndarray:
            v = np.asarray(encode(["" if t is None else str(t) for t in texts]), np.float64).reshape(len(texts), dimension)
            size = np.linalg.norm(v, axis=1, keepdims=True)
            return (v / np.where(size > 0, size, 1)).astype(np.float32)

        return predict

    return predict_batch_udf(load, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)


def recognise(files: DataFrame, make: Callable[[], Callable[[bytes], list[dict]]], line: str) -> DataFrame:
    """(path, lines, error) of binary files; one bad file is a row with an error, never a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = make()
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows.append((path, read(bytes(content)), None))
                except Exception as e:  # noqa: BLE001 - the error is the result
                    rows.append((path, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "lines", "error"])

    return files.select("path", "content").mapInPandas(run, f"path string, lines array<{line}>, error string")


def detector_udf(make: Callable[[], Callable[[str], dict[str, float]]]):
    """text -> language confidences."""

    @F.pandas_udf("map<string,double>")
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = make()
        for s in batches:
            yield s.map(lambda t: {} if t is None else f(t))

    return detect


def translator_udf(make: Callable[[], Callable[[str], str]]):
    @F.pandas_udf("string")
    def translate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = make()
        for s in batches:
            yield s.map(f, na_action="ignore")

    return translate


def route(text: Column, choice: Column, hypotheses: Column, least: float = 0.8, margin: float = 0.2) -> Column:
    """The status of a query: ru or en where it has a language, else what is wrong with it.

    A text of more than 4096 bytes is tooLong, a blank one empty. A choice of ru or en
    decides alone. Otherwise the letters must be all Latin or all Cyrillic and the
    detector's winner (a map of confidences) must have ``least`` and lead by ``margin``;
    fewer than four letters, a mix of both scripts, an unclear winner or one that the script
    contradicts are ambiguousLanguage, other scripts and languages unsupportedLanguage.
    """
    valid = F.filter(F.map_entries(hypotheses), lambda e: ~F.isnan(e["value"]) & e["value"].between(0, 1))
    ranked = F.sort_array(F.transform(valid, lambda e: F.struct(e["value"].alias("p"), e["key"].alias("l"))), asc=False)
    best, second = F.get(ranked, F.lit(0)), F.coalesce(F.get(ranked, F.lit(1))["p"], F.lit(0.0))
    clear = F.coalesce((best["p"] >= least) & (best["p"] - second >= margin), F.lit(False))
    kind, ambiguous = script(text), F.lit("ambiguousLanguage")
    return (
        F.when(F.octet_length(text) > MOST_QUERY_BYTES, "tooLong")
        .when(F.coalesce(F.regexp_replace(text, r"[\s\p{Z}]+", ""), F.lit("")) == "", "empty")
        .when(choice.isin("ru", "en"), choice)
        .when(kind.isin("short", "mixed"), ambiguous)
        .when(kind == "other", "unsupportedLanguage")
        .when(~clear | (best["l"] == "und"), ambiguous)
        .when((best["l"] == "ru") & (kind == "cyrillic"), "ru")
        .when((best["l"] == "en") & (kind == "latin"), "en")
        .when(best["l"].isin("ru", "en"), ambiguous)
        .otherwise("unsupportedLanguage")
    )


def prepare_queries(queries: DataFrame, detector, translator, encoder, dimension: int) -> DataFrame:
    """(query_id, original_text, status, english_text, embedding) of queries (query_id, text, and choice if there is one).

    Russian is translated, English goes as it is; a translation that is blank or of more
    than 16,384 bytes is invalidTranslation. Queries with another status than ru or en have
    no English text and no embedding: they can only be searched by their words. The
    original text stays.
    """
    choice = F.col("choice") if "choice" in queries.columns else F.lit(None).cast("string")
    trimmed = F.regexp_replace("text", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    rows = queries.select("query_id", F.col("text").alias("original_text"), trimmed.alias("_t"), route(F.col("text"), choice, detector_udf(detector)("text")).alias("status"))
    english = F.when(F.col("status") == "ru", F.trim(translator_udf(translator)(F.col("_t")))).when(F.col("status") == "en", F.col("_t"))
    rows = rows.withColumn("english_text", english).drop("_t")
    bad = (F.col("status") == "ru") & ~F.coalesce(F.octet_length("english_text").between(1, MOST_TEXT_BYTES), F.lit(False))
    rows = rows.withColumn("status", F.when(bad, "invalidTranslation").otherwise(F.col("status")))
    rows = rows.withColumn("english_text", F.when(F.col("status").isin("ru", "en"), F.col("english_text")))
    return rows.withColumn("embedding", F.when(F.col("english_text").isNotNull(), encoder_udf(encoder, dimension)("english_text")))


def script_detector() -> Callable[[str], dict[str, float]]:
    """A stand-in for a language model: the share of Cyrillic and of Latin letters."""

    def detect(text: str) -> dict[str, float]:
        letters = [c for c in text if c.isalpha()]
        cyrillic = sum("\u0400" <= c <= "\u04ff" for c in letters)
        return {"ru": cyrillic / len(letters), "en": 1 - cyrillic / len(letters)} if letters else {}

    return detect


def hash_encoder() -> Encoder:
    """A deterministic stand-in for a model: counts of hashed letters."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 16))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, zlib.crc32(w.encode()) % 16] += 1
        return out

    return encode


def upper_translator() -> Callable[[str], str]:
    """A stand-in for a translator."""
    return str.upper
