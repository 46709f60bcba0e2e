"""Readers: strict CSV, manifests and annotations in JSON, image files, event logs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators.labels import IMAGE_EXTENSIONS

MANIFEST = "version int, model_id string, source map<string,string>, images array<struct<id:string,path:string,hash:string>>, queries array<struct<id:string,group_id:string,language:string,text:string,expected:array<string>>>"
CAPTIONS = "licenses array<struct<id:long,name:string,url:string>>, images array<struct<id:long,file_name:string,license:long>>, annotations array<struct<image_id:long,caption:string>>"
QUESTIONS = "data array<struct<question_id:long,image_id:string,question:string,answers:array<string>>>"


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV whose header is exactly ``columns``; a wrong header, a short or a long row is an error.

    UTF-8 with or without a byte-order mark; values stay text.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    return reader.option("multiLine", True).option("escape", '"').csv(path)


def _distinct_keys(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) != len(pairs):
        raise ValueError("a key occurs twice")
    return dict(pairs)


def repeats_a_key(text: Column) -> Column:
    """Whether an object in a JSON text names a key twice, which Spark's reader would take in silence."""

    @F.pandas_udf("boolean")
    def check(texts: pd.Series) -> pd.Series:
        def one(t: str) -> bool:
            try:
                json.loads(t, object_pairs_hook=_distinct_keys)
            except ValueError as e:
                return not isinstance(e, json.JSONDecodeError)  # broken JSON is the reader's to refuse
            return False

        return texts.map(one, na_action="ignore")

    return check(text)


def parsed_manifests(manifests: DataFrame, json_col: str) -> DataFrame:
    """``manifests`` with the parsed manifest ``_m``; a repeated key or broken JSON is an error."""
    once = F.when(repeats_a_key(F.col(json_col)), F.raise_error(F.lit("a manifest names a key twice"))).otherwise(F.col(json_col))
    return manifests.withColumn("_m", F.from_json(once, MANIFEST, {"mode": "FAILFAST"}))


def flatten_manifests(manifests: DataFrame, json_col: str) -> DataFrame:
    """A row for each image of JSON manifests; other columns stay."""
    parsed = parsed_manifests(manifests, json_col)
    return parsed.select(*[c for c in manifests.columns if c != json_col], F.explode("_m.images").alias("image"))


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, queries) of manifest files."""
    m = parsed_manifests(spark.read.text(path, wholetext=True), "value").select("_m.*")
    images = m.select("version", "model_id", F.explode("images").alias("i")).select("version", "model_id", "i.*")
    return images, m.select("version", "model_id", F.explode("queries").alias("q")).select("version", "model_id", "q.*")


def read_captions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(licenses, images, captions) of caption metadata; captions keep their place."""
    m = spark.read.schema(CAPTIONS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    licenses = m.select(F.explode("licenses").alias("l")).select(F.col("l.id").alias("license"), "l.name", "l.url")
    images = m.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name", "i.license")
    captions = m.select(F.posexplode("annotations").alias("place", "a")).select("a.image_id", "place", "a.caption")
    return licenses, images, captions


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, image_id, question, place, answer) of question metadata."""
    m = spark.read.schema(QUESTIONS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = m.select(F.explode("data").alias("d")).select("d.question_id", "d.image_id", "d.question", F.posexplode("d.answers").alias("place", "answer"))
    return rows


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def read_image_files(spark: SparkSession, folder: str) -> DataFrame:
    """(relative_path, sha256, bytes, path, content) of image files below a folder; the extension decides."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGE_EXTENSIONS))
    top = folder.rstrip("/") + "/"
    inside = F.expr(f"substring(path, locate({_quoted(top)}, path) + {len(top)})")
    return files.select(inside.alias("relative_path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), "path", "content")
