"""Writers: versioned tables swapped in as a whole, split exports, reports."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidepool.operators.labels import fingerprint, label_report

POINTER = "number long, version string, columns string, mark long"


def publish(df: DataFrame, root: str, partition_by: tuple[str, ...] = (), fmt: str = "parquet", mark: int | None = None) -> str:
    """Writes a new version of a table and then points to it; readers see the old or the new one.

    The pointer is a one-row table whose name sorts by version, so nothing that is read is
    ever overwritten, and a writer that dies leaves no trace in what readers see. A table
    has one writer at a time: of two that publish at once, readers see one. A ``mark``, the
    generation or micro-batch that the version holds, is published with it as one step.
    """
    spark = df.sparkSession
    version = f"{_latest(spark, root)[0] + 1:08d}-{uuid.uuid4().hex[:8]}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer = writer.option("compression", "zstd") if fmt == "parquet" else writer
    writer.format(fmt).option("header", True).save(f"{root}/{version}")
    pointer = spark.createDataFrame([(int(version[:8]), version, df.schema.json(), mark)], POINTER)
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/_current_versions")
    return f"{root}/{version}"


def _latest(spark: SparkSession, root: str) -> tuple[int, str | None, str | None, int | None]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_current_versions")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return 0, None, None, None
    row = spark.read.schema(POINTER).parquet(str(path)).orderBy(F.desc("number"), F.desc("version")).first()
    return tuple(row) if row else (0, None, None, None)


def current(spark: SparkSession, root: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """The latest published version of a table, with the columns it was written with (so an empty one has them too)."""
    _, version, kinds, _ = _latest(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    reader = spark.read.format(fmt).option("header", True)
    return reader.schema(schema or StructType.fromJson(json.loads(kinds))).load(f"{root}/{version}")


def published_mark(spark: SparkSession, root: str) -> int | None:
    """The mark of the latest published version; none if nothing is published or it has none."""
    return _latest(spark, root)[3]


@dataclass(frozen=True)
class Index:
    """The derived index: assets, stages, texts, and vectors of complete stages. Words are in sources/word_segments.py."""

    assets: DataFrame
    stages: DataFrame
    texts: DataFrame
    vectors: DataFrame


def publish_index(assets: DataFrame, stages: DataFrame, texts: DataFrame, vectors: DataFrame, root: str, copies: bool = True) -> Index:
    """Publishes the derived index and reads it back.

    Stages lie by kind and version, vectors by the version of their stage, so a search reads
    the current ones only. Without ``copies`` only the vectors are written; the other tables
    are read where they are.
    """
    if copies:
        publish(assets, f"{root}/assets")
        publish(stages, f"{root}/stages", ("kind", "version"))
        publish(texts, f"{root}/texts")
    done = stages.where((F.col("kind") == "embedding") & (F.col("status") == "complete")).select("asset_id", "version")
    publish(vectors.join(done, "asset_id"), f"{root}/vectors", ("version",))
    return read_index(assets.sparkSession, root, () if copies else (assets, stages, texts))


def read_index(spark: SparkSession, root: str, in_place: tuple[DataFrame, ...] = ()) -> Index:
    """The latest published version of each table of an index, after those that are read ``in_place``."""
    return Index(*in_place, *(current(spark, f"{root}/{f.name}") for f in fields(Index)[len(in_place) :]))


def export_splits(labels: DataFrame, root: str) -> DataFrame:
    """Writes one partition for each split; returns (split, rows) of what was written, with the set's fingerprint."""
    path = publish(labels, root, ("split",))
    saved = labels.sparkSession.read.schema(labels.schema).parquet(path)
    return saved.groupBy("split").agg(F.count("*").alias("rows")).crossJoin(fingerprint(saved))


def freeze(labels: DataFrame, corpus: DataFrame, root: str) -> DataFrame:
    """Exports a label set by splits once all rule suites pass; a set that breaks one is an error and writes nothing."""
    broken = label_report(labels, corpus).orderBy("rule").limit(20).collect()
    if broken:
        raise ValueError("an invalid set can't be frozen: " + ", ".join(f"{r['rule']} ({r['n']})" for r in broken))
    return export_splits(labels, root)


#: Columns of a provenance table, fixed.
PROVENANCE = (
    "dataset", "source_image_id", "relative_path", "download_url", "original_url", "license_name", "license_url", "sha256", "bytes",
)


def write_provenance(images: DataFrame, path: str) -> None:
    """Where each image comes from, as CSV with a header, ordered by relative_path over all files."""
    images.select(*PROVENANCE).orderBy("relative_path").write.mode("errorifexists").option("header", True).csv(path)


def write_report(cases: DataFrame, run: dict[str, str], path: str) -> None:
    """Evaluation cases as JSON lines, each with the run's metadata, in id order within files."""
    entries = [x for k, v in sorted(run.items()) for x in (F.lit(k), F.lit(v))]
    cases.withColumn("run", F.create_map(*entries)).sortWithinPartitions("query_id").write.mode("errorifexists").json(path)
