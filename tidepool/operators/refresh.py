"""Pending work of the index: claimed with tickets, encoded, and saved where the ticket is still in force."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators.index_state import failure_code, refreshed, snapshot_diff
from tidepool.sources.shared import kept
from tidepool.sources.tables import current, publish

Model = Callable[[list], list]
STAGE = ["asset_id", "kind", "version", "status", "attempt", "failure"]


class SourceError(Exception):
    """What a model raises for a source that it can't take; ``code`` names why."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def fallible(make: Callable[[], Model], value_type: str):
    """content -> (value, error): a model as a column that never fails the job.

    ``make`` loads the model once in each task. A batch that raises is taken row by row, so
    only the rows that raise have an error: the code of a SourceError, else the exception's
    name. A null content is emptyData.
    """

    @F.pandas_udf(f"struct<value:{value_type},error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()

        def one(content) -> tuple:
            try:
                return model([content])[0], None
            except Exception as e:  # noqa: BLE001 - the error is the result
                return None, getattr(e, "code", type(e).__name__)

        for contents in batches:
            there = [c for c in contents if c is not None]
            try:
                found = iter([(v, None) for v in model(there)] if there else [])
            except Exception:  # noqa: BLE001 - some row of the batch
                found = map(one, there)
            rows = [(None, "emptyData") if c is None else next(found) for c in contents]
            yield pd.DataFrame({"value": pd.Series([r[0] for r in rows], dtype=object), "error": pd.Series([r[1] for r in rows], dtype=object)})

    return run


def claimed(stages: DataFrame, mark: str) -> DataFrame:
    """The stage table with all pending work processing, each under a ticket of its own that ``mark`` renews."""
    waiting = F.col("status") == "pending"
    ticket = F.sha2(F.concat_ws(":", F.lit(mark), F.col("asset_id").cast("string"), "kind"), 256)
    return stages.select(
        "asset_id", "kind", "version", F.when(waiting, "processing").otherwise(F.col("status")).alias("status"),
        F.when(waiting, ticket).otherwise(F.col("attempt")).alias("attempt"), F.when(~waiting, F.col("failure")).alias("failure"),
    )


def worked(stages: DataFrame, sources: DataFrame, kind: str, make: Callable[[], Model], value_type: str) -> DataFrame:
    """(asset_id, kind, version, attempt, value, status, failure): what became of the claimed work of one kind.

    Sources are (asset_id, availability, content). An asset that needs a download waits for
    it, one without a source or that can't be had has failed, and so has one whose content
    the model refuses; all others are complete.
    """
    work = stages.where((F.col("kind") == kind) & (F.col("status") == "processing")).select("asset_id", "kind", "version", "attempt")
    rows = work.join(sources, "asset_id", "left")
    local = F.col("availability") == "local"
    tried = rows.where(local).withColumn("r", fallible(make, value_type)("content")).select(*work.columns, "r.value", "r.error")
    status = F.when(F.col("error").isNull(), "complete").otherwise("failed")
    done = tried.select(*work.columns, "value", status.alias("status"), failure_code(F.col("error")).alias("failure"))
    none = F.lit(None).cast(done.schema["value"].dataType)
    download = F.coalesce(F.col("availability") == "requiresDownload", F.lit(False))
    rest = rows.where(~F.coalesce(local, F.lit(False))).select(
        *work.columns, none.alias("value"), F.when(download, "requiresDownload").otherwise("failed").alias("status"), F.when(~download, "sourceUnavailable").alias("failure")
    )
    return done.unionByName(rest)


def saved(stages: DataFrame, results: DataFrame) -> DataFrame:
    """The stage table after results, each where version and ticket are those in force and the work is processing.

    A result that is late, or saved again, finds no such stage and changes nothing.
    """
    own = {"_id": "asset_id", "_k": "kind", "_v": "version", "_a": "attempt", "_s": "status", "_f": "failure"}
    new = results.select(*[F.col(c).alias(n) for n, c in own.items()]).dropDuplicates(["_id", "_k", "_v", "_a"])
    mine = (F.col("asset_id") == F.col("_id")) & (F.col("kind") == F.col("_k")) & (F.col("version") == F.col("_v")) & (F.col("attempt") == F.col("_a"))
    rows = stages.select(STAGE).join(new, mine & (F.col("status") == "processing"), "left")
    hit = F.col("_s").isNotNull()
    return rows.select(
        "asset_id", "kind", "version", F.coalesce("_s", "status").alias("status"),
        F.when(~hit, F.col("attempt")).alias("attempt"), F.when(hit, F.col("_f")).otherwise(F.col("failure")).alias("failure"),
    )


def process_pending(stages: DataFrame, sources: DataFrame, models: dict[str, tuple[Callable[[], Model], str]], mark: str, keep=kept) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(stages after all pending work, the values (asset_id, version, value) of each kind).

    Results are written before they are saved, so a model runs once for each piece of work,
    and a lost executor costs its own pieces.
    """
    begun = keep(claimed(stages, mark), "claimed")
    values = {}
    for kind, (make, value_type) in models.items():
        results = keep(worked(begun, sources, kind, make, value_type), f"results-{kind}")
        begun = saved(begun, results)
        values[kind] = results.where("status = 'complete'").select("asset_id", "version", "value")
    return begun, values


def refresh_index(
    root: str,
    snapshot: DataFrame,
    invalidated: DataFrame,
    metadata: list[str],
    versions: dict[str, str],
    sources: DataFrame,
    models: dict[str, tuple[Callable[[], Model], str]],
    mark: str,
    retry: str | None = None,
) -> DataFrame:
    """One refresh of a published index: prune, recover, retry by policy, encode what is pending, save.

    Stages are published twice: claimed, and with results; a refresh that dies between the
    two leaves work that the next one recovers. Values go to a table for each kind beside
    them, whose rows of stages that have changed since no longer count. ``retry`` is that of
    ``refreshed``. Returns the published stages.
    """
    spark = snapshot.sparkSession
    assets = snapshot.select("asset_id", *metadata)
    empty = ", ".join(f"{c} {assets.schema['asset_id'].dataType.simpleString() if c == 'asset_id' else 'string'}" for c in STAGE)
    try:
        stored, stages = current(spark, f"{root}/assets"), current(spark, f"{root}/stages")
    except FileNotFoundError:
        stored, stages = assets.limit(0), spark.createDataFrame([], empty)
    diff = snapshot_diff(stored, assets, invalidated, metadata)
    same = ["asset_id", "kind", "version", "status"]
    ready = refreshed(stages, diff, versions, retry).join(stages.select(*same, "attempt", "failure"), same, "left")
    publish(claimed(ready.select(STAGE), mark), f"{root}/stages", ("kind", "version"))
    publish(assets, f"{root}/assets")
    begun = current(spark, f"{root}/stages").select(STAGE)
    for kind, (make, value_type) in models.items():
        publish(worked(begun, sources, kind, make, value_type), f"{root}/{kind}")
        results = current(spark, f"{root}/{kind}")
        begun = saved(begun, results)
    publish(begun, f"{root}/stages", ("kind", "version"))
    return current(spark, f"{root}/stages").select(STAGE)
