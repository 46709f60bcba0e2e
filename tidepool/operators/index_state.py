"""The derived index: one row per asset and stage, kept current from snapshots and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.vectors import broken
from tidepool.operators.search import check_limit
from tidepool.operators.counts import with_repeats

KINDS = ("embedding", "ocr")
STATUSES = ("pending", "processing", "complete", "requiresDownload", "failed")


def asset_problems(assets: DataFrame) -> DataFrame:
    """(row_id, rule) for every rule that an asset row breaks; ids must be unique in the snapshot.

    Works on (row_id, asset_id string, width, height, creation double, modification double).
    """
    bad_date = lambda c: F.col(c).isNotNull() & (F.isnan(c) | (F.abs(c) == float("inf")))
    rules = [
        ("empty_id", F.coalesce(F.col("asset_id"), F.lit("")) == ""),
        ("long_id", F.octet_length("asset_id") > 4096),
        ("nul_in_id", F.col("asset_id").contains("\0")),
        ("size", ~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))),
        ("date", bad_date("creation") | bad_date("modification")),
        ("duplicate_id", F.col("_same") > 1),
    ]
    counted = with_repeats(assets, F.col("asset_id"), "_same")
    return counted.select("row_id", F.explode(broken(rules)).alias("rule"))


def stage_problems(stages: DataFrame, dimension_bytes: int) -> DataFrame:
    """(asset_id, kind, rule) of stage rows whose fields contradict their status."""
    status = F.col("status")
    rules = [
        ("kind", ~F.col("kind").isin(*KINDS)),
        ("status", ~status.isin(*STATUSES)),
        ("attempt", (status == "processing") != F.col("attempt").isNotNull()),
        ("payload", (status == "complete") != F.col("payload_bytes").isNotNull()),
        ("failure", (status == "failed") != F.col("failure").isNotNull()),
        ("embedding_size", (F.col("kind") == "embedding") & (F.col("payload_bytes") != dimension_bytes)),
    ]
    return stages.select("asset_id", "kind", F.explode(broken(rules)).alias("rule"))


def wide(stages: DataFrame) -> DataFrame:
    """(asset_id, embedding, ocr): both states side by side, in one aggregation."""
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("status"))).alias(k)
    return stages.groupBy("asset_id").agg(*map(pick, KINDS))


def summary(assets: DataFrame, stages: DataFrame) -> DataFrame:
    """One row of overlapping counts; zeros for an empty index."""
    both = assets.select("asset_id").join(wide(stages), "asset_id", "left")
    any_of = lambda *s: F.coalesce(F.col("embedding").isin(*s), F.lit(False)) | F.coalesce(F.col("ocr").isin(*s), F.lit(False))
    done = lambda k: F.coalesce(F.col(k) == "complete", F.lit(False))
    return both.agg(
        F.count("*").alias("total"),
        F.count_if(done("embedding") & done("ocr")).alias("complete"),
        F.count_if(done("embedding")).alias("embedding_complete"),
        F.count_if(done("ocr")).alias("ocr_complete"),
        F.count_if(any_of("pending", "processing")).alias("pending"),
        F.count_if(any_of("requiresDownload")).alias("download_required"),
        F.count_if(any_of("failed")).alias("failed"),
    )


def coverage(summary_row: DataFrame) -> DataFrame:
    """A row for each search mode: whether the index is complete, how far, and whether it can be searched."""
    modes = F.array(
        F.struct(F.lit("text").alias("mode"), F.col("ocr_complete").alias("n"), (F.col("ocr_complete") > 0).alias("ready")),
        F.struct(
            F.lit("combined").alias("mode"), F.least("ocr_complete", "embedding_complete").alias("n"),
            ((F.col("ocr_complete") > 0) | (F.col("embedding_complete") > 0)).alias("ready"),
        ),
    )
    rows = summary_row.select("total", F.explode(modes).alias("m")).select("total", "m.*")
    return rows.select(
        "mode", "total", ((F.col("total") > 0) & (F.col("n") == F.col("total"))).alias("complete"),
        F.concat_ws(" of ", "n", "total").alias("detail"), F.when(F.col("ready"), "ready").otherwise("emptyIndex").alias("status"),
    )


def searchable(stages: DataFrame, kind: str, version: str) -> DataFrame:
    """Complete results of one kind and version; both columns prune partitions of the stage table."""
    return stages.where((F.col("kind") == kind) & (F.col("version") == version) & (F.col("status") == "complete"))


def pending_page(assets: DataFrame, stages: DataFrame, after: Column | int | str, limit: int) -> DataFrame:
    """The next ``limit`` assets, 1 to 1000, after a cursor that have a pending stage, ascending."""
    check_limit(limit, 1000)
    waiting = stages.where(F.col("status") == "pending").select("asset_id").distinct()
    return assets.where(F.col("asset_id") > after).join(waiting, "asset_id", "left_semi").orderBy("asset_id").limit(limit)


def retain_only(rows: DataFrame, permitted: DataFrame) -> DataFrame:
    """Derived rows of permitted assets; none if nothing is permitted."""
    return rows.join(permitted.select("asset_id").distinct(), "asset_id", "left_semi")


def snapshot_diff(stored: DataFrame, current: DataFrame, invalidated: DataFrame, metadata: list[str], all_changed: bool = False) -> DataFrame:
    """(asset_id, change): unchanged, changed, removed or added, by null-safe metadata.

    Assets named in ``invalidated`` have changed content, whatever their metadata.
    """
    old = stored.select("asset_id", F.lit(True).alias("_old"), *[F.col(c).alias(f"_o_{c}") for c in metadata])
    new = current.select("asset_id", F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in metadata])
    gone = invalidated.select("asset_id").distinct().withColumn("_gone", F.lit(True))
    both = old.join(new, "asset_id", "full_outer").join(gone, "asset_id", "left")
    same = F.lit(not all_changed)
    for c in metadata:
        same = same & F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}"))
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(F.col("_gone").isNotNull() | ~same, "changed")
        .otherwise("unchanged")
    )
    return both.select("asset_id", change.alias("change"))


def reconciled(stages: DataFrame, diff: DataFrame, versions: dict[str, str]) -> DataFrame:
    """The next stage table (asset_id, kind, version, status): what a snapshot leaves of the old one.

    Added and changed assets start over, removed ones go, an unchanged stage of an older
    version starts over alone, the rest keeps its status.
    """
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("version")) for k, v in versions.items()]))
    plan = diff.where(F.col("change") != "removed").select("asset_id", "change", wanted.alias("w")).select("asset_id", "change", "w.*")
    old = stages.select("asset_id", "kind", F.col("version").alias("_version"), F.col("status").alias("_status"))
    rows = plan.join(old, ["asset_id", "kind"], "left")
    kept = (F.col("change") == "unchanged") & (F.col("_version") == F.col("version"))
    return rows.select("asset_id", "kind", "version", F.when(kept, F.col("_status")).otherwise("pending").alias("status"))


def recovered(stages: DataFrame) -> DataFrame:
    """Work that was interrupted waits again; all else stays."""
    return stages.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


#: What a refresh tries again: all that failed, as its user asks for; downloads alone, once a start; or nothing.
RETRY = {"all": ("failed", "requiresDownload"), "downloads": ("requiresDownload",), None: ()}


def refreshed(stages: DataFrame, diff: DataFrame, versions: dict[str, str], retry: str | None = "all") -> DataFrame:
    """One refresh: reconcile, recover interrupted work, and retry by one of the policies of RETRY."""
    if retry not in RETRY:
        raise ValueError(f"a retry policy is one of {sorted(map(str, RETRY))}, not {retry!r}")
    rows = recovered(reconciled(stages, diff, versions))
    again = F.col("status").isin(*RETRY[retry]) if RETRY[retry] else F.lit(False)
    return rows.withColumn("status", F.when(again, "pending").otherwise(F.col("status")))


def unacknowledged(notices: DataFrame, commits: DataFrame) -> DataFrame:
    """(asset_id, seq) of the latest notice of assets whose latest was not yet acknowledged.

    A commit acknowledges exactly the notices it saw (asset_id, seq); newer ones survive.
    """
    latest = notices.groupBy("asset_id").agg(F.max("seq").alias("seq"))
    return latest.join(commits.select("asset_id", "seq").distinct(), ["asset_id", "seq"], "left_anti")


def invalidations(**named: DataFrame) -> DataFrame:
    """(asset_id): the ids of all notices, once each."""
    out = None
    for df in named.values():
        ids = df.select("asset_id")
        out = ids if out is None else out.unionByName(ids)
    return out.distinct()


def latest_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by the order columns; pre-aggregated, so hot keys are no burden."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return last.select(*keys, "r.*")


def source_status() -> Column:
    """The state of a source answer from its flags, in order of precedence; nulls count as false."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    local_ok = F.coalesce((F.col("bytes") > 0) & (F.col("bytes") <= 64 << 20), F.lit(False))
    return (
        F.when(flag("cancelled") | flag("degraded"), "unavailable")
        .when(flag("needs_network"), "requiresDownload")
        .when(flag("error"), "unavailable")
        .when(flag("has_data"), F.when(local_ok, "local").otherwise("unavailable"))
        .when(flag("in_cloud"), "requiresDownload")
        .otherwise("unavailable")
    )


def failure_code(error: Column) -> Column:
    """A safe code for an error name; unknown ones are processing failures."""
    return (
        F.when(error.isNull(), None)
        .when(error.isin("cancelled", "interrupted"), "interrupted")
        .when(error.isin("invalidImage", "emptyData"), "invalidSource")
        .when(error == "imageTooLarge", "sourceTooLarge")
        .when(error.isin("missingModel", "incompatibleModel"), "modelUnavailable")
        .when(error.isin("timeout", "unavailable"), "sourceUnavailable")
        .otherwise("processingFailed")
    )
