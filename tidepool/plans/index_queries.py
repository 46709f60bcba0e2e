"""Queries of the derived index: rules, summaries, differences, states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions import vectors as V
from tidepool.operators import encoders
from tidepool.operators import index_state as I
from tidepool.operators import refresh as R
from tidepool.operators import stage_machine as M
from tidepool.plans.registry import query
from tidepool.plans.tables import Tables, with_tables

METADATA = ["width", "height", "creation_s", "modification_s"]
SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM s.{c}" for c in METADATA)
DIFF = f"""diff AS (SELECT coalesce(a.asset_id, s.asset_id) AS asset_id, CASE WHEN a.asset_id IS NULL THEN 'added' WHEN s.asset_id IS NULL THEN 'removed'
  WHEN coalesce(a.asset_id, s.asset_id) IN (SELECT asset_id FROM invalidated) OR NOT ({SAME}) THEN 'changed' ELSE 'unchanged' END AS change
  FROM assets a FULL OUTER JOIN snapshot s ON a.asset_id = s.asset_id)"""
NEXT = """plan AS (SELECT asset_id, change, kind, version FROM diff, (VALUES ('embedding', 'clip-1'), ('ocr', 'ocr-1')) w(kind, version) WHERE change <> 'removed'),
next AS (SELECT p.asset_id, p.kind, p.version, CASE WHEN p.change = 'unchanged' AND s.version = p.version THEN s.status ELSE 'pending' END AS status
  FROM plan p LEFT JOIN stages s ON p.asset_id = s.asset_id AND p.kind = s.kind)"""
VERSIONS = {"embedding": "clip-1", "ocr": "ocr-1"}
WIDE = "wide AS (SELECT asset_id, max(status) FILTER (kind = 'embedding') AS embedding, max(status) FILTER (kind = 'ocr') AS ocr FROM stages GROUP BY asset_id)"
SUMMARY = f"""{WIDE}, summary AS (SELECT count(*) AS total, count(*) FILTER (embedding = 'complete' AND ocr = 'complete') AS complete,
  count(*) FILTER (embedding = 'complete') AS embedding_complete, count(*) FILTER (ocr = 'complete') AS ocr_complete,
  count(*) FILTER (embedding IN ('pending', 'processing') OR ocr IN ('pending', 'processing')) AS pending,
  count(*) FILTER (embedding = 'requiresDownload' OR ocr = 'requiresDownload') AS download_required,
  count(*) FILTER (embedding = 'failed' OR ocr = 'failed') AS failed FROM assets LEFT JOIN wide USING (asset_id))"""


@query(with_tables("assets") + " SELECT asset_id, width, height, creation_s, modification_s FROM assets WHERE NOT hidden")
def scan_assets(t: Tables) -> DataFrame:
    return t.visible.select("asset_id", *METADATA).orderBy(F.col("creation_s").desc_nulls_last(), "asset_id")


ODD_ASSETS = """SELECT doc_id AS row_id, CASE WHEN doc_id % 41 = 0 THEN '' WHEN doc_id % 43 = 0 THEN cast(doc_id - 1 AS string) ELSE cast(doc_id AS string) END AS asset_id,
n_chars % 50 AS width, length(lang) AS height, CASE WHEN doc_id % 47 = 0 THEN cast('Infinity' AS double) ELSE cast(doc_id AS double) END AS creation,
cast(NULL AS double) AS modification FROM {documents}"""


@query(f"""WITH odd AS ({ODD_ASSETS.replace('AS string', 'AS VARCHAR').format(documents='documents')}),
marked AS (SELECT *, count(*) OVER (PARTITION BY asset_id) AS n FROM odd)
SELECT row_id, 'empty_id' AS rule FROM odd WHERE asset_id = '' UNION ALL SELECT row_id, 'size' FROM odd WHERE NOT (width > 0 AND height > 0)
UNION ALL SELECT row_id, 'date' FROM odd WHERE isinf(creation) UNION ALL SELECT row_id, 'duplicate_id' FROM marked WHERE n > 1""")
def invalid_assets(t: Tables) -> DataFrame:
    return I.asset_problems(t.spark.sql(ODD_ASSETS, documents=t.documents))


@query("""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x: (x * 2)::FLOAT) ELSE embedding END AS e,
CASE WHEN vec_id % 11 = 0 THEN ' ' ELSE 'clip' END AS model FROM embeddings)
SELECT vec_id, 'norm' AS rule FROM v WHERE abs(sqrt(list_inner_product(e::DOUBLE[], e::DOUBLE[])) - 1) > 1e-5
UNION ALL SELECT vec_id, 'model' FROM v WHERE trim(model) = '' UNION ALL SELECT vec_id, 'dimension' FROM v WHERE len(e) <> 64""")
def vector_quality(t: Tables) -> DataFrame:
    odd = F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: (x * 2).cast("float"))).otherwise(F.col("embedding"))
    model = F.when(F.col("vec_id") % 11 == 0, " ").otherwise("clip")
    return t.embeddings.select("vec_id", F.explode(V.vector_problems(model, odd, 64)).alias("rule"))


ODD_STAGES = """SELECT asset_id, CASE WHEN asset_id % 59 = 0 THEN 'face' ELSE kind END AS kind, CASE WHEN asset_id % 61 = 0 THEN 'done' ELSE status END AS status,
CASE WHEN status = 'processing' OR asset_id % 23 = 0 THEN 'a' END AS attempt,
CASE WHEN status = 'complete' AND asset_id % 29 <> 0 THEN CASE WHEN asset_id % 31 = 0 THEN 2047 ELSE 2048 END END AS payload_bytes,
CASE WHEN status = 'failed' THEN 'x' END AS failure FROM {stages}"""


@query(with_tables("stages") + f""", odd AS ({ODD_STAGES.format(stages='stages')})
SELECT asset_id, kind, 'kind' AS rule FROM odd WHERE kind NOT IN ('embedding', 'ocr')
UNION ALL SELECT asset_id, kind, 'status' FROM odd WHERE status = 'done'
UNION ALL SELECT asset_id, kind, 'attempt' FROM odd WHERE (status = 'processing') <> (attempt IS NOT NULL)
UNION ALL SELECT asset_id, kind, 'payload' FROM odd WHERE (status = 'complete') <> (payload_bytes IS NOT NULL)
UNION ALL SELECT asset_id, kind, 'failure' FROM odd WHERE (status = 'failed') <> (failure IS NOT NULL)
UNION ALL SELECT asset_id, kind, 'embedding_size' FROM odd WHERE kind = 'embedding' AND payload_bytes <> 2048""")
def stage_violations(t: Tables) -> DataFrame:
    return I.stage_problems(t.spark.sql(ODD_STAGES, stages=t.stages), 2048)


@query(with_tables("stages") + " SELECT asset_id, kind, version FROM stages WHERE status = 'complete' AND (kind, version) IN (('ocr', 'ocr-1'), ('embedding', 'clip-1'))")
def searchable_by_version(t: Tables) -> DataFrame:
    both = [I.searchable(t.stages, k, v) for k, v in VERSIONS.items()]
    return both[0].unionByName(both[1]).select("asset_id", "kind", "version")


@query(with_tables("stages") + f", {WIDE} SELECT asset_id, embedding, ocr FROM wide")
def asset_stage_wide(t: Tables) -> DataFrame:
    return I.wide(t.stages)


@query(with_tables("assets", "stages") + f", {SUMMARY} SELECT * FROM summary")
def index_summary(t: Tables) -> DataFrame:
    return I.summary(t.assets, t.stages)


COVERAGE = """rows AS (SELECT 'text' AS mode, total, ocr_complete AS n, ocr_complete > 0 AS ready FROM summary
UNION ALL SELECT 'combined', total, least(ocr_complete, embedding_complete), ocr_complete > 0 OR embedding_complete > 0 FROM summary)"""


@query(with_tables("assets", "stages") + f", {SUMMARY}, {COVERAGE} SELECT mode, total, total > 0 AND n = total AS complete, n || ' of ' || total AS detail FROM rows")
def search_coverage(t: Tables) -> DataFrame:
    return I.coverage(I.summary(t.assets, t.stages)).drop("status")


@query(with_tables("assets", "stages") + f", {SUMMARY}, {COVERAGE} SELECT mode, CASE WHEN ready THEN 'ready' ELSE 'emptyIndex' END AS status FROM rows")
def index_readiness(t: Tables) -> DataFrame:
    return I.coverage(I.summary(t.assets, t.stages)).select("mode", "status")


@query(with_tables("stages", "snapshot") + " SELECT asset_id, kind, status FROM stages WHERE asset_id IN (SELECT asset_id FROM snapshot)")
def retain_only(t: Tables) -> DataFrame:
    return I.retain_only(t.stages, t.snapshot).select("asset_id", "kind", "status")


@query(with_tables("assets", "snapshot", "invalidated") + f", {DIFF} SELECT asset_id, change FROM diff")
def snapshot_diff(t: Tables) -> DataFrame:
    return I.snapshot_diff(t.assets, t.snapshot, t.invalidated, METADATA)


@query(with_tables("assets", "snapshot", "stages") + f" SELECT g.asset_id, g.kind, g.status FROM stages g JOIN assets a ON g.asset_id = a.asset_id JOIN snapshot s ON g.asset_id = s.asset_id WHERE {SAME}")
def retained_results(t: Tables) -> DataFrame:
    none = t.invalidated.limit(0)
    same = I.snapshot_diff(t.assets, t.snapshot, none, METADATA).where("change = 'unchanged'")
    return I.retain_only(t.stages, same).select("asset_id", "kind", "status")


@query(with_tables("assets", "stages") + " SELECT asset_id, width, height FROM assets WHERE asset_id > 40 AND asset_id IN (SELECT asset_id FROM stages WHERE status = 'pending') ORDER BY asset_id LIMIT 20")
def pending_page(t: Tables) -> DataFrame:
    return I.pending_page(t.assets, t.stages, 40, 20).select("asset_id", "width", "height")


@query(with_tables("assets", "snapshot", "invalidated", "stages") + f", {DIFF}, {NEXT} SELECT * FROM next")
def reconciled_stages(t: Tables) -> DataFrame:
    return I.reconciled(t.stages, snapshot_diff(t), VERSIONS)


@query(with_tables("assets", "snapshot", "invalidated", "stages") + f""", {DIFF}, {NEXT}
SELECT asset_id, kind, version, CASE WHEN status = 'complete' THEN status ELSE 'pending' END AS status FROM next""")
def index_refresh(t: Tables) -> DataFrame:
    return I.refreshed(t.stages, snapshot_diff(t), VERSIONS)


@query(with_tables("stages") + " SELECT asset_id, kind, CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status FROM stages")
def recovered_stages(t: Tables) -> DataFrame:
    return I.recovered(t.stages).select("asset_id", "kind", "status")


@query(with_tables("assets", "snapshot", "invalidated") + f", {DIFF} SELECT asset_id FROM diff WHERE change = 'removed' UNION SELECT asset_id FROM invalidated UNION SELECT DISTINCT user_id FROM events WHERE event_type = 'error'")
def invalidation_set(t: Tables) -> DataFrame:
    removed = snapshot_diff(t).where("change = 'removed'")
    unresolved = t.events.where("event_type = 'error'").select(F.col("user_id").alias("asset_id"))
    return I.invalidations(removed=removed, content=t.invalidated, unresolved=unresolved)


@query("""WITH n AS (SELECT user_id AS asset_id, max(event_id) AS seq FROM events GROUP BY user_id),
c AS (SELECT user_id AS asset_id, event_id AS seq FROM events WHERE event_type = 'view')
SELECT * FROM n WHERE (asset_id, seq) NOT IN (SELECT (asset_id, seq) FROM c)""")
def unacknowledged_changes(t: Tables) -> DataFrame:
    notices = t.events.select(F.col("user_id").alias("asset_id"), F.col("event_id").alias("seq"), "event_type")
    return I.unacknowledged(notices, notices.where("event_type = 'view'"))


@query("SELECT user_id, max(event_id) AS generation, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_baseline(t: Tables) -> DataFrame:
    """A slow snapshot never replaces one of a newer generation."""
    rows = t.events.select("user_id", F.col("event_id").alias("generation"), "value")
    rows = rows.withColumn("g", F.col("generation"))
    return I.latest_by(rows, ["user_id"], ["g"]).select("user_id", "generation", "value")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def latest_stage_state(t: Tables) -> DataFrame:
    return I.latest_by(t.events.select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""SELECT user_id, event_type, epoch(date_trunc('hour', ts))::BIGINT AS hour_s, arg_min(value, (ts, event_id)) AS value, arg_min(event_id, (ts, event_id)) AS event_id
FROM events GROUP BY ALL""")
def deduplicated_results(t: Tables) -> DataFrame:
    """Answers by request (user, kind, hour): the first one's payload; a second answer for one request doesn't count."""
    hour = F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("hour_s")
    answers = t.events.select("user_id", "event_type", hour, "ts", "event_id", "value")
    return M.first_answers(answers, ["user_id", "event_type", "hour_s"], ["ts", "event_id"]).drop("ts")


@query(with_tables("begun", "log", "requests", "answers") + """ SELECT request AS event_id FROM requests q WHERE NOT EXISTS (
  SELECT 1 FROM answers a WHERE a.request = q.request AND a.ts >= q.ts AND epoch(a.ts) - epoch(q.ts) <= 150000)""")
def timed_out_requests(t: Tables) -> DataFrame:
    """Requests without an answer of their own in time: thirty seconds of a clock five thousand times as fast."""
    return M.timed_out(t.requests, t.answers, 30 * 5000).select(F.col("request").alias("event_id"))


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, event_type, count(*) AS n FROM events GROUP BY ALL")
def availability_by_window(t: Tables) -> DataFrame:
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.unix_timestamp("w.start").alias("start_s"), "event_type", "n")


FLAGS = """SELECT event_id, event_id % 2 = 1 AND event_id % 3 = 0 AS cancelled, event_id % 7 = 0 AS degraded, event_id % 5 = 0 AS needs_network,
CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type = 'error' END AS error, event_type IN ('view', 'click') AS has_data, event_type = 'signup' AS in_cloud,
cast(floor(value) AS bigint) * 1000000 AS bytes FROM {events}"""
STATUS = """CASE WHEN coalesce(cancelled, false) OR degraded THEN 'unavailable' WHEN needs_network THEN 'requiresDownload' WHEN coalesce(error, false) THEN 'unavailable'
WHEN has_data THEN CASE WHEN bytes > 0 AND bytes <= 67108864 THEN 'local' ELSE 'unavailable' END WHEN in_cloud THEN 'requiresDownload' ELSE 'unavailable' END"""


@query(f"WITH f AS ({FLAGS.format(events='events')}) SELECT event_id, {STATUS} AS status FROM f")
def source_status(t: Tables) -> DataFrame:
    return t.spark.sql(FLAGS, events=t.events).select("event_id", I.source_status().alias("status"))


@query(with_tables("assets") + f""", f AS ({FLAGS.format(events='events')}), r AS (SELECT event_id AS asset_id, {STATUS} AS status FROM f)
SELECT count(*) AS total, count(status) AS checked, count(*) - count(status) AS unchecked, count(*) FILTER (status = 'local') AS local,
count(*) FILTER (status = 'requiresDownload') AS download_required, count(*) FILTER (status = 'unavailable') AS unavailable,
count(*) FILTER (status IN ('requiresDownload', 'unavailable')) AS skipped FROM assets LEFT JOIN r USING (asset_id) WHERE NOT hidden""")
def availability_counts(t: Tables) -> DataFrame:
    results = source_status(t).withColumnRenamed("event_id", "asset_id")
    is_ = lambda s: F.count_if(F.col("status") == s)
    return t.visible.join(results, "asset_id", "left").agg(
        F.count("*").alias("total"), F.count("status").alias("checked"), F.count_if(F.col("status").isNull()).alias("unchecked"),
        is_("local").alias("local"), is_("requiresDownload").alias("download_required"), is_("unavailable").alias("unavailable"),
        F.count_if(F.col("status").isin("requiresDownload", "unavailable")).alias("skipped"),
    )


def picky_encoder():
    """The stand-in encoder, which refuses long texts and those that begin with a capital A."""
    encode = encoders.hash_encoder()

    def model(texts: list[str]) -> list:
        for t in texts:
            if len(t) > 5000:
                raise R.SourceError("imageTooLarge")
            if t.startswith("A"):
                raise ValueError("no reading of this text")
        return encode(texts).tolist()

    return model


@query(with_tables("stages") + """ SELECT asset_id, kind, version, CASE WHEN status <> 'pending' OR kind <> 'embedding' THEN CASE WHEN status = 'pending' THEN 'processing' ELSE status END
  WHEN asset_id % 9 = 0 THEN 'requiresDownload' WHEN asset_id % 10 = 4 OR text IS NULL OR length(text) > 5000 OR text LIKE 'A%' THEN 'failed' ELSE 'complete' END AS status,
CASE WHEN status = 'pending' AND kind = 'embedding' AND asset_id % 9 <> 0 THEN CASE WHEN asset_id % 10 = 4 THEN 'sourceUnavailable' WHEN text IS NULL THEN 'invalidSource'
  WHEN length(text) > 5000 THEN 'sourceTooLarge' WHEN text LIKE 'A%' THEN 'processingFailed' END END AS failure FROM stages JOIN documents ON doc_id = asset_id""")
def processed_stages(t: Tables) -> DataFrame:
    """All pending vectors encoded and saved: a text that the model refuses is a failed stage with its code, the rest complete."""
    d = F.col("doc_id")
    availability = F.when(d % 9 == 0, "requiresDownload").when(d % 10 == 4, "unavailable").otherwise("local")
    sources = t.documents.select(d.alias("asset_id"), availability.alias("availability"), F.col("text").alias("content"))
    none = F.lit(None).cast("string")
    stages = t.stages.withColumns({"attempt": none, "failure": none})
    return R.process_pending(stages, sources, {"embedding": (picky_encoder, "array<double>")}, "run")[0].drop("attempt")


ERRORS = "CASE event_type WHEN 'error' THEN 'imageTooLarge' WHEN 'click' THEN 'timeout' WHEN 'purchase' THEN 'missingModel' WHEN 'signup' THEN NULL ELSE 'other' END"


@query(f"""SELECT event_id, CASE {ERRORS} WHEN 'imageTooLarge' THEN 'sourceTooLarge' WHEN 'timeout' THEN 'sourceUnavailable' WHEN 'missingModel' THEN 'modelUnavailable'
WHEN 'other' THEN 'processingFailed' END AS failure FROM events""")
def failure_codes(t: Tables) -> DataFrame:
    return t.events.select("event_id", I.failure_code(F.expr(ERRORS)).alias("failure"))


#: The log replayed event by event, a step of every key at a time.
REPLAYED = """numbered AS (SELECT *, row_number() OVER (PARTITION BY "key" ORDER BY ts, seq) AS nth,
  count(*) FILTER (event = 'upsert' AND changed) OVER (PARTITION BY "key" ORDER BY ts, seq) AS generations FROM log),
replayed AS (
  SELECT "key", 0::BIGINT AS nth, 0::BIGINT AS seq, NULL::VARCHAR AS event, NULL::BIGINT AS ticket, NULL::VARCHAR AS status, NULL::BIGINT AS attempt, NULL::VARCHAR AS version, true AS accepted
  FROM (SELECT DISTINCT "key" FROM log)
  UNION ALL
  SELECT "key", nth, seq, event, ticket,
    CASE WHEN NOT ok THEN status WHEN event = 'upsert' THEN CASE WHEN status IS NULL OR changed OR version IS DISTINCT FROM next_version THEN 'pending' ELSE status END
      WHEN event = 'begin' THEN 'processing' WHEN event IN ('retry', 'retryDownloads', 'recover', 'cancel') THEN 'pending' WHEN event = 'complete' THEN 'complete'
      WHEN event = 'fail' THEN 'failed' WHEN event = 'needsDownload' THEN 'requiresDownload' END,
    CASE WHEN NOT ok THEN attempt WHEN event = 'begin' THEN seq WHEN event = 'upsert' AND status IS NOT NULL AND NOT changed AND version IS NOT DISTINCT FROM next_version THEN attempt END,
    CASE WHEN event = 'upsert' THEN next_version ELSE version END, ok
  FROM (
    SELECT n.*, n.attempt AS ticket, n.version AS next_version, r.status, r.attempt, r.version,
      CASE WHEN n.event = 'upsert' THEN true WHEN r.status IS NULL THEN false
        WHEN n.event = 'begin' THEN r.status IN ('pending', 'failed', 'requiresDownload') WHEN n.event = 'retry' THEN r.status IN ('failed', 'requiresDownload')
        WHEN n.event = 'retryDownloads' THEN r.status = 'requiresDownload' WHEN n.event = 'recover' THEN r.status = 'processing'
        ELSE coalesce(r.status = 'processing' AND n.attempt = r.attempt AND n.generation = n.generations AND n.version = r.version, false) END AS ok
    FROM replayed r JOIN (SELECT "key", nth, ts, seq, event, changed, attempt, generation, version, generations FROM numbered) n ON n."key" = r."key" AND n.nth = r.nth + 1
  ) s("key", nth, ts, seq, event, changed, _a, generation, _v, generations, ticket, next_version, status, attempt, version, ok))"""


@query(with_tables("begun", "log", recursive=True) + f""", {REPLAYED}
SELECT "key", arg_max(struct_pack(s := status), nth).s AS status, arg_max(struct_pack(a := attempt), nth).a AS attempt,
  (SELECT count(*) FROM log l WHERE l."key" = r."key" AND event = 'upsert' AND changed)::INTEGER AS generation,
  count(*) FILTER (nth > 0 AND accepted) AS accepted, count(*) FILTER (nth > 0 AND NOT accepted) AS rejected FROM replayed r GROUP BY r."key" """)
def stage_state_machine(t: Tables) -> DataFrame:
    return M.replay_log(t.log)


@query(with_tables("begun", "log", recursive=True) + f""", {REPLAYED}
SELECT "key", seq, ticket AS attempt FROM replayed WHERE event IN ('complete', 'fail', 'needsDownload', 'cancel') AND NOT accepted""")
def stale_events(t: Tables) -> DataFrame:
    """Results that the stage machine rejects: of an attempt, generation or version that is not in force, or not processing."""
    return M.stale(t.log)


@query(with_tables("stages") + """, c AS (SELECT status, CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS later FROM stages)
SELECT later AS status, count(*) AS n FROM c GROUP BY later""")
def incremental_summary(t: Tables) -> DataFrame:
    """Counts from the changes alone: every stage appears, then interrupted ones go back."""
    appear = t.stages.select(F.lit(None).cast("string").alias("before"), F.col("status").alias("after"))
    back = t.stages.where("status = 'processing'").select(F.col("status").alias("before"), F.lit("pending").alias("after"))
    return M.running_summary(appear.unionByName(back))
