"""Index state, the stage machine, published tables and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidepool.operators import index_state as I
from tidepool.operators import stage_machine as M
from tidepool.sources import tables as P
from tidepool.streaming import jobs as J

META = ["width", "height"]


def stages(spark, rows):
    return spark.createDataFrame(rows, "asset_id string, kind string, version string, status string")


def test_summary_before_and_after_a_retry(spark):
    assets = spark.createDataFrame([(x,) for x in "abcde"], "asset_id string")
    rows = [("a", "embedding", "complete"), ("a", "ocr", "complete"), ("b", "embedding", "complete"), ("b", "ocr", "failed"), ("c", "embedding", "requiresDownload"), ("c", "ocr", "failed"), ("d", "embedding", "requiresDownload"), ("d", "ocr", "requiresDownload"), ("e", "embedding", "pending"), ("e", "ocr", "complete")]
    table = stages(spark, [(a, k, "1", s) for a, k, s in rows])
    assert tuple(I.summary(assets, table).first()) == (5, 1, 2, 2, 1, 2, 2)
    again = table.withColumn("status", F.when(F.col("status").isin("failed", "requiresDownload"), "pending").otherwise(F.col("status")))
    assert tuple(I.summary(assets, again).first()) == (5, 1, 2, 2, 4, 0, 0)
    assert tuple(I.summary(assets.limit(0), table.limit(0)).first()) == (0,) * 7
    assert [r.status for r in I.coverage(I.summary(assets.limit(0), table.limit(0))).collect()] == ["emptyIndex"] * 2


def test_differences_are_null_safe(spark):
    kind = "asset_id string, width int, height int"
    old = spark.createDataFrame([("same", 1, None), ("moved", 1, 1), ("gone", 1, 1), ("stale", 1, 1)], kind)
    new = spark.createDataFrame([("same", 1, None), ("moved", 1, None), ("new", 1, 1), ("stale", 1, 1)], kind)
    bad = spark.createDataFrame([("stale",), ("unheard",)], "asset_id string")
    got = {r.asset_id: r.change for r in I.snapshot_diff(old, new, bad, META).collect()}
    assert got == {"same": "unchanged", "moved": "changed", "gone": "removed", "new": "added", "stale": "changed"}
    every = I.snapshot_diff(old, new, bad, META, all_changed=True)
    assert {r.change for r in every.where("asset_id = 'same'").collect()} == {"changed"}
    table = stages(spark, [("same", "ocr", "1", "complete"), ("same", "embedding", "0", "complete"), ("moved", "ocr", "1", "complete"), ("gone", "ocr", "1", "complete")])
    after = {(r.asset_id, r.kind): r.status for r in I.reconciled(table, I.snapshot_diff(old, new, bad, META), {"ocr": "1", "embedding": "1"}).collect()}
    assert after[("same", "ocr")] == "complete" and after[("same", "embedding")] == "pending"
    assert after[("moved", "ocr")] == "pending" and ("gone", "ocr") not in after and len(after) == 8


@pytest.mark.parametrize(
    ("events", "status", "rejected"),
    [
        ([("begin", 1)], None, 1),
        (["upsert", ("begin", 1), ("complete", 2, 1)], "complete", 0),
        (["upsert", ("begin", 1), ("begin", 2), ("complete", 3, 2)], "processing", 2),
        (["upsert", ("begin", 1), ("recover", 2), ("begin", 3), ("complete", 4, 1)], "processing", 1),
        (["upsert", ("begin", 1), ("fail", 2, 1), ("retry", 3), ("complete", 4, 1)], "pending", 1),
        (["upsert", ("begin", 1), ("needsDownload", 2, 1), ("retryDownloads", 3)], "pending", 0),
        (["upsert", ("begin", 1), ("fail", 2, 1), ("retryDownloads", 3)], "failed", 1),
        (["upsert", ("begin", 1), ("cancel", 2, 1), ("begin", 3), ("complete", 4, 3), ("retry", 5)], "complete", 1),
        (["upsert", ("begin", 1), ("remove", 2), ("complete", 3, 1)], None, 1),
        (["upsert", ("begin", 1), ("complete", 2, 1, 0, "v1")], "processing", 1),  # another generation
        (["upsert", ("begin", 1), ("complete", 2, 1, 1, "v0")], "processing", 1),  # another version
        (["upsert", ("begin", 1), ("upsert", 2, None, None, "v2", False), ("complete", 3, 1, 1, "v1")], "pending", 1),
        (["upsert", ("begin", 1), ("upsert", 2, None, None, "v1", False), ("complete", 3, 1, 1, "v1")], "complete", 0),
    ],
)
def test_transitions(events, status, rejected):
    whole = lambda e: ("upsert", 0, None, None, "v1", True) if e == "upsert" else e if len(e) > 3 else (*e, *[None] * (3 - len(e)), 1, "v1")
    stage, _, no = M.replay([whole(e) for e in events])
    assert (stage.status, no) == (status, rejected)


LOG = "key long, ts timestamp, seq long, event string, changed boolean, attempt long, generation int, version string"


def random_log(spark, seed, keys=(1, 2, None), n=400):
    """Events of every kind; results mostly name a begin that may be in force."""
    import datetime
    import random

    rng, rows = random.Random(seed), []
    for k in keys:
        begins, generation = [0], 0
        for i in range(n):
            event = rng.choice(["upsert", "begin", "begin", "begin", "complete", "fail", "needsDownload", "cancel", "retry", "retryDownloads", "recover", "remove" if rng.random() < 0.1 else "begin", "odd"])
            changed, version = event == "upsert" and (rng.random() < 0.4 or not generation), rng.choice(["v1", "v1", "v1", "v2"])
            generation += changed
            begins += [i] if event == "begin" else []
            ticket = event in M.TICKETS and rng.random() < 0.95
            attempt = rng.choice(begins[-3:]) if ticket else None
            ts = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=11 * (i // 2))
            rows.append((k, ts, i, event, changed if event == "upsert" else None, attempt, generation - (rng.random() < 0.1) if ticket else None, version if ticket or event == "upsert" else None))
    return rows, spark.createDataFrame(rng.sample(rows, len(rows)), LOG).repartition(3)


@pytest.mark.parametrize("seed", [0, 1])
def test_composed_runs_end_where_one_replay_ends(spark, seed):
    rows, log = random_log(spark, seed)
    want, rejected = set(), set()
    for k in (1, 2, None):
        stage, yes, no = M.Stage(), 0, 0
        for r in rows:
            if r[0] == k:
                ok = stage.apply(r[3], r[2], r[5], r[6], r[7], bool(r[4]))
                yes, no = yes + ok, no + (not ok)
                if r[3] in M.TICKETS and not ok:
                    rejected.add((k, r[2], r[5]))
        want.add((k, stage.status, stage.attempt, stage.generation, yes, no))
    assert {tuple(r) for r in M.replay_log(log).collect()} == want
    assert {tuple(r) for r in M.stale(log).collect()} == rejected != set()
    plan = M.replay_log(log)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "_span" in plan
    assert M.replay_log(log.limit(0)).collect() == [] == M.stale(log.limit(0)).collect()


def test_a_hot_key_is_many_runs(spark):
    rows, log = random_log(spark, 3, (7,), 600)
    runs = M.with_force(log).groupBy(F.date_trunc("hour", "ts")).count().agg(F.max("count"), F.count("*")).first()
    assert runs[0] <= 12 and runs[1] > 40
    found = M.RunMap()
    for r in rows[:300]:
        found.take(r[3], r[2], r[5], True, bool(r[4]))
    assert len(found.states) <= 7  # branches that meet are one


def test_most_results_of_the_derived_log_are_accepted(spark):
    from tidepool.plans.tables import Tables

    log = Tables(spark, "/root/testdata/sf0.001").log
    results = log.where(F.col("event").isin(*M.TICKETS)).count()
    assert results / 20 < M.stale(log).count() < results / 2


def parts_of(log, folder, n=3):
    """A log as n files in order of time."""
    order = log.selectExpr("*", f"ntile({n}) OVER (ORDER BY ts, seq) AS part")
    for i in range(1, n + 1):
        order.where(f"part = {i}").drop("part").coalesce(1).write.mode("append").parquet(folder)


def test_stream_ends_where_the_replay_ends(spark, tmp_path):
    from tidepool.plans.tables import Tables

    log = Tables(spark, "/root/testdata/sf0.001").log.withColumn("ts", F.col("ts").cast("timestamp")).where("key < 12")
    parts_of(log, str(tmp_path / "log"))
    root = str(tmp_path / "summary")
    with J.rocksdb(spark):
        stream = J.event_stream(spark, str(tmp_path / "log"), log.schema)
        kept = []
        query = J.drain(J.stage_states(stream), "states", "update", str(tmp_path / "check"), lambda df, i: kept.extend((i, r) for r in df.collect()))
        assert query.exception() is None
        J.live_summary(J.stage_states(stream), root, str(tmp_path / "check2")).awaitTermination(120)
    last = {r.key: tuple(r)[:6] for _, r in sorted(kept, key=lambda x: x[0])}
    assert last == {r.key: tuple(r) for r in M.replay_log(log).collect()} and {i for i, _ in kept} == {0, 1, 2}
    counts = {}
    for r in last.values():
        counts[r[1]] = counts.get(r[1], 0) + 1
    counts.pop(None, None)  # a key without an upsert has no stage
    assert {r.status: r.n for r in P.current(spark, root).collect()} == counts and P.published_mark(spark, root) == 2


def test_a_new_stream_continues_from_the_published_stages(spark, tmp_path):
    from pyspark.sql.types import StructType

    kind = "key long, status string, attempt long, generation int, version string"
    published = spark.createDataFrame([(1, "processing", 5, 1, "v1"), (2, "complete", None, 2, "v1"), (3, "failed", None, 1, "v1")], kind)
    rows = [(1, 10, "complete", 5, 1, "v1"), (1, 11, "begin", None, None, None), (1, 12, "complete", 11, 1, "v1"), (2, 13, "begin", None, None, None), (3, 14, "retry", None, None, None), (4, 15, "begin", None, None, None)]
    log = spark.createDataFrame(rows, "key long, seq long, event string, attempt long, generation int, version string").selectExpr(
        "key", "timestamp_seconds(seq) AS ts", "seq", "event", "CAST(NULL AS boolean) AS changed", "attempt", "generation", "version"
    )
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    kept = []
    with J.rocksdb(spark):
        stream = J.event_stream(spark, str(tmp_path / "log"), StructType.fromJson(log.schema.jsonValue()))
        J.drain(J.stage_states(stream, published), "s", "update", str(tmp_path / "check"), lambda df, _: kept.extend(df.collect()))
    assert {(r.key, r.before, r.status, r.accepted, r.rejected) for r in kept} == {
        (1, "pending", "complete", 2, 1), (2, "complete", "complete", 0, 1), (3, "failed", "pending", 1, 0), (4, None, None, 0, 1)
    }


def seconds_frame(spark, rows, kind):
    return spark.createDataFrame(rows, kind).withColumn("ts", F.timestamp_seconds("at")).drop("at")


def test_timers_agree_with_the_batch(spark, tmp_path):
    asks = [(1, 100.0), (2, 100.0), (3, 101.0), (4, 102.0), (5, 103.0), (6, 150.0)]
    given = [(1, 110.0), (1, 115.0), (2, 131.0), (3, 131.0), (4, 90.0), (99, 103.0), (6, 151.0)]
    batch = M.timed_out(seconds_frame(spark, asks, "request long, at double"), seconds_frame(spark, given, "request long, at double"))
    assert {r.request for r in batch.collect()} == {2, 4, 5}
    rows = sorted([(r, at, "ask") for r, at in asks] + [(r, at, "answer") for r, at in given], key=lambda x: (x[1], x[2] == "answer"))
    rows += [(1000, 400.0, "ask"), (1001, 401.0, "ask")]  # time goes on
    kept = []
    for i, part in enumerate((rows[:6], rows[6:11], rows[11:14], rows[14:])):
        seconds_frame(spark, part, "request long, at double, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with J.rocksdb(spark):  # restarted from its checkpoint each time
            stream = J.event_stream(spark, str(tmp_path / "in"), seconds_frame(spark, part, "request long, at double, kind string").schema)
            J.drain(M.timeout_stream(stream), "t", "append", str(tmp_path / "check"), lambda df, _: kept.extend(df.collect()))
    got = {(r.request, r.status) for r in kept}
    assert got == {(1, "answered"), (3, "answered"), (6, "answered"), (2, "timedOut"), (4, "timedOut"), (5, "timedOut")} and len(kept) == 6
    assert {r.at_ms for r in kept if r.request == 2} == {130_000}


def test_tokens_survive_older_acknowledgements(spark, tmp_path):
    batches = [
        [("a", 1, "notice"), ("a", 2, "notice"), ("b", 3, "notice"), ("*", 4, "notice"), ("c", 9, "ack")],
        [("a", 1, "ack"), ("b", 3, "ack"), ("b", 5, "notice")],
        [("a", 2, "ack"), ("*", 4, "ack"), ("c", 9, "notice"), ("c", 8, "notice")],
    ]
    kept = []
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(a, s, k, i) for a, s, k in rows], "asset_id string, seq long, kind string, ts long")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with J.rocksdb(spark):
            stream = J.event_stream(spark, str(tmp_path / "in"), df.schema).drop("ts")
            J.drain(M.token_stream(stream), "k", "update", str(tmp_path / "check"), lambda df, _: kept.append({r.asset_id: (r.seq, r.pending) for r in df.collect()}))
    assert [k for k in kept if k] == [{"a": (2, True), "b": (3, True), "*": (4, True)}, {"a": (2, True), "b": (5, True)}, {"a": (2, False), "*": (4, False), "c": (9, False)}]
    every = spark.createDataFrame([r for b in batches for r in b], "asset_id string, seq long, kind string")
    waiting = I.unacknowledged(every.where("kind = 'notice'"), every.where("kind = 'ack'")).collect()
    last = {a: v for k in kept for a, v in k.items()}
    assert {(r.asset_id, r.seq) for r in waiting} == {(a, s) for a, (s, pending) in last.items() if pending} == {("b", 5)}


def test_the_first_answer_of_a_request_wins(spark):
    rows = [(1, 5, 2, "late"), (1, 5, 1, "first"), (1, 9, 0, "later"), (2, 1, 1, None), (2, 1, 2, "second"), (None, 1, 1, "x")]
    df = spark.createDataFrame(rows, "request long, ts long, seq long, answer string").repartition(3)
    got = {r.request: r.answer for r in M.first_answers(df, ["request"], ["ts", "seq"]).collect()}
    assert got == {1: "first", 2: None, None: "x"}


def test_counts_and_distinct_answers_of_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", F.col("event_type").alias("status"), "user_id")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = J.event_stream(spark, str(tmp_path / "in"), events.schema)
    J.drain(J.counts_over_time(stream), "counted", "complete", str(tmp_path / "c1"))
    assert spark.table("counted").agg(F.sum("n")).first()[0] == events.count()
    J.drain(J.distinct_answers(stream, ["user_id", "status"], "3650 days"), "answers", "append", str(tmp_path / "c2"))
    assert spark.table("answers").count() == events.select("user_id", "status").distinct().count()


def test_snapshots_keep_the_published_index(spark, tmp_path):
    root, source = str(tmp_path / "index"), str(tmp_path / "snapshots")
    kind = "asset_id string, width int, height int"
    spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], kind).coalesce(1).write.parquet(source)
    run = lambda: J.keep_index(spark.readStream.schema(kind).parquet(source), root, META, {"ocr": "1"}, str(tmp_path / "check")).awaitTermination(120)
    run()
    assert P.current(spark, f"{root}/stages").count() == 2
    done = P.current(spark, f"{root}/stages").withColumn("status", F.lit("complete"))
    P.publish(done, f"{root}/stages", ("kind", "version"))
    spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 1, 1)], kind).coalesce(1).write.mode("append").parquet(source)
    run()
    assert {r.asset_id: r.status for r in P.current(spark, f"{root}/stages").collect()} == {"a": "complete", "b": "pending", "c": "pending"}


def test_a_slow_snapshot_never_replaces_a_newer_one(spark, tmp_path):
    root, kind = str(tmp_path / "index"), "asset_id string, width int, height int, generation long"
    for i, rows in enumerate(([("a", 1, 1, 2)], [("old", 1, 1, 1)], [("b", 1, 1, 2)], [("a", 2, 1, 3), ("c", 1, 1, 3)])):
        source = str(tmp_path / "in")
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).parquet(source)
        J.keep_index(stream, root, META, {"ocr": "1"}, str(tmp_path / "check"), "generation").awaitTermination(120)
        want = {"a"} if i < 3 else {"a", "c"}
        assert {r.asset_id for r in P.current(spark, f"{root}/assets").collect()} == want
        assert P.published_mark(spark, f"{root}/assets") == (2 if i < 3 else 3)
    assert {r.asset_id for r in P.current(spark, f"{root}/stages").collect()} == {"a", "c"}


def test_publishing_keeps_old_versions_readable(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        P.current(spark, root)
    P.publish(spark.range(3).toDF("x"), root)
    old = P.current(spark, root)
    P.publish(old.where("x > 0"), root)
    assert P.current(spark, root).count() == 2 and old.count() == 3


def test_invalid_assets(spark):
    rows = [(1, "a", 1, 1, 0.0, None), (2, "", 1, 1, None, None), (3, "b", 0, 1, None, None), (4, "c", 1, 1, float("inf"), None), (5, "d", 1, 1, None, None), (6, "d", 1, None, None, None), (7, "é" * 2049, 1, 1, None, None), (8, None, 1, 1, None, None)]
    df = spark.createDataFrame(rows, "row_id int, asset_id string, width int, height int, creation double, modification double")
    got = {(r.row_id, r.rule) for r in I.asset_problems(df).collect()}
    assert got == {(2, "empty_id"), (3, "size"), (4, "date"), (5, "duplicate_id"), (6, "duplicate_id"), (6, "size"), (7, "long_id"), (8, "empty_id")}
