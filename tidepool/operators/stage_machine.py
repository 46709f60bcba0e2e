"""The stage state machine: one transition table for the batch replay and the stream.

Whether an event counts depends on all before it, yet a key's log need not be one task: a run
of the log is a finite map from the state it is entered with to the state it is left in.
Runs are mapped in parallel, the few maps of a key are composed in order, and then each run is
replayed from the state that it is really entered with.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.sources.shared import kept

#: States in which an event is accepted, and the state after it.
PLAIN = {
    "begin": (("pending", "failed", "requiresDownload"), "processing"),
    "retry": (("failed", "requiresDownload"), "pending"),
    "retryDownloads": (("requiresDownload",), "pending"),
    "recover": (("processing",), "pending"),
}
#: Events of a ticket, accepted while processing if generation, version and attempt are those in force.
TICKETS = {"complete": "complete", "fail": "failed", "needsDownload": "requiresDownload", "cancel": "pending"}
STATUSES = (None, "pending", "processing", "complete", "requiresDownload", "failed")
#: Stands for the attempt that a run is entered with.
ENTRY = -1
#: Events of a run.
RUN_EVENTS = 10_000


def step(status: str | None, attempt: int | None, event: str, seq: int, ticket: int | None, fresh: bool, reset: bool) -> tuple[str | None, int | None, bool]:
    """(status, attempt, accepted) after an event.

    A begin's seq is the attempt that it starts, ``ticket`` the attempt of a result; ``fresh``
    says that a result has the generation and version in force, ``reset`` that an upsert
    changes one of them.
    """
    if event == "upsert":
        return ("pending", None, True) if status is None or reset else (status, attempt, True)
    if status is None:
        return status, attempt, False
    if event == "remove":
        return None, None, True
    if event in PLAIN:
        allowed, after = PLAIN[event]
        if status not in allowed:
            return status, attempt, False
        return after, seq if event == "begin" else None, True
    if event in TICKETS and status == "processing" and fresh and ticket is not None and ticket == attempt:
        return TICKETS[event], None, True
    return status, attempt, False


@dataclass
class Stage:
    """A stage of the stream: its status (None before its first upsert), generation, version and attempt in force."""

    status: str | None = None
    attempt: int | None = None
    generation: int = 0
    version: str | None = None

    def apply(self, event: str, seq: int = 0, ticket: int | None = None, generation: int | None = None, version: str | None = None, changed: bool = False) -> bool:
        """Takes an event; false if it is rejected."""
        fresh = generation == self.generation and version == self.version
        reset = event == "upsert" and (changed or version != self.version)
        if event == "upsert":
            self.generation, self.version = self.generation + bool(changed), version
        self.status, self.attempt, accepted = step(self.status, self.attempt, event, seq, ticket, fresh, reset)
        return accepted


@dataclass
class RunMap:
    """Where a run leads from every state it can be entered with.

    Entered while processing, what follows depends on the entry attempt: ``tickets`` has the
    exit for each attempt that a result of the run names before anything else decides, and
    ``exits`` the one for all others. Branches that reach one state are simulated once.
    """

    states: dict[tuple[str | None, int | None], set] = field(default_factory=lambda: {(s, ENTRY if s == "processing" else None): {("status", s)} for s in STATUSES})

    def take(self, event: str, seq: int, ticket: int | None, fresh: bool, reset: bool) -> None:
        after: dict[tuple[str | None, int | None], set] = {}
        for (status, attempt), entries in self.states.items():
            if status == "processing" and attempt == ENTRY and event in TICKETS:
                if fresh and ticket is not None and not any(("ticket", ticket) in e for e in self.states.values()):
                    after.setdefault((TICKETS[event], None), set()).add(("ticket", ticket))
                new = (status, attempt)
            else:
                new = step(status, attempt, event, seq, ticket, fresh, reset)[:2]
            after.setdefault(new, set()).update(entries)
        self.states = after

    def exits(self) -> list[tuple[str, str | None, int | None, str | None, int | None]]:
        """(kind, entry status, entry ticket, exit status, exit attempt) of every branch."""
        return [(kind, x if kind == "status" else None, x if kind == "ticket" else None, *state) for state, entries in self.states.items() for kind, x in entries]


def running_counts(events: DataFrame, counted: dict[str, Column], span: str = "1 hour", own: bool = True) -> DataFrame:
    """``events`` (key, ts, seq, ...) with counts of the key's events that meet a condition, up to each event.

    The event itself counts if ``own``. Counts run over spans of time first and then within a
    span, so that a key with a third of all events is many small windows. Events of one time
    go by seq.
    """
    rows = events.withColumn("_span", F.date_trunc(span.split()[1], F.col("ts").cast("timestamp")))
    rows = rows.withColumns({f"_c_{n}": F.coalesce(c, F.lit(False)).cast("long") for n, c in counted.items()})
    spans = rows.groupBy("key", "_span").agg(*[F.sum(f"_c_{n}").alias(f"_s_{n}") for n in counted])
    before = Window.partitionBy("key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("key").alias("_key"), F.col("_span").alias("_at"), *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in counted])
    within = Window.partitionBy("key", "_span").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    rows = rows.select("*", *[F.coalesce(F.sum(f"_c_{n}").over(within), F.lit(0)).alias(f"_w_{n}") for n in counted])
    joined = rows.join(spans, rows["key"].eqNullSafe(spans["_key"]) & (rows["_span"] == spans["_at"]))
    return joined.select(*events.columns, *[(F.col(f"_b_{n}") + F.col(f"_w_{n}")).cast("int").alias(n) for n in counted])


def with_force(log: DataFrame) -> DataFrame:
    """A log (key, ts, seq, event, changed, attempt, generation, version) with what is in force: fresh, reset, generations, nth.

    Upserts are always accepted, so the generation (how many changed it) and version at each
    event follow from them alone, without a replay. ``nth`` counts the key's events.
    """
    upsert = F.col("event") == "upsert"
    rows = running_counts(log, {"generations": upsert & F.coalesce("changed", F.lit(False)), "_upserts": upsert, "nth": F.lit(True)})
    versions = rows.where(upsert).select(F.col("key").alias("_key"), F.col("_upserts").alias("_nth"), F.col("version").alias("_version"))
    now = rows.join(versions, rows["key"].eqNullSafe(versions["_key"]) & (F.col("_upserts") == F.col("_nth")), "left").drop("_key", "_nth")
    earlier = versions.select(F.col("_key"), (F.col("_nth") + 1).alias("_nth"), F.col("_version").alias("_before"))
    now = now.join(earlier, upsert & now["key"].eqNullSafe(earlier["_key"]) & (F.col("_upserts") == F.col("_nth")), "left").drop("_key", "_nth")
    fresh = F.col("generation").eqNullSafe(F.col("generations")) & F.col("version").eqNullSafe(F.col("_version"))
    reset = upsert & (F.coalesce("changed", F.lit(False)) | ~F.col("version").eqNullSafe(F.col("_before")))
    return now.select("key", "ts", "seq", "event", "attempt", fresh.alias("fresh"), reset.alias("reset"), "generations", "nth")


def _value(x) -> int | None:
    return None if pd.isna(x) else int(x)


def _text(x) -> str | None:
    return None if x is None or pd.isna(x) else x


def _replay(log: DataFrame, each: bool) -> DataFrame:
    """A log replayed: every event with ``accepted`` if ``each``, else a row for each run, with its exit and counts.

    A run is RUN_EVENTS of a key's events in order, so most keys are one run, entered with
    nothing, and are replayed at once. Runs of longer keys are mapped in tasks of their own; one
    task composes the maps of a key, a few rows for each of its runs.
    """
    rows = with_force(log).withColumn("_span", F.floor((F.col("nth") - 1) / RUN_EVENTS).cast("long"))
    # Keys go as text: pandas would make floats of a column with nulls. So do attempts.
    rows = kept(rows.select(
        F.col("key").cast("string").alias("key"), "_span", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"), "event",
        F.col("attempt").cast("string").alias("attempt"), "fresh", "reset", "generations",
    ), "log")
    later = rows.where("_span > 0").select(F.col("key").alias("_key")).distinct()  # at most a key for RUN_EVENTS events
    entered = None if later.isEmpty() else _entries(rows.join(F.broadcast(later), rows["key"].eqNullSafe(later["_key"]), "left_semi"))
    both = rows if entered is None else rows.unionByName(entered, allowMissingColumns=True)
    both = both.repartition("key", "_span").sortWithinPartitions("key", "_span", F.col("ts").asc_nulls_first(), F.col("seq").asc_nulls_first())
    names = ["key", "seq", "event", "attempt", "accepted"] if each else ["key", "run", "status", "attempt", "generation", "accepted", "rejected"]

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, status, attempt, generation, counts = None, None, None, 0, [0, 0]
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(names), kinds, strict=True)], names)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()] if each else [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            out = []
            for key, run, event, seq, ticket, fresh, reset, upto in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (key, run):
                    if now and not each:
                        out.append((*now, status, attempt, generation, *counts))
                    now, status, attempt, generation, counts = (key, run), None, None, 0, [0, 0]
                named = None if ticket is None else int(ticket)
                if seq is None:  # the state that this run is entered with
                    status, attempt = event, named
                    continue
                status, attempt, accepted = step(status, attempt, event, seq, named, bool(fresh), bool(reset))
                if each:
                    out.append((key, seq, event, ticket, accepted))
                else:
                    generation = upto
                    counts[0 if accepted else 1] += 1
            yield pack(out)
        if now and not each:
            yield pack([(*now, status, attempt, generation, *counts)])

    schema = "key string, seq long, event string, attempt string, accepted boolean" if each else "key string, run long, status string, attempt long, generation int, accepted long, rejected long"
    return both.select("key", "_span", "event", "seq", "attempt", "fresh", "reset", "generations").mapInArrow(again, schema)


def _entries(rows: DataFrame) -> DataFrame:
    """(key, _span, event, attempt): the status and attempt that each run is entered with, as rows before its events."""
    runs = rows.repartition("key", "_span").sortWithinPartitions("key", "_span", "ts", "seq")

    def events(batch: pd.DataFrame) -> Iterator[tuple]:
        return zip(batch["key"], batch["_span"], batch["event"], batch["seq"], batch["attempt"], batch["fresh"], batch["reset"], strict=True)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "_span", "kind", "status", "ticket", "exit_status", "exit_attempt"]
        now, found, done = None, None, []
        as_text = lambda r: (r[0], r[1], None if r[2] is None else str(r[2]), r[3], None if r[4] is None else str(r[4]))
        for batch in batches:
            for key, at, event, seq, ticket, fresh, reset in events(batch):
                if now != (_text(key), at):
                    done += [(*now, *as_text(r)) for r in found.exits()] if found else []
                    now, found = (_text(key), at), RunMap()
                found.take(event, int(seq), _value(ticket), bool(fresh), bool(reset))
            if done:
                yield pd.DataFrame(done, columns=names)
                done = []
        if found:
            yield pd.DataFrame([(*now, *as_text(r)) for r in found.exits()], columns=names)

    kinds = "key string, _span long, kind string, status string, ticket string, exit_status string, exit_attempt string"
    maps = runs.select("key", "_span", "seq", "event", "attempt", "fresh", "reset").mapInPandas(build, kinds)

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "_span", "event", "attempt"]
        key, at, state, exits = object(), None, (None, None), {}

        def leave() -> tuple[str | None, int | None]:
            status, attempt = state
            out = exits.get(("ticket", attempt)) if status == "processing" else None
            out = out or exits[("status", status)]
            return (out[0], attempt) if out[1] == ENTRY else out

        def row() -> tuple:
            return key, at, state[0], None if state[1] is None else str(state[1])

        for batch in batches:
            done = []
            for k, run, kind, status, ticket, exit_status, exit_attempt in batch.itertuples(index=False):
                k = _text(k)
                if k != key or run != at:
                    if exits:
                        done.append(row())
                        state = leave()
                    if k != key:
                        state = (None, None)
                    key, at, exits = k, run, {}
                exits[(kind, _value(ticket) if kind == "ticket" else _text(status))] = (_text(exit_status), _value(exit_attempt))
            if done:
                yield pd.DataFrame(done, columns=names)
        if exits:
            yield pd.DataFrame([row()], columns=names)

    return maps.repartition("key").sortWithinPartitions("key", "_span").mapInPandas(compose, "key string, _span long, event string, attempt string")


OUTPUT = "key long, status string, attempt long, generation int, accepted long, rejected long"


def replay_log(log: DataFrame) -> DataFrame:
    """Final state per key of a log, with how many of its events were accepted: the batch twin of the stream.

    Rows of the log are (key, ts, seq, event, changed, attempt, generation, version); seq is
    unique within a key. A null key is a key; null flags are false; an unknown event is
    rejected; an empty log has no keys.
    """
    runs = _replay(log, each=False)
    last = F.max_by(F.struct("status", "attempt", "generation"), "run").alias("last")
    found = runs.groupBy("key").agg(last, F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    return found.select(F.col("key").cast(log.schema["key"].dataType).alias("key"), "last.*", "accepted", "rejected")


def stale(log: DataFrame) -> DataFrame:
    """Results (key, seq, attempt) of a log that the machine rejects: not processing, or of another generation, version or attempt."""
    rejected = _replay(log, each=True).where(F.col("event").isin(*TICKETS) & ~F.col("accepted"))
    return rejected.select(*[F.col(c).cast(log.schema[c].dataType).alias(c) for c in ("key", "seq", "attempt")])


def replay(events: Iterable[tuple], stage: Stage | None = None) -> tuple[Stage, int, int]:
    """(stage, accepted, rejected) after events (event, seq, ticket, generation, version, changed) in order."""
    stage, counts = stage or Stage(), [0, 0]
    for event in events:
        counts[0 if stage.apply(*event) else 1] += 1
    return stage, *counts


STREAMED = OUTPUT + ", before string"


def stage_stream(log: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """The same over a stream: a row per key and micro-batch, with the status before it.

    The state of a key is a few numbers, so it stays small however long its log; within a
    micro-batch events are taken in order, across batches as they arrive. A query that
    starts without a checkpoint continues from ``published`` (key, status, attempt,
    generation, version), where interrupted work waits again.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Machine(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.kept = handle.getValueState("stage", "status string, attempt long, generation int, version string, accepted long, rejected long")

        def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
            row = initialState.iloc[0]
            status = _text(row["status"])
            if status == "processing":  # its worker is gone
                status, attempt = "pending", None
            else:
                attempt = _value(row["attempt"])
            self.kept.update((status, attempt, int(row["generation"]), _text(row["version"]), 0, 0))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            old = self.kept.get() if self.kept.exists() else (None, None, 0, None, 0, 0)
            batch = pd.concat(list(rows)).sort_values(["ts", "seq"])
            columns = zip(batch["event"], batch["seq"], batch["attempt"], batch["generation"], batch["version"], batch["changed"], strict=True)
            events = ((e, int(s), _value(a), _value(g), _text(v), c is True or c == True) for e, s, a, g, v, c in columns)  # noqa: E712 - numpy's true
            stage, yes, no = replay(events, Stage(*old[:4]))
            new = (stage.status, stage.attempt, stage.generation, stage.version, old[4] + yes, old[5] + no)
            self.kept.update(new)
            out = [[key[0], new[0], new[1], new[2], new[4], new[5], old[0]]]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STREAMED.split(", ")]).astype({"attempt": "Int64"})

        def close(self) -> None:
            pass

    initial = published.groupBy("key") if published is not None else None
    return log.groupBy("key").transformWithStateInPandas(Machine(), STREAMED, "Update", "None", initial)


def first_answers(answers: DataFrame, request: list[str], order: list[str]) -> DataFrame:
    """The first answer of each request, with its payload; a later one doesn't count, whatever it says."""
    rest = [c for c in answers.columns if c not in request]
    first = answers.groupBy(*request).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select(*request, "r.*")


def timed_out(requests: DataFrame, answers: DataFrame, seconds: float = 30) -> DataFrame:
    """Requests (request, ts) that no answer (request, ts) of their own follows within ``seconds``.

    An answer from before its request doesn't count, nor one of another request. Repeated
    answers are pre-aggregated; a null request is never answered.
    """
    at = lambda c: F.col(c).cast("timestamp").cast("double")
    asked = requests.withColumn("_asked", at("ts"))
    given = answers.select(F.col("request"), at("ts").alias("_given"))
    near = asked.select("request", "_asked").join(given, "request").where((F.col("_given") >= F.col("_asked")) & (F.col("_given") - F.col("_asked") <= seconds))
    return asked.join(near.select("request", "_asked").distinct(), ["request", "_asked"], "left_anti").drop("_asked")


def timeout_stream(events: DataFrame, seconds: float = 30, late: str = "0 seconds") -> DataFrame:
    """(request, status, at_ms) of a stream (request, ts, kind): answered, or timedOut by the request's own timer.

    ``kind`` is ask or answer. An ask sets a timer in event time; its own answer cancels it.
    An answer that comes after the timer, or without an ask, changes nothing, and rows later
    than ``late`` are dropped by the watermark.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    wait = int(seconds * 1000)
    kind = events.schema["request"].dataType.simpleString()
    schema = f"request {kind}, status string, at_ms long"

    class Timer(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.due = handle.getValueState("due", "due_ms long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            due = self.due.get()[0] if self.due.exists() else None
            batch, out = pd.concat(list(rows)), []
            batch = batch.assign(order=(batch["kind"] != "ask").astype(int)).sort_values(["ts", "order"])
            for at, what in zip(batch["ts"], batch["kind"], strict=True):
                ms = int(pd.Timestamp(at).value // 1_000_000)
                if what == "ask" and due is None:
                    due = ms + wait
                    self.handle.registerTimer(due)
                    self.due.update((due,))
                elif what == "answer" and due is not None and ms <= due:
                    self.handle.deleteTimer(due)
                    self.due.clear()
                    out.append((key[0], "answered", ms))
                    due = None
            if out:
                yield pd.DataFrame(out, columns=["request", "status", "at_ms"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.due.clear()
            yield pd.DataFrame([(key[0], "timedOut", expiredTimerInfo.getExpiryTimeInMs())], columns=["request", "status", "at_ms"])

        def close(self) -> None:
            pass

    return events.withWatermark("ts", late).groupBy("request").transformWithStateInPandas(Timer(), schema, "Append", "EventTime")


def token_stream(changes: DataFrame) -> DataFrame:
    """(asset_id, seq, pending) of a stream (asset_id, seq, kind) of notices and acknowledgements, a row per id and micro-batch.

    Notices of an id coalesce to the newest. An acknowledgement clears exactly the notice
    that it names, also one that it overtook, so a newer notice survives an older
    acknowledgement. The id '*' is the token of a full rebuild. ``kind`` is notice or ack.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    kind = changes.schema["asset_id"].dataType.simpleString()

    class Tokens(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.newest = handle.getValueState("newest", "seq long")
            self.done = handle.getMapState("acknowledged", "seq long", "one int")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows))
            newest = self.newest.get()[0] if self.newest.exists() else None
            seen = [int(s) for s in batch.loc[batch["kind"] == "notice", "seq"]]
            newest = max([*seen, *([] if newest is None else [newest])], default=None)
            for s in batch.loc[batch["kind"] == "ack", "seq"]:
                if newest is None or int(s) >= newest:
                    self.done.updateValue((int(s),), (1,))
            if newest is None:
                return
            self.newest.update((newest,))
            for (s,) in [k for k in self.done.keys() if k[0] < newest]:  # no notice can ask for them any more
                self.done.removeKey((s,))
            yield pd.DataFrame([(key[0], newest, not self.done.containsKey((newest,)))], columns=["asset_id", "seq", "pending"])

        def close(self) -> None:
            pass

    return changes.groupBy("asset_id").transformWithStateInPandas(Tokens(), f"asset_id {kind}, seq long, pending boolean", "Update", "None")


def running_summary(changes: DataFrame) -> DataFrame:
    """(status, n) from state changes (before, after): each adds one and takes one."""
    both = changes.select(F.explode(F.array(
        F.struct(F.col("after").alias("status"), F.lit(1).alias("d")), F.struct(F.col("before").alias("status"), F.lit(-1).alias("d"))
    )).alias("x"))
    totals = both.select("x.*").where(F.col("status").isNotNull()).groupBy("status").agg(F.sum("d").alias("n"))
    return totals.where(F.col("n") != 0)
