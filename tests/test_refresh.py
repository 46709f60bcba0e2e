"""Refreshes that encode and save, gates before scores and exports, exact medians, overlaps by cells."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidepool.functions import geometry as G
from tidepool.operators import evaluation as E
from tidepool.operators import index_state as I
from tidepool.operators import labels as L
from tidepool.operators import lines as N
from tidepool.operators import refresh as R
from tidepool.sources import tables as P

META = ["width"]
VERSIONS = {"embedding": "1", "ocr": "1"}


def models():
    """Two models, defined here so that workers get them by value: the length of a text, refusing some, and its capitals."""

    def lengths():
        def model(texts):
            if "large" in texts:
                raise R.SourceError("imageTooLarge")
            return [[float(len(t))] if t != "bad" else 1 / 0 for t in texts]

        return model

    return {"embedding": (lengths, "array<double>"), "ocr": (lambda: lambda texts: [t.upper() for t in texts], "string")}


MODELS = models()
SOURCES = [("a", "local", "one"), ("b", "local", "large"), ("c", "local", "bad"), ("d", "local", None), ("e", "requiresDownload", None), ("f", "unavailable", None), ("h", "local", "three")]


def frames(spark):
    snapshot = spark.createDataFrame([(x, 1) for x in "abcdefgh"], "asset_id string, width int")
    return snapshot, spark.createDataFrame(SOURCES, "asset_id string, availability string, content string"), snapshot.select("asset_id").limit(0)


def states(df, kind="embedding"):
    return {r.asset_id: (r.status, r.failure) for r in df.where(F.col("kind") == kind).collect()}


WANT = {
    "a": ("complete", None), "b": ("failed", "sourceTooLarge"), "c": ("failed", "processingFailed"), "d": ("failed", "invalidSource"),
    "e": ("requiresDownload", None), "f": ("failed", "sourceUnavailable"), "g": ("failed", "sourceUnavailable"), "h": ("complete", None),
}


def test_a_refresh_encodes_and_saves(spark, tmp_path):
    snapshot, sources, none = frames(spark)
    root = str(tmp_path / "index")
    run = lambda snap, mark, **k: R.refresh_index(root, snap, none, META, VERSIONS, sources, MODELS, mark, **k)
    first = run(snapshot, "1")
    assert states(first) == WANT and states(first, "ocr")["b"] == ("complete", None)
    assert {r.asset_id: r.value for r in P.current(spark, f"{root}/embedding").where("status = 'complete'").collect()} == {"a": [3.0], "h": [5.0]}
    assert first.where("attempt IS NOT NULL").isEmpty()
    # Nothing waits: the models see nothing, failures and their codes stay.
    assert states(run(snapshot, "2")) == WANT and P.current(spark, f"{root}/embedding").isEmpty()
    # A changed asset starts over alone, a removed one goes, and downloads are asked for again by policy.
    moved = snapshot.where("asset_id <> 'h'").withColumn("width", F.when(F.col("asset_id") == "a", 2).otherwise(1))
    third = run(moved, "3", retry="downloads")
    assert states(third) == {k: v for k, v in WANT.items() if k != "h"}
    tried = {r.asset_id for r in P.current(spark, f"{root}/embedding").collect()}
    assert tried == {"a", "e"}
    assert {r.asset_id for r in run(moved, "4", retry="all").where("kind = 'embedding'").collect()} == set("abcdefg")
    assert {r.asset_id for r in P.current(spark, f"{root}/embedding").collect()} == set("bcdefg")
    with pytest.raises(ValueError, match="retry policy"):
        run(moved, "5", retry="sometimes")


def test_interrupted_work_is_claimed_again_and_late_results_change_nothing(spark):
    _, sources, _ = frames(spark)
    none = F.lit(None).cast("string")
    stages = spark.createDataFrame([("a", "embedding", "1", "pending"), ("h", "embedding", "1", "complete")], "asset_id string, kind string, version string, status string")
    stages = stages.withColumns({"attempt": none, "failure": none})
    begun = R.claimed(stages, "1")
    late = R.worked(begun, sources, "embedding", *MODELS["embedding"])
    again = R.claimed(I.recovered(begun), "2")
    assert states(R.saved(again, late)) == {"a": ("processing", None), "h": ("complete", None)}  # of an older ticket
    results = R.worked(again, sources, "embedding", *MODELS["embedding"])
    done = R.saved(again, results.unionByName(results))
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, R.saved(done, results).collect())) and states(done)["a"] == ("complete", None)
    empty = R.process_pending(stages.limit(0), sources, MODELS, "3")[0]
    assert empty.collect() == []


def test_pages_have_limits(spark):
    rows = spark.createDataFrame([(1, "pending")], "asset_id long, status string")
    assert I.pending_page(rows, rows, 0, 1000).count() == 1
    for limit in (0, 1001):
        with pytest.raises(ValueError, match="1 to 1000"):
            I.pending_page(rows, rows, 0, limit)


def test_too_few_candidates_are_an_error(spark):
    assert L.exact_sample(spark.range(5), "id", 5, "s").count() == 5
    with pytest.raises(ValueError, match="6 rows are asked for, and 5"):
        L.exact_sample(spark.range(5), "id", 6, "s")


def test_only_a_valid_set_is_exported(spark, tmp_path):
    from test_labels import valid_labels

    labels = valid_labels(spark)
    corpus = labels.select(F.col("group_id").alias("image_id")).distinct()
    out = P.freeze(labels, corpus, str(tmp_path / "good"))
    assert out.count() >= 1
    with pytest.raises(ValueError, match="can't be frozen"):
        P.freeze(labels.withColumn("query_id", F.lit("same")), corpus, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_a_report_of_another_corpus_is_refused(spark):
    run = {"schema_version": 1, "model_id": "m", "corpus_fingerprint": "f", "ranking_limit": 10}
    queries = spark.createDataFrame([("q1", "en"), ("q2", "en")], "query_id string, language string")
    corpus = spark.createDataFrame([("a",), ("b",)], "asset_id string")
    positives = spark.createDataFrame([("q1", "b")], "query_id string, asset_id string")
    cases = spark.createDataFrame([("q1", ["a", "b"], None), ("q2", [], "timeout")], "query_id string, ranked_ids array<string>, error string")
    score = lambda run, cases: E.scored_report(cases, run, queries, corpus, positives, "m", "f").first()
    row = score(run, cases)
    assert (row.queries, row.hits_1, row.hits_5, row.mrr_10, row.failed) == (2, 0, 1, 0.25, 1)
    for wrong in ({"model_id": "x"}, {"corpus_fingerprint": "x"}, {"schema_version": 2}, {"ranking_limit": 10.0}, {"ranking_limit": None}):
        with pytest.raises(ValueError, match=next(iter(wrong))):
            score(run | wrong, cases)
    with pytest.raises(ValueError, match="count"):
        score(run, cases.withColumn("ranked_ids", F.slice("ranked_ids", 1, 1)))


def test_provenance_is_ordered_by_path(spark, tmp_path):
    rows = [("d", str(i), f"p/{9 - i}.jpg", "u", "o", "CC", "l", "0" * 64, i) for i in range(9)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in P.PROVENANCE[:-1]) + ", bytes long").repartition(4)
    P.write_provenance(df.withColumn("other", F.lit(1)), str(tmp_path / "p"))
    text = [line for f in sorted((tmp_path / "p").glob("*.csv")) for line in f.read_text().splitlines()]
    paths = [line.split(",")[2] for line in text if not line.startswith("dataset")]
    assert paths == sorted(paths) and len(paths) == 9 and text[0] == ",".join(P.PROVENANCE)


def test_medians_are_exact(spark):
    import statistics

    rng = random.Random(7)
    groups = {
        "even": [rng.random() for _ in range(500)], "odd": [rng.gauss(0, 1e6) for _ in range(501)], "ties": [rng.choice([1.0, 2.0, 2.0, 9.0]) for _ in range(400)],
        "same": [3.5] * 50, "one": [-1.0], "two": [1.0, 2.0], "far": [0.0] * 100 + [1e-9] * 100 + [1e12],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("even", None), ("none", None)]
    got = {r.name: r.median for r in E.medians(spark.createDataFrame(rows, "name string, v double").repartition(3), "name", "v").collect()}
    assert got == pytest.approx({k: statistics.median(v) for k, v in groups.items()}, rel=1e-12)
    calls = spark.createDataFrame([("a", i, i, float(v), 100.0 + (i == 2)) for i, v in enumerate([50, 1, 3, 2])], "name string, started int, seq int, ms double, memory_mb double")
    row = E.latency_summary(calls).first()
    assert (row.cold_ms, row.warm_calls, row.warm_median, row.warm_min, row.warm_max, row.peak_mb) == (50, 3, 2, 1, 3, 101)
    assert E.latency_summary(calls.where("seq = 0")).first().warm_median is None


def plain_overlaps(boxes):
    out = set()
    for a, ta, sa, ax, ay, aw, ah in boxes:
        for b, tb, sb, bx, by, bw, bh in boxes:
            wide, high = min(ax + aw, bx + bw) - max(ax, bx), min(ay + ah, by + bh) - max(ay, by)
            if a == b and ta < tb and wide > 0 and high > 0 and wide * high / min(aw * ah, bw * bh) >= 0.6 and high / min(ah, bh) >= 0.7:
                out.add((a, ta, sa, tb, sb))
    return out


@pytest.mark.parametrize("sizes", [(16, 256), (4, 20)])
def test_cells_lose_no_overlap(spark, monkeypatch, sizes):
    monkeypatch.setattr(N, "BAND_BOXES", sizes[0])
    monkeypatch.setattr(N, "CUT_ACROSS", sizes[1])
    rng, boxes = random.Random(8), []
    for i in range(300):
        x, y = rng.choice([0.0, 0.25, 0.5, rng.random()]), rng.choice([0.0, 0.5, rng.random(), 1.0])
        w, h = rng.choice([0.02, 0.3, 1.0 - x or 0.1]), rng.choice([0.01, 0.05, 1.0 - y or 0.01])
        boxes.append((i % 2, i % 3, i, x, y, w, h))
        if i % 4 == 0:
            boxes.append((i % 2, (i + 1) % 3, 1000 + i, x + 0.001, y, w, h))
    df = spark.createDataFrame(boxes, "asset_id int, tile int, seq int, x double, y double, w double, h double").repartition(3)
    got = [tuple(r)[:5] for r in N.box_overlaps(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_overlaps(boxes) != set()


def test_lines_of_one_asset_meet_their_neighbours_only(spark):
    lines = [(1, i % 2, i, 0.1, i / 4000, 0.3, 0.0004) for i in range(4000)]
    df = spark.createDataFrame(lines, "asset_id int, tile int, seq int, x double, y double, w double, h double")
    found = N.box_overlaps(df)
    assert found.count() == 0
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "_row" in plan


def test_sizes_that_are_not_decoded(spark):
    rows = spark.createDataFrame([(0, 1), (1, -1), (65_537, 1), (10_000, 10_001), (10_000, 10_000), (None, 1)], "w int, h int")
    assert [r[0] for r in rows.select(G.decode_problem(F.col("w"), F.col("h"))).collect()] == ["invalidImage", "invalidImage", "imageTooLarge", "imageTooLarge", None, "invalidImage"]


def test_parity_over_all_cases(spark):
    parity = spark.createDataFrame([("a", 1.0, True), ("b", 0.9995, True)], "name string, cosine double, passed boolean")
    drift = spark.createDataFrame([(1, 0.005), (2, 0.01)], "text_id int, drift double")
    assert tuple(E.parity_summary(parity, drift).first()) == (2, 0.9995, 0.01, True)
    assert not E.parity_summary(parity, drift.withColumn("drift", F.lit(0.011))).first().passed
    assert not E.parity_summary(parity.withColumn("passed", F.col("name") == "a"), drift).first().passed
    assert tuple(E.parity_summary(parity.limit(0), drift.limit(0)).first()) == (0, None, None, True)
