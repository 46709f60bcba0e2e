"""Label rules, samples, sources, scores, lines and geometry."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidepool.functions import geometry as G
from tidepool.operators import encoders
from tidepool.operators import evaluation as E
from tidepool.operators import labels as L
from tidepool.operators import lines as N
from tidepool.sources import manifests as R
from tidepool.sources import tables as P

LABEL = "query_id string, group_id string, split string, language string, kind string, query string, expected array<string>"


def valid_labels(spark):
    groups = [(k, n) for k in L.LABEL_KINDS for n in range(1, 21)]
    t = L.label_template(spark.createDataFrame(groups, "kind string, n int"))
    return t.withColumn("query", F.lit("text")).withColumn("expected", F.array("group_id")).select([c.split()[0] for c in LABEL.split(", ")])


def test_a_template_filled_in_is_valid(spark):
    labels = valid_labels(spark)
    corpus = labels.select(F.col("group_id").alias("image_id")).distinct()
    assert labels.count() == 80 and L.label_report(labels, corpus).collect() == []
    counts = {(r.kind, r.split): r.groups for r in L.label_counts(labels).where("language = 'ru'").collect()}
    assert counts == {(k, s): n for k in L.LABEL_KINDS for s, n in L.LEAST_GROUPS.items()}


def test_every_rule_is_seen(spark):
    rows = [
        ("", "g", "development", "ru", "visual", "x", ["i"]), ("q", "", "development", "en", "visual", "x", ["i"]), ("q", "g", "holdout", "fr", "audio", " ", ["i", "i"]),
        ("r", "g", "test", "en", "text", "x", []), ("s", "h", "holdout", "en", "text", "x", ["unknown"]), ("t", "h", "holdout", "en", "text", None, None),
    ]
    labels = spark.createDataFrame(rows, LABEL)
    got = {(r.rule, r.entity_id) for r in L.label_problems(labels, spark.createDataFrame([("i",)], "image_id string")).collect()}
    assert got == {("blank_query_id", ""), ("duplicate_query_id", "q"), ("missing_group", "q"), ("language", "q"), ("kind", "q"), ("missing_text", "q"), ("expected", "q"), ("split", "r"), ("expected", "r"), ("unknown_expected", "s"), ("missing_text", "t"), ("expected", "t")}
    assert {r.image_id for r in L.leaked(labels).collect()} == {"i"}
    assert {r.rule for r in L.group_problems(labels).where("group_id = 'h'").collect()} == {"pair", "expected"}


def test_consensus_takes_the_first_of_equal_answers(spark):
    rows = [(1, a, i) for i, a in enumerate([" Stop ", "go", "stop", "GO"])] + [(2, "yes", i) for i in range(10)] + [(3, "Main St", i) for i in range(9)] + [(4, "12345", i) for i in range(9)]
    df = spark.createDataFrame(rows, "question_id int, answer string, place int").repartition(3)
    assert {r.question_id: (r.answer, r.votes) for r in L.modal_answers(df).collect()}[1] == ("stop", 2)
    assert {r.question_id: r.answer for r in L.consensus(df).collect()} == {3: "main st"}


def test_samples_and_fingerprints_ignore_the_order(spark):
    df = spark.range(500).withColumn("v", F.col("id") % 7)
    mixed = df.orderBy(F.rand(3)).repartition(9)
    ids = lambda d: sorted(r.id for r in L.seeded_sample(d, "id", 20, "s").collect())
    assert ids(df) == ids(mixed) and len(set(ids(df))) == 20
    mark = lambda d: L.fingerprint(d).first()[0]
    assert mark(df) == mark(mixed) != mark(df.withColumn("v", F.when(F.col("id") == 3, None).otherwise(F.col("v"))))


def test_differences_of_inventories(spark):
    e = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "relative_path string, sha256 string")
    a = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "relative_path string, sha256 string")
    assert {r.relative_path: r.state for r in L.inventory_difference(e, a).collect()} == {"b": "changed", "c": "missing", "d": "unexpected"}
    assert L.table_difference(e, e).collect() == []


def test_image_files_by_content(spark, tmp_path):
    folder = tmp_path / "a+b (c) it's"  # nothing of a folder's name is a pattern
    for name, body in (("a.JPG", b"x"), ("sub/b.png", b"x"), ("sub/c.heic", b"y"), ("note.txt", b"x")):
        (folder / name).parent.mkdir(exist_ok=True, parents=True)
        (folder / name).write_bytes(body)
    rows = L.inventory(R.read_image_files(spark, str(folder))).collect()
    assert {(r.relative_path, r.copies) for r in rows} == {("a.JPG", 2), ("sub/c.heic", 1)}


@pytest.mark.parametrize(("body", "ok"), [("a,b\n1,2\n", True), ("﻿a,b\n1,\"x\ny\"\n", True), ("a,c\n1,2\n", False), ("a,b\n1\n", False), ("a,b\n1,2,3\n", False)])
def test_strict_csv(spark, tmp_path, body, ok):
    (tmp_path / "t.csv").write_text(body, encoding="utf-8")
    rows = R.read_csv(spark, str(tmp_path / "t.csv"), ["a", "b"])
    if ok:
        assert rows.count() == len(rows.collect()) == 1
    else:
        with pytest.raises(Exception):  # noqa: B017 - Spark wraps the parser's error
            rows.collect()


def test_manifests_and_annotations(spark, tmp_path):
    manifest = {"version": 1, "model_id": "m", "source": {"x": "y"}, "images": [{"id": "i", "path": "p", "hash": "h"}], "queries": [{"id": "q", "group_id": "g", "language": "ru", "text": "t", "expected": ["i"]}]}
    (tmp_path / "m.json").write_text(json.dumps(manifest, indent=1))
    images, queries = R.read_manifest(spark, str(tmp_path / "m.json"))
    assert images.first().path == "p" and queries.first().expected == ["i"]
    for body in ('{"version": 1, "version": 2, "images": []}', '{"version": 1, "images": [{"id": "i", "id": "j"}]}', '{"version": 1'):
        (tmp_path / "bad.json").write_text(body)
        with pytest.raises(Exception):  # noqa: B017 - Spark wraps the error
            R.read_manifest(spark, str(tmp_path / "bad.json"))[0].collect()
    coco = {"licenses": [{"id": 1, "name": "BY", "url": "http://x/licenses/by/2.0/"}, {"id": 2, "name": "NC", "url": "http://x/licenses/nc/"}], "images": [{"id": 5, "file_name": "f", "license": 1}, {"id": 6, "file_name": "g", "license": 2}, {"id": 7, "file_name": "h", "license": 1}], "annotations": [{"image_id": 5, "caption": "one"}, {"image_id": 5, "caption": "another"}]}
    (tmp_path / "c.json").write_text(json.dumps(coco))
    licenses, images, captions = R.read_captions(spark, str(tmp_path / "c.json"))
    rows = L.with_captions(L.licensed(images, licenses), captions).collect()
    assert {r.image_id: r.captions for r in rows} == {5: ["one", "another"], 7: []}
    (tmp_path / "q.json").write_text(json.dumps({"data": [{"question_id": 1, "image_id": "x", "question": "?", "answers": ["a", "b"]}]}))
    assert [(r.place, r.answer) for r in R.read_answers(spark, str(tmp_path / "q.json")).collect()] == [(0, "a"), (1, "b")]


def test_split_export_and_report(spark, tmp_path):
    out = P.export_splits(valid_labels(spark), str(tmp_path / "set"))
    assert {r.split: r.rows for r in out.collect()} == {"development": 56, "holdout": 24}
    cases = spark.createDataFrame([("q", ["a"], None)], "query_id string, ranked_ids array<string>, error string")
    P.write_report(cases, {"model": "m"}, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().run.model == "m"


def test_questions_are_the_first_of_their_image_and_a_seeded_sample(spark):
    questions = [(f"q{i:02}", f"img{i // 3}") for i in range(60)]
    given = [(q, " Red Bus " if n < 8 + (i % 3 > 0) else "other", n) for i, (q, _) in enumerate(questions) for n in range(10) if not (i % 3 == 0 and i % 2 and n < 4)]
    q = spark.createDataFrame(questions, "question_id string, image_id string")
    a = spark.createDataFrame(given, "question_id string, answer string, place int").repartition(3)
    rows = L.sampled_questions(q, a, 7, "s").collect()
    assert rows == L.sampled_questions(q.orderBy(F.desc("question_id")), a, 7, "s").collect() and len({r.image_id for r in rows}) == 7
    every = {r.image_id: r.question_id for r in L.sampled_questions(q, a, 100, "s").collect()}
    # Odd images' first question lacks the votes, so their second one stands for them.
    assert every == {f"img{k}": f"q{3 * k + k % 2:02}" for k in range(20)} and all(r.answer == "red bus" for r in rows)


def test_missing_and_failed_cases_stay_in_the_denominator(spark):
    queries = [("r1", "ru", False), ("r2", "ru", None), ("e1", "en", False), ("e2", "en", True)]
    ranked = [(q, "x", 1) for q, *_ in queries]
    rows = E.retrieval_scores(
        spark.createDataFrame(queries, "query_id string, language string, failed boolean"),
        spark.createDataFrame(ranked, "query_id string, asset_id string, rank int"),
        spark.createDataFrame([(q, "x") for q, *_ in queries], "query_id string, asset_id string"),
    ).collect()
    assert {r.language: (r.queries, r.hits_1, r.success_1, r.mrr_10, r.failed) for r in rows} == {"ru": (2, 1, 0.5, 0.5, 1), "en": (2, 1, 0.5, 0.5, 1)}


def test_drift_in_blocks_is_that_of_all_pairs(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(E, "MEET", 7)
    rng = np.random.default_rng(2)
    v, w = rng.normal(size=(2, 40, 5))
    rows = spark.createDataFrame([(i, v[i].tolist(), w[i].tolist()) for i in range(40)] + [(90, None, None), (91, [1.0], [1.0])], "id long, v array<double>, w array<double>")
    want = np.abs(v @ v[:9].T - w @ w[:9].T).max(0)
    got = {r.text_id: r.drift for r in E.similarity_drift(rows, rows.where("id < 9")).collect()}
    assert got == pytest.approx(dict(enumerate(want.tolist())))
    assert E.similarity_drift(rows, rows.limit(0)).collect() == []


def test_scores(spark):
    queries = spark.createDataFrame([("r1", "ru", False), ("r2", "ru", False), ("e1", "en", False), ("e2", "en", True)], "query_id string, language string, failed boolean")
    ranked = spark.createDataFrame([("r1", "a", 1), ("r2", "x", 1), ("r2", "b", 2), ("e1", "c", 1), ("e2", "d", 1)] + [("e1", "z", i) for i in range(2, 5)], "query_id string, asset_id string, rank int")
    good = spark.createDataFrame([("r1", "a"), ("r2", "b"), ("e1", "c"), ("e2", "d")], "query_id string, asset_id string")
    got = {r.language: (r.success_1, r.success_5, r.mrr_10, r.failed) for r in E.retrieval_scores(queries, ranked, good).collect()}
    assert got == {"ru": (0.5, 1.0, 0.75, 0), "en": (0.5, 0.5, 0.5, 1)}
    late = spark.createDataFrame([("r1", "a", 12)], "query_id string, asset_id string, rank int")
    assert E.retrieval_scores(queries.limit(1), late, good).first().mrr_10 == 0


def line(tile, seq, text, x=0.1, y=0.4, w=0.5, h=0.1, confidence=0.9, interior=True, asset=1):
    return (asset, tile, seq, text, confidence, interior, x, y, w, h)


def merged(spark, *rows):
    kind = "asset_id long, tile int, seq int, text string, confidence double, interior boolean, x double, y double, w double, h double"
    return [r.text for r in N.merge_lines(spark.createDataFrame(list(rows), kind)).orderBy("place").collect()]


def test_line_merge(spark):
    assert merged(spark, line(0, 0, "Platform 9"), line(1, 0, "Platform 9")) == ["Platform 9"]
    assert merged(spark, line(0, 0, "latform"), line(1, 0, "Platform")) == ["Platform"]
    assert merged(spark, line(0, 0, "one"), line(0, 1, "one")) == ["one", "one"]
    assert merged(spark, line(0, 0, "alpha", interior=False), line(1, 0, "omega")) == ["omega"]
    assert merged(spark, line(0, 0, "alpha", confidence=0.5), line(1, 0, "gamma", confidence=0.8)) == ["gamma"]
    assert merged(spark, line(0, 0, "low", y=0.1), line(1, 0, "high", y=0.8), line(2, 0, "left", x=0.0, y=0.8, w=0.05)) == ["left", "high", "low"]
    assert merged(spark, line(0, 0, "same"), line(1, 0, "same", x=0.7)) == ["same", "same"]


def test_overlaps_need_different_tiles(spark):
    kind = "asset_id long, tile int, seq int, text string, confidence double, interior boolean, x double, y double, w double, h double"
    rows = spark.createDataFrame([line(0, 0, "a"), line(0, 1, "b"), line(1, 0, "c", x=0.15), line(2, 0, "d", y=0.8)], kind)
    assert {(r.tile, r.seq, r.other_tile) for r in N.box_overlaps(rows).collect()} == {(0, 0, 1), (0, 1, 1)}


@pytest.mark.parametrize(("width", "height", "tiles"), [(100, 100, 1), (2048, 2048, 1), (2049, 2048, 2), (4000, 4000, 9), (6000, 10, 4)])
def test_tiles_cover_the_image(spark, width, height, tiles):
    rows = G.tile_plan(spark.createDataFrame([(width, height)], "width int, height int")).orderBy("tile").collect()
    assert len(rows) == tiles and [r.tile for r in rows] == list(range(tiles))
    assert max(r.x + r.tile_width for r in rows) == width and rows[0].y + rows[0].tile_height == height


def test_best_language(spark):
    rows = [(1, "ru", 0.9), (1, "en", 0.6), (2, "ru", 0.9), (2, "en", 0.8), (3, "ru", 0.7), (4, "ru", 0.8), (5, "ru", float("nan")), (5, "en", 0.95)]
    got = {r.text_id: r.language for r in E.best_language(spark.createDataFrame(rows, "text_id int, language string, confidence double")).collect()}
    assert got == {1: "ru", 2: None, 3: None, 4: "ru", 5: "en"}


def test_models_plug_in(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"ok")
    (tmp_path / "b.png").write_bytes(b"bad")

    def reader():
        def read(body):
            if body == b"bad":
                raise ValueError(body)
            return [{"text": body.decode(), "confidence": 1.0}]

        return read

    rows = encoders.recognise(R.read_image_files(spark, str(tmp_path)), reader, "struct<text:string,confidence:double>").collect()
    assert sorted((r.lines[0].text if r.lines else None, r.error) for r in rows if r.lines) == [("ok", None)]
    assert [r.error for r in rows if not r.lines] == ["ValueError"]
    detect = encoders.detector_udf(lambda: lambda t: {"xx": float(len(t))})
    assert spark.createDataFrame([("abc",), (None,)], "t string").select(detect("t").alias("m")).collect()[0].m == {"xx": 3.0}


def test_queries_are_routed_translated_and_encoded(spark):
    said = {"кот спит": {"ru": 0.9, "en": 0.05}, "a cat sleeps": {"en": 0.85, "de": 0.1}, "die Katze": {"de": 0.95}, "кіт спить": {"uk": 0.9}, "ship dock": {"en": 0.85, "de": 0.7}, "lorem ipsum": {"en": 0.7}, "рыба идёт": {"en": 0.95}, "odd odds": {"en": float("nan"), "und": 0.9}}
    cases = [(t, None) for t in said] + [("cat", None), ("cat", "en"), ("кот dog mixed", None), ("кот dog mixed", "ru"), ("日本語の猫", None), (" \n", "en"), ("x" * 4097, "en"), (None, "ru"), ("blank", "ru")]
    queries = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "query_id int, text string, choice string")
    translate = lambda: lambda t: " " if t == "blank" else t.upper()
    got = {r.query_id: r for r in encoders.prepare_queries(queries, lambda: lambda t: said.get(t, {}), translate, encoders.hash_encoder, 16).collect()}
    want = ["ru", "en", "unsupportedLanguage", "unsupportedLanguage", "ambiguousLanguage", "ambiguousLanguage", "ambiguousLanguage", "ambiguousLanguage", "ambiguousLanguage", "en", "ambiguousLanguage", "ru", "unsupportedLanguage", "empty", "tooLong", "empty", "invalidTranslation"]
    assert [got[i].status for i in range(len(cases))] == want
    assert got[0].english_text == "КОТ СПИТ" and got[0].original_text == "кот спит" and got[1].english_text == "a cat sleeps"
    assert {i for i, r in got.items() if r.embedding} == {i for i, r in got.items() if r.english_text} == {0, 1, 9, 11}


def test_manifests_do_not_grow_with_their_source(spark, monkeypatch):
    from tidepool.plans import label_queries as Q
    from tidepool.plans.tables import Tables

    monkeypatch.setattr(Q, "MANIFEST_IMAGES", 20)
    t = Tables(spark, "/root/testdata/sf0.01")
    sizes = [j.count('"hash"') for (j,) in Q.manifests(t.files).select("json").collect()]
    assert sum(sizes) == t.files.count() and max(sizes) <= 60
    got = sorted(map(tuple, Q.manifest_flatten(t).select("source", "relative_path", "sha256").collect()))
    assert got == sorted(map(tuple, t.files.select("source", "relative_path", "sha256").collect()))
