"""Retrieval against SQLite's full-text engine, a full sort, and exact fusion scores."""

from __future__ import annotations

import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.functions import vectors as V
from tidepool.operators import search as S
from tidepool.operators import word_index as W
from tidepool.sources import word_segments as G
from tidepool.sources.word_segments import build_words


def texts(spark, rows):
    return spark.createDataFrame(rows, "asset_id string, text string")


def asked(spark, *words):
    return spark.createDataFrame(list(enumerate(words)), "query_id long, text string")


@pytest.mark.parametrize("query", ["кот", "the and", "café the", "x_y", "the the and", "ёлка"])
def test_bm25_is_that_of_sqlite(spark, query):
    rng = np.random.default_rng(1)
    words = ["the", "and", "кот", "собака", "café", "cafe", "ёлка", "елка", "x", "y", "ship", "CAT"]
    rows = [(f"a{i:03}", " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(120)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, body, tokenize = 'unicode61')")
    db.executemany("INSERT INTO t VALUES (?, ?)", rows)
    literal = " ".join(f'"{w}"' for w in query.replace("_", " ").split())
    want = dict(db.execute("SELECT id, bm25(t) FROM t WHERE t MATCH ?", (literal,)).fetchall())
    got = {r.asset_id: r.score for r in S.bm25_scores(asked(spark, query), texts(spark, rows)).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want)


def search(queries, index, k=100, searchable=None):
    return W.bounded_top_k(queries, index.blocks, index.frequencies, index.statistics, index.tombstones, searchable, k)[0]


def test_operators_are_plain_words(spark, tmp_path):
    index = build_words(texts(spark, [("a", "кот OR собака"), ("b", "кот собака"), ("c", "кот")]), str(tmp_path))
    found = W.all_matches(asked(spark, '"кот" OR (собака*)', "кот NOT"), index.blocks, index.frequencies, index.statistics, index.tombstones).collect()
    assert {(r.query_id, r.asset_id) for r in found} == {(0, "a")}


def test_statistics_cover_texts_of_other_versions(spark):
    rows = texts(spark, [("a", "dog cat"), ("b", "dog"), ("c", "fish")])
    some = rows.where("asset_id = 'a'").select("asset_id")
    whole = {r.asset_id: r.score for r in S.bm25_scores(asked(spark, "dog"), rows).collect()}
    part = {r.asset_id: r.score for r in S.bm25_scores(asked(spark, "dog"), rows, some).collect()}
    assert part == {"a": whole["a"]}


def test_a_published_index_scores_alike(spark, tmp_path):
    from tidepool.plans.tables import Tables
    from tidepool.sources.tables import current, publish_index

    t, root = Tables(spark, "/root/testdata/sf0.001"), str(tmp_path)
    index, words = publish_index(t.assets, t.stages, t.texts, t.vectors, root), build_words(t.texts, f"{root}/words")
    known = W.all_matches(t.text_queries, words.blocks, words.frequencies, words.statistics, words.tombstones)
    rows = lambda df: {(r.query_id, r.asset_id, r.score) for r in df.collect()}
    assert rows(known) == rows(S.bm25_scores(t.text_queries, t.texts)) != set()
    assert current(spark, f"{root}/stages").where("kind = 'ocr'").count() == t.documents.count()
    assert words.statistics.first() == S.corpus_statistics(t.texts).first()
    plan = index.vectors.where("version = 'clip-1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(version" in plan
    empty = build_words(t.texts.limit(0), f"{root}/none")
    assert search(t.text_queries, empty).collect() == []


def zipf_texts(spark, n, seed):
    """Texts of very different lengths over words of very different frequency."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    share = 1 / np.arange(1, 61)
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 4) ** 4), p=share / share.sum()))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, "")], "asset_id long, text string")


@pytest.mark.parametrize("k", [1, 5, 40])
def test_skipped_blocks_change_no_result(spark, tmp_path, monkeypatch, k):
    monkeypatch.setattr(W, "BUCKET_TEXTS", 8)
    rows = zipf_texts(spark, 900, k).repartition(3)
    index = build_words(rows, str(tmp_path))
    queries = asked(spark, "w0 w1", "w0", "w3 w3 w9", "w40 w0 w2", "w59", "nowhere w0", "w1 w2 w3 w4 w5 w6", "!?", "w7 " * 40)
    some = rows.where("asset_id % 5 > 0").select("asset_id")
    every = S.bm25_scores(queries, rows, some)
    want = {(r.query_id, r["rank"]): (r.asset_id, r.score) for r in S.top_k(every, k, "score", ascending=True).collect()}
    found, read = W.bounded_top_k(queries, index.blocks, index.frequencies, index.statistics, index.tombstones, some, k)
    assert {(r.query_id, r["rank"]): (r.asset_id, r.score) for r in found.collect()} == want != {}
    terms = W.weighted_terms(queries, index.frequencies, index.statistics)
    work = {r.query_id: (r.postings, r.postings_read) for r in W.work_report(read, terms, index.blocks).collect()}
    assert all(used <= every for every, used in work.values()) and set(work) == {0, 1, 2, 3, 4, 6}
    if k == 1:
        assert sum(w[1] for w in work.values()) < 0.85 * sum(w[0] for w in work.values())  # a quarter is not read even of these few
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_segments_of_changes_equal_a_full_build(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BUCKET_TEXTS", 8)
    tokenized = []
    blocks = G.posting_blocks
    monkeypatch.setattr(G, "posting_blocks", lambda rows, segment: tokenized.append(rows.count()) or blocks(rows, segment))
    queries = asked(spark, "w0 w1", "w3", "w40 w0", "fresh w0", "w9 w9 w2")
    rows = {r.asset_id: r.text for r in zipf_texts(spark, 400, 3).collect()}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "asset_id long, text string")
    stored, root = frame(rows), str(tmp_path / "words")
    G.build_words(stored, root)
    for step in range(3):
        now = {i: (f"{t} fresh w{step}" if i % 17 == step else t) for i, t in rows.items() if i % 23 != step}
        now |= {1000 * (step + 1): "w0 w1 fresh", 7: None}
        diff = [(i, "removed" if i not in now else "added" if i not in rows else "changed" if now[i] != rows[i] else "unchanged") for i in {*rows, *now}]
        after = frame(now)
        index = G.update_words(stored, after, spark.createDataFrame(diff, "asset_id long, change string"), root)
        assert tokenized[-1] == sum(c in ("added", "changed") for _, c in diff) and index.segments == tuple(range(step + 2))
        whole = G.build_words(after, str(tmp_path / f"whole{step}"))
        assert sorted(map(tuple, index.frequencies.collect())) == sorted(map(tuple, whole.frequencies.collect()))
        assert index.statistics.first() == whole.statistics.first()
        key = lambda df: sorted(map(tuple, df.select("query_id", "rank", "asset_id", "score").collect()))
        assert key(search(queries, index, 30)) == key(search(queries, whole, 30)) == key(S.top_k(S.bm25_scores(queries, after), 30, "score", ascending=True))
        rows, stored = now, after
    same = spark.createDataFrame([(i, "unchanged") for i in rows], "asset_id long, change string")
    assert G.update_words(stored, stored, same, root).segments == (0, 1, 2, 3)  # nothing changed, nothing written
    merged = G.update_words(stored, stored, same, root, most=4)
    assert merged.segments == (4,) and merged.tombstones.isEmpty() and key(search(queries, merged, 30)) == key(search(queries, whole, 30))


def unit(*v):
    return [x / math.sqrt(sum(y * y for y in v)) for x in v]


def library_index(spark, root):
    """Five assets: words in one or many, stale vectors and texts, and one that only the visual channel knows."""
    from tidepool.sources.tables import publish_index

    names = ["concentrated", "diluted", "wrong-visual", "wrong-ocr", "visual-only"]
    body = {"concentrated": "red ship", "diluted": "red ship " + "and other things " * 9, "wrong-visual": "red ship", "wrong-ocr": "red ship", "visual-only": "harbour"}
    assets = spark.createDataFrame([(n, 640, 480) for n in names], "asset_id string, width int, height int")
    stages = [(n, "embedding", "old" if n == "wrong-visual" else "clip-1", "complete") for n in names]
    stages += [(n, "ocr", "old" if n == "wrong-ocr" else "ocr-1", "failed" if n == "visual-only" else "complete") for n in names]
    vectors = [(n, "clip", unit(1.0, 0.2 * i)) for i, n in enumerate(["visual-only", "wrong-visual", "diluted", "wrong-ocr", "concentrated"])]
    return publish_index(
        assets, spark.createDataFrame(stages, "asset_id string, kind string, version string, status string"),
        spark.createDataFrame(list(body.items()), "asset_id string, text string"),
        spark.createDataFrame(vectors, "asset_id string, model_id string, embedding array<float>"), root,
    )


def test_each_channel_sees_complete_stages_of_its_own_version(spark, tmp_path):
    from tidepool.operators.index_state import searchable

    index = library_index(spark, str(tmp_path))
    texts_ok, vectors_ok = searchable(index.stages, "ocr", "ocr-1"), index.vectors.where("version = 'clip-1'")
    q = asked(spark, "red ship", "!?", "red " * 40)
    hits = search(q, build_words(index.texts, str(tmp_path / "words")), 100, texts_ok)
    found = S.search_text(hits, index.assets).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.asset_id, r.fused, r.width) for r in found] == [
        (0, "concentrated", 1 / 61, 640), (0, "wrong-visual", 1 / 62, 640), (0, "diluted", 1 / 63, 640)
    ]
    wanted = spark.createDataFrame([(i, "clip", unit(1.0, 0.0)) for i in range(3)], "query_id long, model_id string, embedding array<float>")
    both = S.search_combined(wanted, vectors_ok, hits)
    rows = S.with_records(both, index.assets, index.texts).orderBy("query_id", "rank").collect()
    names = [(r.asset_id, r.visual_rank, r.text_rank, r.text is not None) for r in rows if r.query_id == 0]
    assert names[:2] == [("concentrated", 4, 1, True), ("diluted", 2, 3, True)]
    assert {n for n, *_ in names} == {"concentrated", "diluted", "wrong-visual", "wrong-ocr", "visual-only"}
    assert next(x for x in names if x[0] == "wrong-visual")[1] is None and next(x for x in names if x[0] == "wrong-ocr")[2:] == (None, False)
    # Punctuation and too long a text search visually alone.
    assert [r.asset_id for r in rows if r.query_id == 1] == [r.asset_id for r in rows if r.query_id == 2] == ["visual-only", "diluted", "wrong-ocr", "concentrated"]


def ranked(spark, *rows):
    return spark.createDataFrame(rows, "query_id long, asset_id string, rank int")


def test_fusion_scores(spark):
    visual, words = ranked(spark, (1, "v", 1), (1, "both", 2)), ranked(spark, (1, "t", 1), (1, "both", 2))
    got = [(r.asset_id, r.fused, r.rank) for r in S.fuse(visual, words).orderBy("rank").collect()]
    assert got == [("both", 2 / 62, 1), ("t", 1 / 61, 2), ("v", 1 / 61, 3)]


def test_duplicates_keep_the_first_rank_and_ranks_stay(spark):
    visual = ranked(spark, (1, "both", 1), (1, "both", 2), (1, "visual", 3))
    words = ranked(spark, (1, "both", 1), (1, "both", 2))
    assert {r.asset_id: r.fused for r in S.fuse(visual, words).collect()} == {"both": 2 / 61, "visual": 1 / 63}


def test_either_channel_may_be_missing(spark):
    none, some = ranked(spark).limit(0), ranked(spark, (1, "a", 1))
    assert [r.asset_id for r in S.fuse(none, some).collect()] == [r.asset_id for r in S.fuse(some, none).collect()] == ["a"]
    assert S.fuse(none, none).collect() == []


@pytest.mark.parametrize("k", [1, 2, 7, 50, 257, 300])
def test_top_k_is_the_head_of_a_full_sort(spark, k):
    rng = np.random.default_rng(k)
    rows = [(f"p{i:03}", "m", rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(257)]
    rows = [r for r in rows if any(r[2])]
    vectors = spark.createDataFrame(rows, "asset_id string, model_id string, embedding array<float>").repartition(5)
    queries = vectors.limit(3).select(F.col("asset_id").alias("query_id"), "model_id", "embedding")
    got = {(r.query_id, r["rank"]): r.asset_id for r in S.semantic_top_k(queries, vectors, k).collect()}
    full = S.top_k(S.cosine_scores(queries, vectors), 1000, "similarity").where(F.col("rank") <= k).collect()
    assert got == {(r.query_id, r["rank"]): r.asset_id for r in full}


def test_many_queries_meet_assets_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"p{i:03}", f"m{i % 3 // 2}", rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(157)]
    rows = [r for r in rows if any(r[2])]
    vectors = spark.createDataFrame(rows, "asset_id string, model_id string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame(rows[:70], "query_id string, model_id string, embedding array<float>")
    key = lambda df: sorted(map(tuple, df.select("query_id", "asset_id", "similarity", "rank").collect()))
    want = key(S.top_k(S.cosine_scores(queries, vectors), 7, "similarity"))
    monkeypatch.setattr(S, "MOST_BROADCAST_BYTES", 5 * 8 * 8)
    monkeypatch.setattr(S, "MEET", 20)
    monkeypatch.setattr(S, "cosine_scores", None)  # no join of all pairs
    assert key(S.semantic_top_k(queries, vectors, 7)) == want


def test_a_partition_returns_k_of_a_query_whatever_its_batches(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"m{i % 2}", rng.normal(size=4 + 2 * (i % 3 // 2)).tolist()) for i in range(600)]
    vectors = spark.createDataFrame(rows, "asset_id long, model_id string, embedding array<float>").repartition(2)
    queries = spark.createDataFrame(rows[:12], "query_id long, model_id string, embedding array<float>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        counts = [r["count"] for r in S.nearest_in_partitions(queries, vectors, 3)[0].groupBy(F.spark_partition_id(), "query_id").count().collect()]
        assert len(counts) == 24 and max(counts) == 3
        got = sorted(map(tuple, S.semantic_top_k(queries, vectors, 3).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(map(tuple, S.semantic_top_k(queries, vectors, 3).collect()))


def test_a_missing_record_is_an_error(spark):
    hits, assets = ranked(spark, (1, "a", 1), (1, "b", 2)), spark.createDataFrame([("a", 1)], "asset_id string, width int")
    assert S.with_metadata(hits.where("asset_id = 'a'"), assets).first().width == 1
    with pytest.raises(Exception, match="no record of asset b"):
        S.with_metadata(hits, assets).collect()


@pytest.mark.parametrize("limit", [0, -1, 101, True, 2.0])
def test_limits_are_checked_before_the_search(limit):
    with pytest.raises(ValueError, match="from 1 to 100"):
        S.search_combined(None, None, None, limit)


def test_normalized_vectors(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [float("inf"), 1.0])], "id int, v array<float>")
    got = {r.id: r.u for r in v.select("id", V.normalized(F.col("v")).alias("u")).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] is None and got[3] is None


@pytest.mark.parametrize(
    ("text", "query", "want"),
    [
        ("A ship at sea", "SHIP", [("A ", False), ("ship", True), (" at sea", False)]),
        ("Café  no\n ir", "cafe", [("Café", True), (" no ir", False)]),
        ("shipping", "ship", None),
        ("ёлка", "елка", None),
        ("a" * 30 + " word here", "word", [("… ", False), ("word", True), (" here", False)]),
        ("", "x", None),
    ],
)
def test_excerpts(text, query, want):
    assert S.excerpt(text, {S.fold_word(w) for w in query.split()}, S.fold_word) == want


def test_long_excerpts_end_with_whole_words():
    found = S.excerpt("start " * 20 + "needle " + "tail " * 100, {"needle"}, S.fold_word)
    shown = "".join(t for t, _ in found)
    assert len(shown) <= S.SNIPPET_LENGTH and shown.startswith("… start") and shown.endswith("tail …")


def test_query_status(spark):
    rows = spark.createDataFrame([("ok",), (" \n",), ("a " * 33,), ("x" * 4097,), (None,), ("!!",)], "text string")
    assert [r[0] for r in rows.select(T.query_status(F.col("text"))).collect()] == ["ok", "empty", "too_long", "too_long", "empty", "ok"]


def test_marks_stay_with_their_letter(spark):
    row = spark.createDataFrame([("été x_y Ёж",)], "text string")
    got = row.select(T.terms(F.col("text")).alias("t"), T.tokens(F.col("text")).alias("f")).first()
    assert got.t == ["été", "x", "y", "Ёж"] and got.f == ["ete", "x", "y", "ёж"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("“Fish” &amp; chips", '"fish" & chips'), ("<b>&lt;x</b>", "<b><x</b>"), ("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("ﬁne\x1b[31m red\x00", "fine red"), ("a\r\nb c", "a b c"), (None, None)],
)
def test_clean_text(raw, clean):
    assert T.clean_description(raw) == clean


def test_mojibake_and_script(spark):
    rows = spark.createDataFrame([("cafÃ©",), ("â€œquote",), ("café",), ("bad �",), ("мир да",), ("mixмир",), ("abc",), ("日本語文",)], "text string")
    got = rows.select(T.mojibake(F.col("text")).alias("m"), T.script(F.col("text")).alias("s")).collect()
    assert [r.m for r in got] == [True, True, False, True, False, False, False, False]
    assert [r.s for r in got][4:] == ["cyrillic", "mixed", "short", "other"]


def test_top_k_is_pruned_before_the_shuffle(spark):
    rows = ranked(spark, (1, "a", 1)).withColumn("similarity", F.lit(0.5))
    plan = S.top_k(rows.drop("rank"), 5, "similarity")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
