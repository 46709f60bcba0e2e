"""Work is dealt to all cores and bounded in memory, however the files lie."""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidepool.functions import vectors as V
from tidepool.operators import evaluation as E
from tidepool.operators import lines as N
from tidepool.operators import search as S
from tidepool.operators import stage_machine as M
from tidepool.operators import word_index as W
from tidepool.plans.tables import Tables
from tidepool.sources.shared import spread

SMALL = "/root/testdata/sf0.001"


def in_one_piece(df):
    """All rows in one of eight partitions, as where a file is one row group."""
    return df.repartition(8, F.lit(1))


def largest_share(df):
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(counts) / sum(counts)


def some_vectors(spark, n, dim=6):
    rng = np.random.default_rng(n)
    rows = [(i, f"m{i % 5 // 4}", rng.integers(-3, 4, dim).astype(float).tolist()) for i in range(n)]
    rows += [(n, "m0", None), (n + 1, "m0", [0.0] * dim), (n + 2, "m0", [1.0, None] + [0.0] * (dim - 2)), (n + 3, None, [1.0] * dim), (n + 4, "m1", [float("nan")] * dim)]
    return spark.createDataFrame(rows, "asset_id long, model_id string, embedding array<float>")


@pytest.mark.parametrize("most", [64 << 20, 100])
def test_cosine_pairs_equal_the_columns_and_are_many_tasks(spark, monkeypatch, most):
    monkeypatch.setattr(S, "MOST_BROADCAST_BYTES", most)
    monkeypatch.setattr(S, "PAIRED", 20)
    vectors = some_vectors(spark, 90)
    queries = vectors.where("asset_id % 3 = 0 OR asset_id >= 90").withColumnRenamed("asset_id", "query_id")
    found = S.cosine_scores(queries, in_one_piece(vectors))
    assert most == 100 or largest_share(found) < 0.7
    q = queries.select("query_id", "model_id", V.normalized(F.col("embedding")).alias("q"))
    pairs = vectors.select("asset_id", "model_id", V.normalized(F.col("embedding")).alias("a")).join(q, "model_id")
    want = pairs.select("query_id", "asset_id", V.cosine(F.col("q"), F.col("a")).alias("similarity"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) != []


def test_ids_of_pairs_take_few_bytes_of_a_file(spark, tmp_path):
    dim = F.array(*[F.sin(F.col("id") * k).cast("float") for k in (1, 2, 3)])
    vectors = spark.range(0, 40_000, 1, 4).select(F.col("id").alias("asset_id"), F.lit("m").alias("model_id"), dim.alias("embedding"))
    queries = vectors.where("asset_id % 2000 = 7").withColumnRenamed("asset_id", "query_id")
    S.cosine_scores(queries, vectors).write.parquet(str(tmp_path / "pairs"))
    rows, size = 0, {"query_id": 0, "asset_id": 0, "similarity": 0}
    for path in (tmp_path / "pairs").glob("*.parquet"):
        found = pq.ParquetFile(path).metadata
        rows += found.num_rows
        for group in map(found.row_group, range(found.num_row_groups)):
            for column in map(group.column, range(group.num_columns)):
                size[column.path_in_schema] += column.total_compressed_size
    assert rows == 20 * 40_000
    assert (size["query_id"] + size["asset_id"]) / rows < 0.6  # an id as a number takes 8


def test_more_queries_make_more_tasks_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "TASK_PAIRS", 400)
    vectors = some_vectors(spark, 400)
    for n in (5, 20, 80):
        queries = vectors.where(f"asset_id < {n}").withColumnRenamed("asset_id", "query_id")
        found = S.cosine_scores(queries, vectors)
        counts = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert max(counts) < 4 * 400 and sum(counts) > 100 * n


def test_nearest_search_deals_assets_to_all_cores(spark):
    vectors = some_vectors(spark, 400)
    queries = vectors.where("asset_id < 9").withColumnRenamed("asset_id", "query_id")
    whole = in_one_piece(vectors)
    found = S.nearest_in_partitions(queries, whole, 3)[0]
    assert largest_share(found) < 0.5
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(S.semantic_top_k(queries, whole, 3)) == rows(S.semantic_top_k(queries, vectors, 3))


def test_posting_blocks_deal_texts_to_all_cores(spark, monkeypatch):
    monkeypatch.setattr(W, "CHUNK_TEXTS", 10)
    texts = spark.createDataFrame([(i, f"a b{i % 7} c{i} a" if i % 9 else None) for i in range(300)], "asset_id long, text string")
    blocks = W.posting_blocks(in_one_piece(texts), 0)
    assert largest_share(blocks) < 0.5
    each = blocks.select("term", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("p")).select("term", "p.ids", "p.tfs", "p.lengths")
    assert sorted(map(tuple, each.collect())) == sorted(map(tuple, S.postings(texts).select("term", "asset_id", "tf", "n_tokens").collect()))
    heads = blocks.where("n <> size(ids) OR most_tf <> array_max(tfs) OR least_tokens <> array_min(lengths)")
    assert heads.isEmpty() and blocks.groupBy("term", "bucket").count().where("count > 1").isEmpty()


def test_a_table_that_lies_evenly_is_not_shuffled(spark):
    even = spark.range(0, 400, 1, 4)
    assert spread(even, "id", 100)[0] is even and spread(even, "id", 100)[1:] == (400, 4)


def test_vector_searches_and_statistics_tokenize_no_index(spark, monkeypatch):
    from tidepool.plans import search_queries as Q
    from tidepool.plans import tables

    monkeypatch.setattr(tables, "build_words", None)
    monkeypatch.setattr(tables, "_PUBLISHED", {})
    assert Q.rrf_duplicates(Tables(spark, SMALL)).count() > 0
    assert Q.bm25_corpus_stats(Tables(spark, SMALL)).first().n_docs == Tables(spark, SMALL).documents.count()


def test_lines_merge_without_a_frame_for_each_asset(spark):
    rows = [(None if i // 2 == 7 else i // 2, i % 2, i, f"word{i // 2}", 0.5 + i % 2 / 10, True, 0.1, 0.2, 0.5, 0.1) for i in range(400)]
    kind = "asset_id long, tile int, seq int, text string, confidence double, interior boolean, x double, y double, w double, h double"
    found = N.merge_lines(spark.createDataFrame(rows, kind).repartition(5))
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((-1 if r.asset_id is None else r.asset_id, r.seq, r.place, r.text) for r in found.collect()) == sorted((-1 if k == 7 else k, 2 * k + 1, 0, f"word{k}") for k in range(200))


def test_drift_holds_few_products_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for i in range(50)]
    table = spark.createDataFrame(rows, "id long, v array<double>, w array<double>")
    monkeypatch.setattr(E, "PRODUCTS", 120)
    v, w = (np.array([r[c] for r in rows]) for c in (1, 2))
    want = np.abs(v[:20] @ v.T - w[:20] @ w.T).max(1)
    got = {r.text_id: r.drift for r in E.similarity_drift(table, table.where("id < 20")).collect()}
    assert np.allclose([got[i] for i in range(20)], want, atol=1e-12)


@pytest.mark.parametrize("run", [3, 10_000])
def test_runs_of_events_replay_like_the_log_event_by_event(spark, monkeypatch, run):
    monkeypatch.setattr(M, "RUN_EVENTS", run)
    log = Tables(spark, SMALL).log.cache()
    want, rejected = {}, set()
    for key, group in log.toPandas().sort_values(["ts", "seq"]).groupby("key"):
        stage, counts = M.Stage(), [0, 0]
        for r in group.itertuples():
            value = lambda x: None if x is None or x != x else x
            ok = stage.apply(r.event, r.seq, value(r.attempt), value(r.generation), value(r.version), bool(r.changed))
            counts[0 if ok else 1] += 1
            if not ok and r.event in M.TICKETS:
                rejected.add((key, r.seq))
        want[key] = (stage.status, stage.attempt, stage.generation, *counts)
    mapped = []
    build = M._entries
    monkeypatch.setattr(M, "_entries", lambda rows: mapped.append(1) or build(rows))
    assert {r.key: tuple(r)[1:] for r in M.replay_log(log).collect()} == want != {}
    assert {(r.key, r.seq) for r in M.stale(log).collect()} == rejected != set()
    assert bool(mapped) == (run == 3)  # logs of one run need no maps
