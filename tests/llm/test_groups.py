"""Near duplicates, embeddings, nearest neighbours, components and the mix against brute force."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm.ann import nearest
from tidepool.llm.components import components
from tidepool.llm.embedding_dedup import link_vectors
from tidepool.llm.mixing import mix_sources, mixed_totals
from tidepool.llm.near_dups import near_duplicates
from tidepool.llm.shared import Scratch
from tidepool.llm.vectors import sample_by_length


def reach(ids, links):
    """id -> smallest id reachable."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("most", [500_000, 0])
def test_components_of_chains_stars_and_rings(spark, monkeypatch, most):
    monkeypatch.setattr("tidepool.llm.components.BROADCAST_ROWS", most)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.id: r.component for r in components(df, Scratch(spark, "test"), "c").collect()}
    want = reach({x for e in edges for x in e}, edges)
    assert got == {i: c for i, c in want.items() if i != c}
    assert components(df.limit(0), Scratch(spark, "test"), "d").collect() == []


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_are_those_of_all_pairs(spark, k):
    rng = np.random.default_rng(k)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, base = [], [rng.choice(vocabulary, 120).tolist() for _ in range(6)]
    for i in range(260):
        words = list(base[i % 6])
        for _ in range(int(rng.integers(0, 7))):
            words[int(rng.integers(len(words)))] = str(rng.choice(vocabulary))
        rows.append((i * 3, " ".join(words) if i % 5 else " ".join(words).upper()))
    boiler = " ".join(rng.choice(vocabulary, 40))
    rows += [(5000 + i, boiler + " " + " ".join(rng.choice(vocabulary, 60))) for i in range(60)]
    rows += [(6000, None), (6001, ""), (6002, " \n"), (6003, "one two"), (6004, "One\ttwo"), (6005, "one two three"), (9, rows[3][1]), (6006, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit("clash")).withColumn("key", F.lit(1))
    got = near_duplicates(df.repartition(6), words=k).collect()
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = reach(ids, links)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (want[r.doc_id] == r.doc_id) for r in got)
    assert near_duplicates(df.limit(0)).collect() == []


def test_null_and_repeated_ids_and_long_texts(spark):
    rng = np.random.default_rng(8)
    text = lambda n=60: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    a, b, long_ = text(), text(), text(60_000)
    near_long = long_ + " and a few words more"
    rows = [(None, a), (None, text()), (None, None), (5, a), (3, a), (5, b), (8, b), (9, None), (20, long_), (21, near_long), (22, text(60_000)), (5, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).withColumn("id", F.lit(0))
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(df.repartition(3), words=4).collect())
    want = [("None", "None", True)] * 3 + [("3", "3", True), ("5", "3", False), ("5", "3", False), ("5", "3", False), ("8", "3", False), ("9", "9", True)]
    assert got == sorted(want + [("20", "20", True), ("21", "20", False), ("22", "22", True)])


def test_without_the_screen_by_signatures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(near_duplicates(docs, words=4, slack=None).collect()) == sorted(near_duplicates(docs, words=4).collect())


def vectors(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(30, 16))
    rows = [(i, (centers[i % 30] + rng.normal(size=16) * [0.05, 0.3, 1][i % 3]).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [float("inf")] + [1.0] * 15), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit("clash")).withColumn("id", F.lit(0))
    return df.repartition(5), rows


def sound(rows):
    return [(i, np.array(v, np.float64)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]


def test_vector_links_are_those_of_all_pairs(spark):
    df, rows = vectors(spark)
    fine = sound(rows)
    m = np.array([v for _, v in fine])
    near = (m @ m.T) / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1)) >= 0.9
    np.fill_diagonal(near, False)
    links = [(fine[a][0], fine[b][0]) for a, b in zip(*np.nonzero(near), strict=True)]
    want = reach({i for i, _ in rows}, links)
    for options in ({}, {"per_cell": 50, "block": 16, "sigmas": 100.0}):
        got = link_vectors(df, **options).collect()
        assert len(got) == len(rows)
        assert {r.vec_id: r.component_id for r in got} == want
        many = {fine[i][0]: int(n) for i, n in enumerate(near.sum(1))}
        assert {r.vec_id: r.n_links for r in got} == {i: many.get(i, 0) for i, _ in rows}
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert link_vectors(df.limit(0)).collect() == []


def test_nearest_finds_what_all_pairs_find(spark):
    df, rows = vectors(spark)
    fine = dict(sound(rows))
    ids = np.array(sorted(fine))
    m = np.array([fine[i] for i in ids])
    got = {}
    for r in nearest(df, df.where("vec_id % 20 = 0"), k=5, leaf=40, sample_rows=400).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        score = m @ fine[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:5]
        assert [x[0] for x in got[q]] == [1, 2, 3, 4, 5] and q not in {x[1] for x in got[q]}
        assert all(abs(s - fine[q] @ fine[i]) < 1e-9 for _, i, s in got[q])
        assert [x[2] for x in got[q]] == sorted((x[2] for x in got[q]), reverse=True)
        hits += len({x[1] for x in got[q]} & {int(ids[i]) for i in order})
        total += 5
    assert hits >= 0.9 * total
    exact = nearest(df, df.where("vec_id = 1020"), k=20).collect()  # one leaf; 41 copies, ties to smaller ids
    assert [r.vec_id for r in exact] == [7, *range(1000, 1019)]
    assert nearest(df.limit(0), df.limit(0)).collect() == []
    few = df.where("vec_id < 4")
    assert len(nearest(few, few.where("vec_id = 0")).collect()) == 3


def targets_of(rows):
    sizes = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in {x for *_, x in rows}}
    left, targets = 1.5 * sum(sizes.values()), {}
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    while open_ := [s for s in sizes if s not in targets]:
        level = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if weights[s] * level >= 2 * sizes[s]]
        for s in full or open_:
            targets[s] = min(2 * sizes[s], weights[s] * level)
        left -= sum(targets[s] for s in full)
        if not full:
            break
    return sizes, targets


def queue_of(rows, sizes, targets, packet):
    """Words taken by row, packet by packet from one sorted list."""
    items, passed = [], {}
    shuffled = sorted(range(len(rows)), key=lambda i: (hashlib.md5(("" if rows[i][0] is None else str(rows[i][0])).encode()).hexdigest()[:15], rows[i][0] or 0, len((rows[i][1] or "").split())))
    for i in shuffled:
        source, size = rows[i][2], len((rows[i][1] or "").split())
        start, passed[source] = passed.get(source, 0), passed.get(source, 0) + size
        each = max(1, min(packet, math.ceil(targets[source] / 128)))
        for epoch in range(2):
            for at in range(0, size, each):
                end = min(size, at + each)
                items.append(((start + sizes[source] * epoch + end) / targets[source], source is None, source or "", shuffled.index(i), epoch, end - at, i))
    left, taken = math.floor(sum(targets.values()) + 1e-6), [0] * len(rows)
    for *_, words, i in sorted(items):
        taken[i] += min(words, left)
        left -= min(words, left)
    return taken


def test_the_queue_decides_and_meets_the_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), [None, "a", "b", "c", "d"][min(4, int(rng.integers(9)))]) for i in range(500)]
    rows += [(900, None, "a"), (901, "", "e"), (None, "x y", "a"), (3, rows[3][1], rows[3][2]), (902, "\t", None), (903, "w " * 5000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("row", F.lit(1))
    sizes, targets = targets_of(rows)
    mixed = mix_sources(df.repartition(6))
    got = mixed_totals(mixed).collect()
    want = queue_of(rows, sizes, targets, 256)
    key = lambda i, size, taken: (str(i), size, taken)
    assert sorted(key(r.doc_id, r.size, r.taken) for r in got) == sorted(key(i, len((t or "").split()), n) for (i, t, _), n in zip(rows, want, strict=True))
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    for s in sizes:
        taken = sum(n for (*_, x), n in zip(rows, want, strict=True) if x == s)
        assert abs(taken - targets[s]) <= max(1, min(256, math.ceil(targets[s] / 128)))
    assert sum(want) == math.floor(sum(targets.values()) + 1e-6)
    again = mixed_totals(mix_sources(df.repartition(2))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    for r in mixed.collect():  # a second time only after the first
        assert [t.epoch for t in r.takes] == [1, 2] and (r.takes[1].taken == 0 or r.takes[0].taken == r.size)
    assert mixed_totals(mix_sources(df.limit(0))).collect() == []
    none = mixed_totals(mix_sources(df.where("doc_id in (900, 901, 902)"))).collect()
    assert [r.taken for r in none] == [0, 0, 0]


@pytest.mark.parametrize("most", [500_000, 0])
def test_a_third_of_the_rows_without_id_queue_alike(spark, monkeypatch, most):
    monkeypatch.setattr("tidepool.llm.mixing.BROADCAST_ROWS", most)
    rng = np.random.default_rng(8)
    text = lambda: " ".join(["w"] * int(rng.integers(0, 40)))
    rows = [(None, text(), "a") for _ in range(1200)] + [(7, "x y z", "a")] * 1100
    rows += [(i, text(), ["a", "b", None][i % 3]) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixed_totals(mix_sources(df.repartition(5))).collect()
    want = queue_of(rows, *targets_of(rows), 256)
    key = lambda i, size, taken: (str(i), size, taken)
    assert sorted(key(r.doc_id, r.size, r.taken) for r in got) == sorted(key(i, len(t.split()), n) for (i, t, _), n in zip(rows, want, strict=True))


def test_queries_of_poor_leaves_get_all_their_finds(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0")
    found = nearest(df, asked, k=100, leaf=20, sample_rows=600, recall=0.01).groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("d"), F.max("rank").alias("r"))
    assert {(r.n, r.d, r.r) for r in found.collect()} == {(100, 100, 100)}
    every = nearest(df, asked, k=700, leaf=20, sample_rows=600, recall=0.01).groupBy("query_id").count()
    assert {r["count"] for r in every.collect()} == {599}


def test_one_sample_for_fifty_lengths(spark):
    rng = np.random.default_rng(10)
    rows = [(50 * i + n, rng.normal(size=n).tolist()) for i in range(8) for n in range(1, 51)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    counts, samples = sample_by_length(df, "vec_id", "embedding", 100)
    assert set(counts.values()) == {8} and sum(map(len, samples.values())) < 200
    few, samples = sample_by_length(df, "vec_id", "embedding", 5)
    assert set(few) == set(samples) and any(len(x) == 0 for x in samples.values())
    by = dict(rows)
    for r in nearest(df, df.where("vec_id < 60"), k=7, sample_rows=5).collect():
        q, same = np.array(by[r.query_id]), sorted((-float(np.dot(by[i], by[r.query_id])), i) for i in by if len(by[i]) == len(by[r.query_id]) and i != r.query_id)
        assert abs(same[r.rank - 1][0] + r.score) < 1e-9 * (1 + abs(q @ q))
    linked = link_vectors(df, sample_rows=5).collect()
    assert len(linked) == len(rows)


def test_links_of_mixtures_across_borders(spark):
    rng = np.random.default_rng(17)
    topics = rng.normal(size=(40, 64))
    topics /= np.linalg.norm(topics, axis=1, keepdims=True)
    a, b = topics[rng.integers(40, size=(2, 900))]
    share = rng.random((900, 1))
    near = np.clip(share + rng.uniform(0.1, 0.3, (900, 1)), 0, 1)
    v = np.concatenate([share * a + (1 - share) * b, near * a + (1 - near) * b])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    wanted = (unit @ unit.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in link_vectors(df, per_cell=45).collect()}
    assert got == dict(enumerate(wanted.tolist()))


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(23)
    rows = []
    for dim, n in ((16, 400), (8, 90), (3, 1), (5, 2)):
        centers = rng.normal(size=(12, dim))
        rows += [(len(rows) + i, (centers[i % 12] + 0.2 * rng.normal(size=dim)).tolist()) for i in range(n)]
    rows += [(1000, rows[-1][1]), (1001, None), (None, rows[0][1]), (1002, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dim", F.lit("clash")).withColumn("v", F.lit(0))
    fine = [(i, v) for i, v in sound(rows) if i is not None]
    links = {i: set() for i, _ in rows if i is not None}
    near = {}
    for i, v in fine:
        same = [(j, w) for j, w in fine if j != i and len(w) == len(v)]
        links[i] = {j for j, w in same if v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9}
        near[i] = [j for _, j in sorted((-(v @ w), j) for j, w in same)][:5]
    got = {r.vec_id: r for r in link_vectors(df.repartition(5), per_cell=40, block=32).collect()}
    assert len(got) == len(rows) and {i: got[i].n_links for i in links} == {i: len(x) for i, x in links.items()}
    want = reach(links, [(a, b) for a, x in links.items() for b in x])
    assert {i: got[i].component_id for i in links} == want and got[None].component_id is None and got[None].kept

    found = {}
    for r in nearest(df.repartition(4), df, k=5, leaf=40, sample_rows=300).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    hits = sum(len(set(found.get(i, [])) & set(x)) for i, x in near.items())
    assert hits >= 0.9 * sum(map(len, near.values())) and not {1001, 1002, None} & set(found)
    assert all(len(found[i]) == len(x) for i, x in near.items() if x)


def test_recall_on_structured_vectors(spark):
    """Clusters of different widths, and vectors of low rank: recall by a plain count, deep trees."""
    rng = np.random.default_rng(31)
    topics = rng.normal(size=(50, 32))
    clusters = topics[rng.integers(50, size=3000)] + rng.uniform(0.05, 1, (3000, 1)) * rng.normal(size=(3000, 32))
    flat = rng.normal(size=(1000, 4)) @ rng.normal(size=(4, 32))
    for m in (clusters, flat):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
        found = {}
        for r in nearest(df, df.where("vec_id % 20 = 0"), k=10, leaf=64, sample_rows=1000).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        hits = 0
        for q in range(0, len(m), 20):
            score = m @ m[q]
            score[q] = -np.inf
            hits += len(found[q] & set(np.argsort(-score)[:10].tolist()))
        assert hits >= 0.9 * 10 * len(found)
