"""Retrieval scores, parity of vectors, latencies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import vectors as V
from tidepool.functions.vectors import broken
from tidepool.operators.counts import with_repeats

RANKED = 10


def first_relevant(ranked: DataFrame, positives: DataFrame) -> DataFrame:
    """(query_id, first_rank) of queries with a known positive (query_id, asset_id) among (query_id, asset_id, rank)."""
    hits = ranked.join(positives.select("query_id", "asset_id").distinct(), ["query_id", "asset_id"], "left_semi")
    return hits.groupBy("query_id").agg(F.min("rank").alias("first_rank"))


def retrieval_scores(queries: DataFrame, ranked: DataFrame, positives: DataFrame) -> DataFrame:
    """Per language: success at 1 and 5, MRR within ten, failed, for (query_id, language, failed).

    ``failed`` is null for a query without a case, which counts as failed; failed queries
    stay in every denominator, as misses.
    """
    queries = queries.withColumn("failed", F.coalesce("failed", F.lit(True)))
    known = queries.join(first_relevant(ranked.where(F.col("rank") <= RANKED), positives), "query_id", "left")
    hit = lambda k: F.coalesce(F.col("first_rank") <= k, F.lit(False)) & ~F.col("failed")
    reciprocal = F.when(hit(RANKED), 1.0 / F.col("first_rank")).otherwise(0.0)
    return known.groupBy("language").agg(
        F.count("*").alias("queries"), F.count_if(hit(1)).alias("hits_1"), F.count_if(hit(5)).alias("hits_5"),
        F.avg(hit(1).cast("double")).alias("success_1"), F.avg(hit(5).cast("double")).alias("success_5"),
        F.avg(reciprocal).alias("mrr_10"), F.count_if(F.col("failed")).alias("failed"),
    )


def ranking_problems(cases: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, rule) of evaluation cases (query_id, ranked_ids array, error).

    A case names a known query once, lists min(10, corpus) distinct known ids unless it
    failed, and an error is not blank.
    """
    size = F.broadcast(corpus.agg(F.least(F.count("*"), F.lit(RANKED)).alias("_want")))  # one row
    named = queries.select("query_id", F.lit(True).alias("_known")).distinct()
    rows = with_repeats(cases, F.col("query_id"), "_same").join(named, "query_id", "left").crossJoin(size)
    failed = F.col("error").isNotNull()
    rules = [
        ("unknown_query", F.col("_known").isNull()),
        ("duplicate_query", F.col("_same") > 1),
        ("duplicate_id", F.size(F.array_distinct("ranked_ids")) != F.size("ranked_ids")),
        ("count", ~failed & (F.size("ranked_ids") != F.col("_want"))),
        ("error", failed & (F.trim("error") == "")),
    ]
    found = rows.select("query_id", F.explode(broken(rules)).alias("rule"))
    ids = cases.select("query_id", F.explode("ranked_ids").alias("asset_id"))
    unknown = ids.join(corpus.select("asset_id"), "asset_id", "left_anti").select("query_id", F.lit("unknown_id").alias("rule"))
    return found.unionByName(unknown.distinct())


def check_provenance(run: dict, model_id: str, fingerprint: str) -> None:
    """Refuses a run of another model, corpus, schema or ranking limit than the one to be scored."""
    want = {"schema_version": 1, "model_id": model_id, "corpus_fingerprint": fingerprint, "ranking_limit": RANKED}
    wrong = [k for k, v in want.items() if run.get(k) != v or type(run.get(k)) is not type(v)]
    if wrong:
        raise ValueError("results have incompatible provenance: " + ", ".join(wrong))


def scored_report(cases: DataFrame, run: dict, queries: DataFrame, corpus: DataFrame, positives: DataFrame, model_id: str, fingerprint: str) -> DataFrame:
    """retrieval_scores of a report (query_id, ranked_ids, error) once its provenance and all its cases hold."""
    check_provenance(run, model_id, fingerprint)
    problems = ranking_problems(cases, queries, corpus).groupBy("rule").agg(F.count("*").alias("n")).orderBy("rule").collect()
    if problems:
        raise ValueError("results break rules: " + ", ".join(f"{r['rule']} ({r['n']})" for r in problems))
    ranked = cases.select("query_id", F.posexplode("ranked_ids").alias("at", "asset_id")).select("query_id", "asset_id", (F.col("at") + 1).alias("rank"))
    asked = queries.select("query_id", "language").join(cases.select("query_id", F.col("error").isNotNull().alias("failed")), "query_id", "left")
    return retrieval_scores(asked, ranked, positives)


def parity_summary(parity: DataFrame, drift: DataFrame, most_drift: float = 0.01) -> DataFrame:
    """One row over all cases: cases, min_cosine, max_drift, and whether every case and the drift pass."""
    whole = parity.agg(F.count("*").alias("cases"), F.min("cosine").alias("min_cosine"), F.bool_and("passed").alias("_passed"))
    moved = drift.agg(F.max("drift").alias("max_drift"))
    passed = F.coalesce(F.col("_passed"), F.lit(True)) & (F.coalesce("max_drift", F.lit(0.0)) <= most_drift)
    return whole.crossJoin(moved).select("cases", "min_cosine", "max_drift", passed.alias("passed"))  # one row each


def vector_parity(actual: DataFrame, reference: DataFrame, least_cosine: float = 0.999) -> DataFrame:
    """(name, mean_error, max_error, cosine, passed) of vectors with equal names."""
    a, r = actual.select("name", F.col("v").alias("a")), reference.select("name", F.col("v").alias("r"))
    both = a.join(r, "name")
    errors = F.zip_with(V.doubles(F.col("a")), V.doubles(F.col("r")), lambda x, y: F.abs(x - y))
    cosine = V.dot(F.col("a"), F.col("r")) / (V.norm(F.col("a")) * V.norm(F.col("r")))
    rows = both.select(
        "name", (F.aggregate(errors, F.lit(0.0), lambda s, x: s + x) / F.size(errors)).alias("mean_error"),
        F.array_max(errors).alias("max_error"), cosine.alias("cosine"),
    )
    return rows.withColumn("passed", F.col("cosine") >= least_cosine)


#: Images, and texts, that meet in one piece of work, and products that it holds at a time.
MEET, PRODUCTS = 4096, 1 << 20


def similarity_drift(images: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_id, drift): largest change of any image-text inner product between two model versions.

    Both tables have (id, v, w), the vectors of the two versions. Blocks of images meet
    blocks of texts in matrix products, and a block gives one row a text, never pairs.
    Vectors of other lengths than the image's meet nothing.
    """
    shaped = lambda x: x.select("id", V.doubles(F.col("v")).alias("v"), V.doubles(F.col("w")).alias("w"), F.size("v").alias("dim")).where(F.size("v") == F.size("w"))
    i, t = shaped(images), shaped(texts)
    blocks = lambda x, n: x.groupBy("dim").agg(F.ceil(F.count("*") / MEET).cast("int").alias(n))
    shape = F.broadcast(blocks(i, "ib").join(blocks(t, "tb"), "dim"))  # a row for each length
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dim = F.col("dim").alias("_dim")
    left = i.join(shape, "dim").select(dim, own("ib").alias("i"), each("tb").alias("j"), "v", "w")
    right = t.join(shape, "dim").select(dim, each("ib").alias("i"), own("tb").alias("j"), "id", "v", "w")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        rows = lambda x, c: x.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(x.num_rows, -1)
        if not a.num_rows or not b.num_rows:
            return pa.table({"text_id": b.column("id").slice(0, 0), "drift": pa.array([], pa.float64())})
        old, new, drift = rows(a, "v").T, rows(a, "w").T, np.empty(b.num_rows)
        text_v, text_w, few = rows(b, "v"), rows(b, "w"), max(1, PRODUCTS // a.num_rows)
        for at in range(0, b.num_rows, few):
            part = slice(at, at + few)
            change = text_v[part] @ old
            change -= text_w[part] @ new
            drift[part] = np.abs(change, out=change).max(1)
        return pa.table({"text_id": b.column("id"), "drift": drift})

    key = ["_dim", "i", "j"]
    kind = texts.schema["id"].dataType.simpleString()
    met = left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(meet, f"text_id {kind}, drift double")
    return met.groupBy("text_id").agg(F.max("drift").alias("drift"))


#: Ranges that a group's values are counted in to find its median.
RANGES = 1024


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median) of each group, exact, the mean of the middle two; null values don't count.

    Values are counted in RANGES ranges between a group's least and greatest, and then one
    by one in the one or two ranges that hold its middle, equal ones pre-aggregated. So no
    task holds a group's values.
    """
    rows = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"))
    ends = rows.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    place = F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)) * RANGES)
    ranged = rows.join(ends, "k").select("k", "v", "n", F.least(F.coalesce(place, F.lit(0)), F.lit(RANGES - 1)).alias("r"))
    counts = ranged.groupBy("k", "r", "n").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("k").orderBy("r"))  # RANGES rows at most
    first, last = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1  # the places of the middle two
    holds = counts.withColumn("before", upto - F.col("c"))
    holds = holds.where((F.col("before") < last) & (F.col("before") + F.col("c") >= first)).select("k", "r", "before")
    values = ranged.join(holds, ["k", "r"]).groupBy("k", "r", "before", "n", "v").agg(F.count("*").alias("c"))
    passed = F.col("before") + F.sum("c").over(Window.partitionBy("k", "r").orderBy("v"))
    values = values.withColumn("to", passed)
    middle = lambda at: F.max(F.when((F.col("to") - F.col("c") < at) & (F.col("to") >= at), F.col("v")))
    found = values.groupBy("k").agg(middle(first).alias("a"), middle(last).alias("b"))
    return found.select(F.col("k").alias(key), (F.col("a") + (F.col("b") - F.col("a")) * 0.5).alias("median"))


def latency_summary(calls: DataFrame) -> DataFrame:
    """Per group of calls (name, started, seq, ms): the first apart, then median and range of the warm ones.

    With a column memory_mb, sampled at each call, peak_mb is its greatest over all calls.
    """
    firsts = calls.groupBy("name").agg(F.min_by(F.struct("seq", "ms"), F.struct("started", "seq")).alias("f"))
    rows = calls.join(firsts.select("name", F.col("f.seq").alias("_cold"), F.col("f.ms").alias("cold_ms")), "name")
    rows = rows.withColumn("_warm", F.when(F.col("seq") != F.col("_cold"), F.col("ms")))
    peak = [F.max("memory_mb").alias("peak_mb")] if "memory_mb" in calls.columns else []
    found = rows.groupBy("name").agg(F.first("cold_ms").alias("cold_ms"), F.count("_warm").alias("warm_calls"), F.min("_warm").alias("warm_min"), F.max("_warm").alias("warm_max"), *peak)
    middle = medians(rows, "name", "_warm").withColumnRenamed("median", "warm_median")
    return found.join(middle, "name", "left")


def best_language(hypotheses: DataFrame, least: float = 0.8, margin: float = 0.2) -> DataFrame:
    """(text_id, language): the leading hypothesis (text_id, language, confidence) if it is clear, else null."""
    valid = hypotheses.where(~F.isnan("confidence") & F.col("confidence").between(0, 1))
    top = F.slice(F.sort_array(F.collect_list(F.struct("confidence", "language")), asc=False), 1, 2)
    rows = valid.groupBy("text_id").agg(top.alias("t"))
    second = F.coalesce(F.get("t", F.lit(1))["confidence"], F.lit(0.0))
    clear = (F.col("t")[0]["confidence"] >= least) & (F.col("t")[0]["confidence"] - second >= margin)
    return rows.select("text_id", F.when(clear, F.col("t")[0]["language"]).alias("language"))
