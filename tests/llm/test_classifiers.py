"""Language and toxicity on held-out rows; odd rows get defined results."""

from __future__ import annotations

import math

import numpy as np
import zstandard as zstd
from pyspark.sql import functions as F

from tidepool.llm.language_id import LanguageModel, fit_languages, identify_languages
from tidepool.llm.shared import in_fold
from tidepool.llm.toxicity import FILLER, PADDING, dictionaries, fit_toxicity, score_toxicity

DATA = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = identify_languages(docs, fit_languages(docs.where(~in_fold("doc_id", 4, 2)))).join(docs, "doc_id")
    row = found.where(in_fold("doc_id", 4, 2)).agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert row[0] > 0.95 and row[1] < 0.02


def test_texts_without_letters_are_undetermined(spark):
    model = LanguageModel(("de", "en"), (b"der die das und nicht ein eine", b"the and of to in is that it"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? \n"), (4, "the and of it is that"), (4, "the and of it is that"), (5, "xx")], "doc_id long, text string")
    rows = sorted(identify_languages(odd.withColumn("score", F.lit("clash")), model).collect())
    assert [r.lang_pred for r in rows][:3] == ["und"] * 3 and all(r.rejected and r.score == 0 for r in rows[:3])
    assert rows[3] == rows[4] and rows[3].lang_pred == "en" and not rows[3].rejected
    assert rows[5].lang_pred == "de" and rows[5].rejected  # a tie
    assert identify_languages(odd.limit(0), model).collect() == []
    assert {r.lang_pred for r in identify_languages(odd, fit_languages(odd.limit(0).withColumn("lang", F.lit("x")))).collect()} == {"und"}


def plain_language(model, text):
    """(language, score, rejected) by one-shot compressions of 1 KB pieces."""
    if text is None or not any(c.isalpha() for c in text) or not model.names:
        return "und", 0.0, True
    raw, sizes = text.lower().encode(), []
    for content in model.contents:
        params = zstd.ZstdCompressionParameters(
            strategy=zstd.STRATEGY_LAZY, min_match=4, window_log=19, hash_log=16, chain_log=16, search_log=3,
            target_length=16, write_checksum=False, write_content_size=False, write_dict_id=False,
        )
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        sizes.append(sum(len(zstd.ZstdCompressor(dict_data=d, compression_params=params).compress(raw[i : i + 1024] + bytes(64))) for i in range(0, len(raw), 1024)))
    ranked = sorted((x, n) for n, x in zip(model.names, sizes, strict=True))
    score = 1 / sum(math.exp(max(-700, (ranked[0][0] - x) / 4)) for x in sizes)
    return ranked[0][1], score, len(ranked) > 1 and ranked[1][0] - ranked[0][0] <= 0.002 * ranked[0][0]


def test_languages_are_those_of_plain_compression(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = fit_languages(docs)
    texts = [None, "", "12 !", *[r.text for r in docs.orderBy("doc_id").limit(60).collect()]]
    texts += ["und der die nicht " * 20_000, "ß", texts[5], texts[5]]
    odd = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[6])], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("score", "_c0", "lang_pred")})
    got = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in identify_languages(odd.repartition(3), model).collect()}
    assert len(got) == len(texts) + 1
    for i, t in [*enumerate(texts), (None, texts[6])]:
        want = plain_language(model, t)
        assert got[i][0] == want[0] and got[i][2] == want[2] and abs(got[i][1] - want[1]) < 1e-9


def corpus(spark, n=900):
    rng = np.random.default_rng(1)
    syllables = ["ba", "do", "ke", "lu", "mi", "ra", "so", "ti", "vu", "zen"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows = []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.integers(30, 90))], int(i % 4 == 0)
        if toxic:
            for _ in range(4):
                words.insert(int(rng.integers(len(words))), str(rng.choice(["grufnax", "blaspork", "wurgle"])))
        rows.append((i, " ".join(words), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_of_held_out_documents(spark):
    docs = corpus(spark)
    labels = docs.select("doc_id", "toxic").where(~in_fold("doc_id", 5, 0))
    model = fit_toxicity(docs.drop("toxic"), labels)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "   "), (-3, "   ")], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in score_toxicity(docs.select("doc_id", "text").unionByName(odd), model).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and max(scores[-1], scores[-2], scores[-3]) < 0.5
    held = docs.where(in_fold("doc_id", 5, 0)).collect()
    assert np.mean([(scores[r.doc_id] >= 0.5) == r.toxic for r in held]) > 0.95


def test_without_labels_nothing_is_toxic(spark):
    docs = corpus(spark, 8)
    model = fit_toxicity(docs.drop("toxic"), docs.select("doc_id", "toxic").limit(0))
    assert all(r.score < 0.01 for r in score_toxicity(docs, model).collect())
    assert score_toxicity(docs.limit(0), model).collect() == []


def plain_score(model, text):
    """The score by one-shot compressions of windows that are cut word by word."""
    def size(part, content):
        params = zstd.ZstdCompressionParameters(
            strategy=zstd.STRATEGY_LAZY, min_match=4, window_log=19, hash_log=17, chain_log=17, search_log=5,
            target_length=16, write_checksum=False, write_content_size=False, write_dict_id=False,
        )
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        return len(zstd.ZstdCompressor(dict_data=d, compression_params=params).compress(part + PADDING))

    raw, parts, now = (" " + text.lower()).encode(), [], b""
    for i in range(len(raw)):
        if (len(now) >= 64 and raw[i : i + 1] == b" ") or len(now) == 1024:
            parts.append(now)
            now = b""
        now += raw[i : i + 1]
    saved = sorted((size(p, model.ordinary) - size(p, model.toxic) for p in [*parts, now]), reverse=True)
    x = [saved[0], sum(saved[:3]) / 3, 10 * sum(saved) / len(saved)]
    x += [3 * math.log(1 + sum(g >= least for g in saved)) for least in (2, 4)] + [math.log(len(saved))]
    return 1 / (1 + math.exp(-max(-30, min(30, model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], x, strict=True))))))


def test_scores_are_those_of_plain_compression(spark):
    docs = corpus(spark, 300)
    model = fit_toxicity(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    texts = [None, "", " ", "grufnax", "ba do ke " * 700 + "blaspork wurgle", "x" * 5000, "é ü " * 300, "é ü " * 300, *[r.text for r in docs.limit(40).collect()]]
    odd = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    odd = odd.withColumn("score", F.lit("clash")).withColumn("gains", F.lit(1)).withColumn("_c0", F.lit(2))
    got = {r.doc_id: r.score for r in score_toxicity(odd, model).collect()}
    assert len(got) == len(texts) and got[6] == got[7]
    assert all(abs(got[i] - plain_score(model, t or "")) < 1e-9 for i, t in enumerate(texts))


def test_dictionaries_are_trained_alike():
    toxic, ordinary = ["the grufnax of it"] * 30 + ["plain words"] * 5, ["the lantern of it"] * 30 + ["plain words"] * 5
    a, b = dictionaries(toxic, ordinary)
    c, d = dictionaries(ordinary, toxic)
    assert len(a) == len(b) and b"grufnax" in b and b"grufnax" not in a and b"lantern" in a
    assert b"lantern" in d and b"grufnax" in c
    assert dictionaries([], []) == (b"", b"") and FILLER not in b"the grufnax of it"


def test_recall_by_language(spark):
    """Held-out rows of a small table, whose marks differ by language; Spanish has 31 toxic texts in all."""
    sf = "/root/testdata/sf0.1"
    docs, held = spark.read.parquet(f"{sf}/documents.parquet"), in_fold("doc_id", 5, 0)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = fit_toxicity(docs, labels.where(~held))
    rows = score_toxicity(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id")
    share = {(r.lang, r.toxic): r.p for r in rows.groupBy("lang", "toxic").agg(F.avg((F.col("score") >= 0.5).cast("int")).alias("p")).collect()}
    assert share["en", 1] > 0.85 and share["de", 1] > 0.6 and share["fr", 1] > 0.6
    assert max(p for (_, y), p in share.items() if not y) < 0.03
