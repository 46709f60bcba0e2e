"""Quality of held-out rows, votes against a plain computation, and odd rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidepool.llm import quality
from tidepool.llm.quality import QualityModel, fit_quality, score_quality, term_rows
from tidepool.llm.shared import in_fold

DATA = "/root/testdata/sf0.01"


def rows_of(texts):
    raw = [(t or "").encode() for t in texts]
    return term_rows(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64))


def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    held = in_fold("doc_id", 5, 0)
    scored = score_quality(docs, fit_quality(docs, labels.where(~held))).join(labels.where(held), "doc_id").collect()
    good = [r for r in scored if r.quality == 1]
    low = [r for r in scored if r.quality == 0]
    assert len(good) > 40 and len(low) > 5
    assert np.mean([r.score >= 0.3 for r in good]) > 0.97 and np.mean([r.score < 0.3 for r in low]) > 0.8


def test_terms_are_counted_alike_in_pieces_and_alone(monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["", "a", "ab", "abc", "aa aa aa\naa aa aa\n", *["".join(rng.choice(list("abC1 .!\n"), rng.integers(0, 4000))) for _ in range(6)]]
    whole = rows_of(texts)
    assert np.array_equal(whole, np.concatenate([rows_of([t]) for t in texts]))
    monkeypatch.setattr(quality, "PIECE", 500)
    assert np.allclose(whole, rows_of(texts), atol=1e-6)
    assert not whole[0].any()


def test_votes_are_those_of_all_cosines():
    rng = np.random.default_rng(3)
    axes = rng.normal(size=(quality.WIDTH, 8)).astype(np.float32)
    known = rows_of(["".join(rng.choice(list("abcd "), 60)) for _ in range(40)])
    empty = QualityModel(known.mean(0), axes, np.zeros((0, 8), np.float32), np.zeros(0), 5, 8.0)
    model = QualityModel(empty.middle, axes, empty.place(known), (np.arange(40) % 3 > 0).astype(float), 5, 8.0)
    asked = rows_of(["".join(rng.choice(list("abcd "), 50)) for _ in range(600)])
    for row, score in list(zip(asked, model.scores(asked), strict=True))[::37]:
        point = (row - model.middle) @ axes
        cosine = model.vectors @ (point / np.linalg.norm(point))
        near = np.argsort(-cosine)[:5]
        weight = np.maximum(cosine[near].astype(float), 1e-3) ** 8
        assert abs(score - (weight * model.labels[near]).sum() / weight.sum()) < 1e-4
    assert (empty.scores(asked) == 0.5).all()


def test_odd_rows_and_tables(spark):
    texts = [None, "", "   ", "x", "good words of all kinds " * 30_000, "same text here", "same text here"]
    odd = spark.createDataFrame([*enumerate(texts), (None, "same text here")], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("score", "row", "_c0", "_id")})
    labels = spark.createDataFrame([(3, 0), (3, 0), (5, 1), (6, 1), (None, 1), (4, None), (0, 0)], "doc_id long, quality int")
    model = fit_quality(odd, labels)
    assert len(model.labels) == 4
    got = {r.doc_id: r.score for r in score_quality(odd.repartition(3), model).collect()}
    assert len(got) == 8 and all(0 <= s <= 1 for s in got.values())
    assert got[0] == got[1] and got[5] == got[6] == got[None]
    assert score_quality(odd.limit(0), model).collect() == []
    for none in (labels.limit(0), labels.where("quality = 1")):
        scores = {r.score for r in score_quality(odd, fit_quality(odd, none)).collect()}
        assert scores == ({0.5} if none.isEmpty() else {1.0})
    assert {r.score for r in score_quality(odd, fit_quality(odd.limit(0), labels)).collect()} == {0.5}
