"""The stages one after the other, each held against its own input."""

from __future__ import annotations

import random
import re
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from pyspark.sql import functions as F
from test_groups import targets_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    junk = spark.createDataFrame([(900_001, None, "en", "src0", 0), (900_002, "123 ...", "en", None, 7)], docs.schema)
    docs = docs.unionByName(junk)
    counts = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(after.count())
        if name == "language":
            assert after.where("doc_id > 900000").count() == 0 and counts[1] > 0.95 * counts[0]
        if name == "lines":
            texts = [x for (t,) in after.select("text").collect() for x in set(t.split("\n")) if len(x.split()) >= 50]
            assert len(texts) == len(set(texts))
        if name == "near":
            assert after.select("doc_id", "text").distinct().count() == counts[3]
        if name == "mix":
            words = F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
            assert after.agg(words).first()[0] <= 1.5 * docs.agg(words).first()[0] + 1
        if name != "tokens":
            assert after.columns == COLUMNS
        docs = after
    assert docs.where("NOT round_trip").count() == 0 and counts[-1] == counts[-2]


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "round_trip"] and rows.count() > 100


def plain_near(rows):
    """Rows that stay, by all pairs of shingle sets."""
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}

    named = sorted({(i, t) for i, t, *_ in rows if i is not None}, key=lambda x: (x[0], x[1] or ""))
    sets = [shingles(t) for _, t in named]
    least = {i: i for i, _ in named}
    links = [(named[x][0], named[y][0]) for x in range(len(named)) for y in range(x) if sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return [(i, t) for i, t in named if least[i] == i] + [(i, t) for i, t, *_ in rows if i is None]


def odd_documents():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(80), "\n".join(text(9) for _ in range(7))
    rows = [(i, text(rng.randrange(1, 120)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, base + " " + word(), "en", "s0", 1) for i in range(8)] + [(120 + i, f"{text(20)}\n{passage}\n{text(20)}", "en", "s1", 1) for i in range(5)]
    rows += [(None, base, "en", None, None), (None, text(30), None, "s2", 1), (None, None, None, None, None), (200, None, "en", "s1", 0), (201, "", "en", "s1", 0)]
    rows += [(5, text(50), "en", "s0", 1), (7, rows[7][1], "en", rows[7][3], 1), (7, rows[7][1], "en", rows[7][3], 1), (202, text(30_000), "en", None, 1)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_odd_rows_in_every_stage(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    rows = odd_documents()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("_key", "id", "taken", "kept", "size", "removed_lines", "_c0")})
    key = lambda r: (str(r[0]), str(r[1]))
    found = {name: stage(spark, docs, "") for name, stage in corpus_pipeline.STAGES}
    assert all(found[name].columns == COLUMNS for name in ("language", "lines", "near", "mix"))

    named = found["language"].collect()
    assert not any(r.text is None or not re.search("[a-z]", r.text) for r in named) and len({r.lang for r in named}) == 1

    from test_passages import brute

    from tidepool.llm.passages import PassageRule

    cut = brute([(i, t) for i, t, *_ in rows if i not in (5, 7)], PassageRule())
    got = [(r.doc_id, r.text) for r in found["lines"].collect() if r.doc_id not in (5, 7)]
    assert sorted(got, key=str) == sorted(cut, key=str)

    assert sorted(map(key, found["near"].collect())) == sorted(map(key, plain_near(rows)))

    sizes, targets = targets_of([(i, t, s) for i, t, _, s, _ in rows])
    mixed = found["mix"].collect()
    whole = {}
    for i, t, _, s, _ in rows:
        whole.setdefault((i, s), []).append(t or "")
    for r in mixed:
        assert any(t.startswith(r.text) for t in whole[r.doc_id, r.source]) and r.text.split() and r.n_chars == len(r.text)
    for s, target in targets.items():
        took = sum(len(r.text.split()) for r in mixed if r.source == s)
        assert abs(took - target) <= max(1, min(256, target / 128 + 1))
    assert max(Counter((r.doc_id, r.text) for r in mixed if r.doc_id == 7).values()) <= 6  # three equal rows, twice each

    ids = found["tokens"].collect()
    assert len(ids) == len(rows) and all(r.round_trip for r in ids) and all(r.n_tokens == 0 for r in ids if r.doc_id in (200, 201))


def test_empty_tables_in_every_stage(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").collect() == []
