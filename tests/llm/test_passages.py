"""Passage removal against a brute force over every run of lines, without chunks, windows or hashes."""

from __future__ import annotations

import numpy as np

from tidepool.llm.passages import PassageRule, chunk_heads, dedup_passages, fewest_spans, read_lines


def brute(rows, rule):
    """(id, text) -> text: every run of lines that is a passage is looked up in every place before it."""
    places = {}
    texts = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    assert len({i for i, _ in texts}) == len(texts)
    for i, t in texts:
        lines = t.split("\n")
        for a in range(len(lines)):
            words = 0
            for z in range(a + 1, len(lines) + 1):
                words += len(lines[z - 1].split())
                if words >= rule.long_words or (z - a >= 2 and words >= rule.least_words):
                    places.setdefault(tuple(lines[a:z]), []).append((i, a))
    gone = {}
    for body, found in places.items():
        (first, at), *later = sorted(found)
        for i, a in later:
            if i != first or a >= at + len(body):
                gone.setdefault(i, set()).update(range(a, a + len(body)))
    return [
        (i, t if t is None or i is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())))
        for i, t in rows
    ]


def cut(spark, rows, rule=PassageRule()):
    got = dedup_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rule)
    return sorted(((r.doc_id, r.text) for r in got.collect()), key=order)


def order(row):
    return row[0] is None, row[0] or 0, row[1] or ""


def test_every_repeated_passage_goes_but_the_first(spark):
    rng = np.random.default_rng(11)
    rule = PassageRule(least_words=5, long_words=9)
    line = lambda n=7: " ".join(f"w{rng.integers(4)}" for _ in range(rng.integers(0, n)))
    passages = [[line() for _ in range(7)] for _ in range(5)]
    rows = []
    for i in range(80):
        picked = passages[rng.integers(5)]
        a, z = sorted(rng.integers(0, 8, 2))
        rows.append((i, "\n".join([line(12) for _ in range(rng.integers(0, 4))] + picked[a:z] + [line(12) for _ in range(rng.integers(0, 4))])))
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, "a b c\n" * 8), (104, "é " * 9), (105, "é " * 9), (7, rows[7][1]), (None, rows[3][1])]
    assert cut(spark, rows, rule) == sorted(brute(rows, rule), key=order)


def test_short_lines_in_different_surroundings(spark):
    rng = np.random.default_rng(12)
    line = lambda tag, n=5: " ".join(f"{tag}{rng.integers(10**6)}" for _ in range(n))
    passages = [[line(f"p{k}x", 7) for _ in range(8)] for k in range(20)] + [[line(f"q{k}x", 9) for _ in range(2)] for k in range(20)]
    rows, own = [], []
    for i in range(120):
        before, after = [line("a") for _ in range(rng.integers(1, 4))], [line("z") for _ in range(rng.integers(1, 4))]
        rows.append((i, "\n".join([*before, *passages[i % 40], *after])))
        own.append((i, "\n".join([*before, *(passages[i] if i < 40 else []), *after])))
    assert cut(spark, rows) == own


def test_first_copy_in_capitals(spark):
    body = "\n".join(" ".join(f"word{i}x{j}" for j in range(9)) for i in range(7))
    rows = [(1, body.upper()), (2, f"own two\n{body}"), (3, f"own three\n{body}"), (4, body.title()), (5, f"{body}\nown five")]
    assert cut(spark, rows) == [(1, body.upper()), (2, f"own two\n{body}"), (3, "own three"), (4, body.title()), (5, "own five")]


def test_no_rows(spark):
    assert dedup_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_registered_query_and_stage(spark, tmp_path):
    import corpus_pipeline

    from tidepool.llm.queries import op5_line_dedup

    body = "\n".join(f"the line number {i} has few words" for i in range(9))
    rows = [(i, f"own {i}\n{body}\nend {i}", "en", "s", 1) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    wanted = {(0, rows[0][1])} | {(i, f"own {i}\nend {i}") for i in range(1, 4)}
    assert {(r.doc_id, r.text) for r in op5_line_dedup(spark, str(tmp_path)).collect()} == wanted
    assert {(r.doc_id, r.text) for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()} == wanted


def test_colliding_digests_are_found_by_bytes(spark):
    rng = np.random.default_rng(13)
    rule = PassageRule(least_words=2, long_words=9)
    rows = [(i, "\n".join(f"a{rng.integers(30)} b" for _ in range(8))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup_passages(df.repartition(5), rule, digest_bytes=1)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(brute(rows, rule))


def test_columns_of_other_names_stay(spark):
    rows = [(1, "a b c\n" * 9, "x", 3), (2, "a b c\n" * 9, "y", 4), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string, removed_lines int")
    df = df.selectExpr("*", "doc AS id", "doc AS marks", "1 AS head", "named_struct('cut', true) AS c0")
    got = dedup_passages(df, PassageRule(least_words=4, long_words=9))
    assert got.columns == ["doc_id", "text", "doc", "id", "marks", "head", "c0", "removed_lines"]
    assert sorted((r.doc_id, r.doc, r.head, r.c0.cut) for r in got.collect()) == [(1, "x", 1, True), (2, "y", 1, True), (3, None, 1, True)]


def pack(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_chunks_open_alike_whatever_is_around():
    rng = np.random.default_rng(3)
    shared = [" ".join(f"w{rng.integers(50)}" for _ in range(5)) for _ in range(40)]
    texts = ["\n".join(shared), "\n".join(["new", "and more", *shared, "", "the end"])]
    found = [read_lines(*pack([t])) for t in texts]
    inner = [chunk_heads(x, PassageRule()) for x in found]
    assert (inner[0][1:39] == inner[1][3:41]).all() and 0 < inner[0].sum() < 40
    for text in ["", "\n", "a", "a\n", "\na\n\nb"]:
        one = read_lines(*pack([text, text]))
        assert len(one.text) == 2 * (text.count("\n") + 1) and one.words.sum() == 2 * len(text.split())
        assert (chunk_heads(one, PassageRule(long_words=99)) <= (one.words > 0)).all()


def test_fewest_spans_cover_the_same_lines():
    rng = np.random.default_rng(4)
    for _ in range(200):
        spans = sorted(({"at": int(a), "lines": int(n)} for a, n in zip(rng.integers(0, 30, 12), rng.integers(1, 6, 12), strict=True)), key=lambda s: s["at"])
        lines = lambda some: {x for s in some for x in range(s["at"], s["at"] + s["lines"])}
        kept = fewest_spans(spans)
        assert lines(kept) == lines(spans) and sum(s["lines"] for s in kept) <= 2 * len(lines(spans))
