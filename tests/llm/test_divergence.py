"""The source audit against a plain one in integers, and the pointer sort against sorted words."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidepool.llm import divergence
from tidepool.llm.divergence import audit_sources, count_terms, sort_pointers, word_starts

WORDS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=3, most=200):
    docs = [((lang or ""), (source or ""), WORDS.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    n, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in docs:
        groups[lang].add(source)
        n[lang, source].update(words)
        df[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, d in df[lang].items() if d >= least]
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        share = lambda c, t: 1 + 10**9 * (c + 1) // (t + len(kept))  # noqa: E731, B023
        for s in sources:
            pairs = [(sum((share(n[lang, s][t], total[s]) - q) ** 2 // q for t in kept for q in [share(n[lang, o][t], total[o])]), o) for o in sources - {s}]
            own = []
            for t in kept:
                p, q = share(n[lang, s][t], total[s]), share(sum(n[lang, o][t] for o in sources), sum(total.values()))
                if n[lang, s][t] and p > q:
                    own.append(((p - q) ** 2 // q, t))
            for part, items in (("pair", pairs), ("term", own)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1) if part == "pair" or i <= most}
    return out


def test_pointers_sort_like_words():
    rng = np.random.default_rng(0)
    texts = ["abc ABC abcd abcdefgh abcdefghi abcdefgh", "", "x" * 200 + " " + "x" * 200 + " " + "x" * 201, "ä ß äb ab", "abc", "no1no-no_no"]
    texts += [" ".join("".join(rng.choice(list("ab"), rng.integers(1, 90))) for _ in range(40)) for _ in range(5)]
    raw = [t.translate(LOWER).encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    start, length, text = word_starts(data, offsets)
    found = [data[a : a + n].tobytes().decode() for a, n in zip(start, length, strict=True)]
    assert found == [w for t in texts for w in WORDS.findall(t.translate(LOWER))]
    order, begins = sort_pointers(data, start, length)
    words = [found[i].encode() for i in order]
    assert words == sorted(words)
    assert begins.tolist() == [i == 0 or words[i] != words[i - 1] for i in range(len(words))]
    assert all(begins[i] or order[i] > order[i - 1] for i in range(1, len(order)))  # places ascend within a run


def test_audit_is_that_of_plain_integers(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{c}{'é' * (i % 3)}" for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")] + ["long" * 30, "LONG" * 30 + "er"]
    rows = []
    for i in range(300):
        words = rng.choice(vocabulary, rng.integers(0, 30))
        rows.append((" ".join(words), ["en", "de", None][i % 3], f"s{rng.integers(4)}" if i % 5 else None))
    rows += [(None, "en", "silent"), ("", "xx", "a"), ("only once here", "xx", "b"), ("1 2 3 _", "xx", "c")]
    rows += [rows[0]] * 3 + [("Common common COMMON " * 2000, "en", "s1")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit("clash") for c in ("n", "term", "value", "bucket", "v")})
    monkeypatch.setattr(divergence, "STRIP_SOURCES", 2)
    monkeypatch.setattr(divergence, "BUCKET_TERMS", 7)
    got = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in audit_sources(df.repartition(5), most_terms=6).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, most=6)


def test_counts_of_many_shards_add_up(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD_BYTES", 50)
    df = spark.createDataFrame([("a b a", "en", "x"), ("B c", "en", "x"), ("b", "en", "y"), ("d" * 500, "en", "y")], "text string, lang string, source string").coalesce(1)
    got = {(r.source, r.term): (r.n, r.df) for r in count_terms(df).collect()}
    assert got == {("x", "a"): (2, 1), ("x", "b"): (2, 2), ("x", "c"): (1, 1), ("y", "b"): (1, 1), ("y", "d" * 500): (1, 1)}


def test_empty_tables_give_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert audit_sources(empty).collect() == []
