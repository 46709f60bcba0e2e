"""How far each source's words diverge from those of the other sources of its language.

Words are found as pointers into Arrow buffers. Each task sorts the word-start pointers of a
shard of texts by a multikey quicksort, a run of equal words at a time and eight bytes deeper
at each level, so equal runs give a word's occurrences, its documents and its sources without
a hash table of strings. Shards are then merged by Spark's aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.shared import Scratch, join_sized, text_slices

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text whose pointers are sorted together.
SHARD_BYTES = 16 << 20
#: Levels of eight bytes that are sorted as integers; what is still equal and longer is sorted as byte strings.
LEVELS = 8
#: Terms of a language whose pairwise divergences are summed in one task at a time, and sources of a strip of them.
BUCKET_TERMS, STRIP_SOURCES = 16384, 64
SCALE = 10**9

_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of every word in concatenated texts; a word never crosses two texts."""
    if not len(data):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    inside = _IS_TERM[data]
    fresh = np.zeros(len(data) + 1, bool)  # a text begins here
    fresh[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | fresh[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | fresh[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1 - start, np.searchsorted(offsets, start, "right") - 1


def sort_pointers(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word pointers in byte order of their words, words in order of place within a run, and where runs begin."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    ahead = np.ndarray((len(padded) - 7,), ">u8", padded.data, 0, (1,))  # the eight bytes from each place on

    def key(words: np.ndarray, depth: int) -> np.ndarray:
        rest = np.clip(length[words] - depth, 0, 8)
        found = ahead[np.minimum(start[words] + depth, len(padded) - 8)].astype(np.uint64)
        shift = ((8 - np.maximum(rest, 1)) * 8).astype(np.uint64)
        return np.where(rest == 0, np.uint64(0), found >> shift << shift)

    every = key(np.arange(len(start)), 0)
    order = np.argsort(every, kind="stable")
    every = every[order]
    begins = np.ones(len(order), bool)
    begins[1:] = every[1:] != every[:-1]
    for level in range(1, LEVELS + 1):
        run = np.cumsum(begins) - 1
        size = np.diff(np.append(np.flatnonzero(begins), len(order)))
        active = np.flatnonzero((size[run] > 1) & (length[order] >= 8 * level))
        if not len(active):
            break
        words, own = order[active], run[active]
        if level < LEVELS:
            keys = key(words, 8 * level)
        else:  # long and still equal: the rest of the words at once
            rest = [data[start[w] + 8 * level : start[w] + length[w]].tobytes() for w in words]
            place = {r: i for i, r in enumerate(sorted(set(rest)))}
            keys = np.array([place[r] for r in rest], np.uint64)
        by = np.lexsort((keys, own))
        order[active], keys, own = words[by], keys[by], own[by]
        changed = np.ones(len(by), bool)
        changed[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
        begins[active] |= changed
    return order, begins


def shard_counts(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, occurrences, documents) of a shard, from the equal runs of its sorted pointers."""
    data = _LOWER[data]
    start, length, text = word_starts(data, offsets)
    if not len(start):
        return pa.array([], pa.string()), *(np.zeros(0, np.int64) for _ in range(3))
    order, begins = sort_pointers(data, start, length)
    run, row = np.cumsum(begins) - 1, text[order]
    another = begins.copy()  # the first occurrence in its document: places within a run ascend
    another[1:] |= row[1:] != row[:-1]
    width = int(groups.max()) + 1
    cell = run * width + groups[row]
    by = np.argsort(cell, kind="stable")
    cell = cell[by]
    heads = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    n, df = np.diff(np.append(heads, len(cell))), np.add.reduceat(another[by].astype(np.int64), heads)
    own, group = np.divmod(cell[heads], width)
    words = order[np.flatnonzero(begins)]
    sizes = length[words]
    ends = np.cumsum(sizes)
    at = np.repeat(start[words] - np.append(0, ends[:-1]), sizes) + np.arange(ends[-1])
    terms = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(data[at]))
    return terms.take(pa.array(own)), group, n, df


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of each term by language and source.

    A shard is SHARD_BYTES of texts, or one longer text whole. Null texts, languages and
    sources count as ''; each row is a document, repeated rows too. Other columns, whatever
    their names, are not read; no rows give no rows.
    """
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        names = table.select(["lang", "source"])
        keys = names.group_by(["lang", "source"], use_threads=False).aggregate([])
        place = {(k["lang"], k["source"]): i for i, k in enumerate(keys.to_pylist())}
        groups = np.array([place[k] for k in zip(*(c.to_pylist() for c in names.columns), strict=True)], np.int64)
        for row, end, data, offsets in text_slices(table["text"], SHARD_BYTES):
            terms, group, n, df = shard_counts(data, offsets, groups[row:end])
            at = pa.array(group)
            pick = lambda c: keys[c].combine_chunks().take(at).cast(pa.string())
            out = pa.RecordBatch.from_arrays([pick("lang"), pick("source"), terms.cast(pa.string()), pa.array(n), pa.array(df)], names=["lang", "source", "term", "n", "df"])
            for i in range(0, len(out), 1 << 16):
                yield out.slice(i, 1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= SHARD_BYTES:
                yield from counted(held)
                held, size = [], 0
        if held:
            yield from counted(held)

    shards = docs.select(*columns).mapInArrow(run, "lang string, source string, term string, n long, df long")
    return shards.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)), in exact decimals; ``terms`` is positive where it is read."""
    wide = lambda c: c.cast("decimal(27,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(F.lit(SCALE)).cast("decimal(11,0)") * wide(n + 1), wide(total + terms))


def _pair_sums(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value decimal): sums of divergences over all kept terms, for each two sources of a language.

    Terms go to buckets of about BUCKET_TERMS by a hash; a bucket meets its language's
    source totals by cogrouping and sums a strip of sources against all of them at a time,
    so a task holds STRIP_SOURCES times the sources, and nothing is broadcast. Sums are kept
    in two halves, so they stay exact.
    """
    buckets = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("v") / BUCKET_TERMS))
    sized = groups.select("lang", F.col("v")).distinct()
    left = join_sized(terms, sized, ["lang"]).select("lang", F.pmod(F.xxhash64("term"), buckets).alias("bucket"), "items")
    right = groups.where(F.col("v") > 0).select("lang", "source", "total", "v", F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1)).alias("bucket"))

    def summed(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        names = sorted(theirs["source"].to_pylist(), key=lambda s: s.encode())
        total = dict(zip(theirs["source"].to_pylist(), theirs["total"].to_pylist(), strict=True))
        items = pa.concat_arrays([c.cast(pa.list_(c.type.value_type)) for c in mine["items"].chunks]) if len(mine) else None
        if items is None or not names:
            return pa.table({c: pa.array([], t) for c, t in zip(("lang", "source", "item", "high", "low"), (*[pa.string()] * 3, *[pa.int64()] * 2), strict=True)})
        flat = items.flatten()
        place = {s: i for i, s in enumerate(names)}
        coded = flat.field("source").dictionary_encode()
        at = np.array([place[s] for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        n, sizes = flat.field("n").to_numpy(), items.value_lengths().to_numpy()
        v = theirs["v"][0].as_py()
        below = [total[s] + v for s in names]
        big = max(below) > 9 * 10**9  # beyond it 10^9 times a count leaves 64 bits
        base = np.array([1 + SCALE // b for b in below], np.int64)
        kind = object if big else np.int64
        p = (1 + SCALE * (n.astype(kind) + 1) // np.array(below, kind)[at]).astype(np.int64)
        term, m, step = np.repeat(np.arange(len(sizes)), sizes), len(names), max(1, (1 << 20) // len(names))
        out = []
        for s in range(0, m, STRIP_SOURCES):
            strip = slice(s, min(m, s + STRIP_SOURCES))
            high, low = (np.zeros((strip.stop - s, m), np.int64) for _ in range(2))
            for t in range(0, len(sizes), step):
                lo, hi = np.searchsorted(term, (t, t + step))
                block = np.tile(base, (min(step, len(sizes) - t), 1))
                block[term[lo:hi] - t, at[lo:hi]] = p[lo:hi]
                for i in range(s, strip.stop):
                    gap = block[:, i : i + 1] - block
                    f = gap * gap // block
                    high[i - s] += (f >> 32).sum(0)
                    low[i - s] += (f & 0xFFFFFFFF).sum(0)
            mine_names = np.repeat(np.arange(s, strip.stop), m)
            out.append(pa.table({
                "lang": pa.array([theirs["lang"][0].as_py()] * len(mine_names)), "source": pa.array(names).take(pa.array(mine_names)),
                "item": pa.array(names).take(pa.array(np.tile(np.arange(m), strip.stop - s))), "high": high.ravel(), "low": low.ravel(),
            }))
        return pa.concat_tables(out).combine_chunks()

    found = left.groupBy("lang", "bucket").cogroup(right.groupBy("lang", "bucket")).applyInArrow(summed, "lang string, source string, item string, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    return found.groupBy("lang", "source", "item").agg((wide("high") * F.lit(1 << 32).cast("decimal(11,0)") + wide("low")).alias("value"))


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against the other sources and the words that set it apart.

    A language keeps the terms in at least ``least_docs`` of its documents. Part ``pair``
    has every other source of the language, by the sum of divergences over all kept terms (0
    if there are none); part ``term`` the ``most_terms`` most divergent terms that the source
    uses more than its language. Values are exact integers; equal ones are ranked by the
    item's bytes.

    Null texts, languages and sources count as ''; each row is a document, repeated rows too.
    A source without terms is a source. Texts are read whole, however long, words too. Other
    columns, whatever their names, are not read; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))])
    counted = count_terms(docs, text_col, lang_col, source_col)
    merged = counted.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("items"))
    terms = scratch.keep(merged.where(F.col("df") >= least_docs).drop("df"), "terms")  # items: at most one for each source
    each = terms.select("lang", "term", F.col("n").alias("all_n"), F.explode("items").alias("i")).select("lang", "term", "all_n", "i.source", "i.n")
    vocab = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("all"))
    totals = each.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = named.distinct().join(totals, ["lang", "source"], "left").join(vocab, "lang", "left")
    groups = scratch.keep(groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "v", "all")]), "groups")

    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("all_n"), F.col("all"), F.col("v"))
    apart = join_sized(each, groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    gap = F.col("p") - F.col("q")
    apart = apart.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), "item", F.call_function("div", gap * gap, F.col("q")).alias("value"))
    ranks = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    apart = apart.withColumn("rank", ranks).where(F.col("rank") <= most_terms)

    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where(F.col("source") != F.col("item"))  # the rows that the part has
    pairs = pairs.join(_pair_sums(terms, groups), ["lang", "source", "item"], "left")
    value = F.coalesce(F.col("value").cast("long"), F.lit(0).cast("long"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", ranks)
    return pairs.unionByName(apart)


AUDIT_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT lang, source, d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), counts AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT d) AS df FROM words GROUP BY lang, source, term
), kept AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY lang, term HAVING sum(df) >= 3
), vocab AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), grouped AS (
  SELECT DISTINCT lang, source FROM docs
), totals AS (
  SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (WHERE k.term IS NOT NULL), 0)::HUGEINT AS total
  FROM grouped g LEFT JOIN counts c USING (lang, source) LEFT JOIN kept k ON k.lang = c.lang AND k.term = c.term GROUP BY g.lang, g.source
), cells AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + v.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (v.total + v.v) AS q
  FROM totals t JOIN kept k USING (lang) JOIN vocab v USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM cells WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
) WHERE part = 'pair' OR rank <= 200
"""
