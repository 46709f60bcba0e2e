"""Removal of passages that repeat: content-defined chunks of lines, grown line by line, compared by bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.shared import Scratch, join_sized, map_text
from tidepool.llm.shingles import WHITE, mix, powers

NEWLINE = 10
#: Bytes of a line's digest that are kept.
WIDTH = 16


@dataclass(frozen=True)
class PassageRule:
    """Consecutive lines are a passage if they are two lines of ``least_words`` or more, or have ``long_words``."""

    least_words: int = 16
    long_words: int = 50


@dataclass(frozen=True)
class Lines:
    """Lines of a run of texts, in order: text, words, digest of the bytes in two halves."""

    text: np.ndarray
    words: np.ndarray
    digests: np.ndarray


@dataclass(frozen=True)
class Windows:
    """Windows of lines of a run of texts: text, first line, lines, two rolling hashes of the lines' digests."""

    text: np.ndarray
    at: np.ndarray
    lines: np.ndarray
    keys: tuple[np.ndarray, np.ndarray]


def read_lines(data: np.ndarray, offsets: np.ndarray, size: int = WIDTH) -> Lines:
    """Splits texts into lines; digests are BLAKE2b of ``size`` bytes, filled or cut to WIDTH."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == NEWLINE)
    start = np.concatenate([offsets[:-1], breaks + 1])
    text = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((start, text))
    start, text = start[order], text[order]
    end = np.append(start[1:], 0)[: len(start)] - 1
    end[np.searchsorted(text, np.arange(n), "right") - 1] = offsets[1:]
    begins = ~WHITE[data]
    begins[1:] &= WHITE[data[:-1]]
    edges = offsets[offsets < len(data)]
    begins[edges] = ~WHITE[data[edges]]
    counted = np.concatenate([[0], np.cumsum(begins)])
    raw = data.tobytes()
    taken = [hashlib.blake2b(raw[a:b], digest_size=size).digest()[:WIDTH].ljust(WIDTH, b"\0") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return Lines(text, counted[end] - counted[start], np.frombuffer(b"".join(taken), np.uint64).reshape(-1, 2))


def _chosen(lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each two neighbouring lines: whether they are of one text, and which of them open a chunk.

    The one with the smaller hash does, both if they are equal; a line without words only
    yields to one that has some, and two of them open none.
    """
    value, blank = lines.digests[:, 0], lines.words == 0
    same, none = lines.text[1:] == lines.text[:-1], blank[1:] & blank[:-1]
    like = blank[1:] == blank[:-1]
    first = (blank[1:] & ~blank[:-1]) | (like & (value[:-1] <= value[1:]))
    second = (blank[:-1] & ~blank[1:]) | (like & (value[1:] <= value[:-1]))
    return same, first & ~none, second & ~none


def chunk_heads(lines: Lines, rule: PassageRule) -> np.ndarray:
    """True for lines that open a chunk: the smallest hash of a rolling window of two lines, and lines of ``long_words``.

    Whether a line opens a chunk depends on it and one neighbour, so two equal lines in a row
    have a chunk that opens alike wherever they stand.
    """
    same, first, second = _chosen(lines)
    heads = lines.words >= rule.long_words
    heads[:-1] |= same & first
    heads[1:] |= same & second
    return heads


def grown_windows(lines: Lines, repeated: np.ndarray, rule: PassageRule) -> Windows:
    """From ``repeated`` heads of chunks, the shortest passages that begin or end at each line they grow over.

    A chunk grows to its neighbour line by line while the two lines' own chunk opens with a
    repeated line. For each line so reached there is the shortest passage that begins with it
    and the shortest that ends with it. They cover every repeated passage: a line of it begins
    a shortest passage within it, or what follows it there is too short, and then the shortest
    passage up to its end holds the line.
    """
    text, n = lines.text, len(lines.text)
    low, high = np.searchsorted(text, text), np.searchsorted(text, text, "right")
    words = np.concatenate([[0], np.cumsum(lines.words)])
    line = np.arange(n)
    shut = np.minimum(
        np.maximum(line + 2, np.searchsorted(words, words[line] + rule.least_words)),
        np.maximum(line + 1, np.searchsorted(words, words[line] + rule.long_words)),
    )
    forward = shut <= high
    stop = line + 1
    open_ = np.maximum(
        np.minimum(stop - 2, np.searchsorted(words, words[stop] - rule.least_words, "right") - 1),
        np.minimum(stop - 1, np.searchsorted(words, words[stop] - rule.long_words, "right") - 1),
    )
    backward = open_ >= low
    span = np.int64(n + 1)
    both = np.unique(np.concatenate([line[forward] * span + shut[forward], open_[backward] * span + stop[backward]]))
    heads, tails = both // span, both % span

    _, first, second = _chosen(lines)
    halt = (first & ~repeated[:-1]) | (~first & second & ~repeated[1:])  # equal lines are repeated alike
    halts = np.concatenate([[0], np.cumsum(halt)])
    grown = (halts[tails - 1] == halts[heads]) & ((tails - heads > 1) | repeated[heads])
    heads, tails = heads[grown], tails[grown]
    forth, back = powers(n)
    keys = []
    with np.errstate(over="ignore"):
        for side in range(2):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lines.digests[:, side] * forth[:n])])
            keys.append(mix((total[tails] - total[heads]) * back[heads] + (tails - heads).astype(np.uint64)).view(np.int64))
    return Windows(text[heads], heads - low[heads], tails - heads, (keys[0], keys[1]))


def _line_table(own: DataFrame, size: int) -> DataFrame:
    """(id, doc, digests binary, words array<int>) of every text."""

    def make():
        def f(data, offsets):
            found, n = read_lines(data, offsets, size), len(offsets) - 1
            bounds = np.searchsorted(found.text, np.arange(n + 1)).astype(np.int32)
            digests = pa.py_buffer(found.digests.tobytes())
            return {
                "digests": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * WIDTH).tobytes()), digests]),
                "words": pa.ListArray.from_arrays(pa.array(bounds), pa.array(found.words.astype(np.int32))),
            }

        return f

    return map_text(own, ["id", "doc"], "text", "id long, doc long, digests binary, words array<int>", make)


def _lines_of(digests: pa.Array, words: pa.Array) -> Lines:
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    halves = np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 2)
    return Lines(np.repeat(np.arange(len(counts)), counts), words.flatten().to_numpy().astype(np.int64), halves)


def _places(lines: Lines) -> np.ndarray:
    return np.arange(len(lines.text)) - np.searchsorted(lines.text, lines.text)


def _head_table(lines: DataFrame, rule: PassageRule) -> DataFrame:
    """(head, id, doc, at) of every chunk: the hash of the line that opens it, and where."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = _lines_of(b.column(2), b.column(3))
                at = np.flatnonzero(chunk_heads(found, rule))
                rows = pa.array(found.text[at])
                columns = [found.digests[at, 0].view(np.int64), b.column(0).take(rows), b.column(1).take(rows), _places(found)[at].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["head", "id", "doc", "at"])

    return lines.mapInArrow(f, "head long, id long, doc long, at int")


def _window_table(lines: DataFrame, hits: DataFrame, rule: PassageRule) -> DataFrame:
    """(id, doc, k1, k2, at, lines) of every window grown from the heads ``hits`` (id, doc, heads array<int>)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found, hit = _lines_of(b.column(2), b.column(3)), b.column(4)
                rows = np.repeat(np.arange(b.num_rows), pc.list_value_length(hit).to_numpy(zero_copy_only=False))
                repeated = np.zeros(len(found.text), bool)
                repeated[np.searchsorted(found.text, rows) + hit.flatten().to_numpy()] = True
                w = grown_windows(found, repeated, rule)
                ids = pa.array(w.text)
                columns = [b.column(0).take(ids), b.column(1).take(ids), *w.keys, w.at.astype(np.int32), w.lines.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "doc", "k1", "k2", "at", "lines"])

    source = lines.join(hits, ["id", "doc"]).select("id", "doc", "digests", "words", "heads")
    return source.mapInArrow(f, "id long, doc long, k1 long, k2 long, at int, lines int")


def fewest_spans(spans: list[dict]) -> list[dict]:
    """Of spans (at, lines, ...) in order of ``at`` a few that cover the same lines."""
    kept, covered, i = [], 0, 0
    while i < len(spans):
        covered, best = max(covered, spans[i]["at"]), None
        while i < len(spans) and spans[i]["at"] <= covered:
            if best is None or spans[i]["at"] + spans[i]["lines"] > best["at"] + best["lines"]:
                best = spans[i]
            i += 1
        if best["at"] + best["lines"] > covered:
            kept.append(best)
            covered = best["at"] + best["lines"]
    return kept


_CLAIM = "at:int,lines:int,k1:long,k2:long,first:struct<id:long,doc:long,at:int>"


def _claims(later: DataFrame) -> DataFrame:
    """(id, doc, claim) of the windows to cut; those that others cover are left out."""
    kind = pa.struct(
        [("at", pa.int32()), ("lines", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64())]
        + [("first", pa.struct([("id", pa.int64()), ("doc", pa.int64()), ("at", pa.int32())]))]
    )

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [fewest_spans(s) for s in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.list_(kind))], ["id", "doc", "spans"])

    span = F.struct("at", "lines", "k1", "k2", "first")
    spans = later.groupBy("id", "doc").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    spans = spans.mapInArrow(f, f"id long, doc long, spans array<struct<{_CLAIM}>>")
    return spans.select("id", "doc", F.explode("spans").alias("c")).select("id", "doc", "c.*")


def _bodies(marked: DataFrame, text: str) -> DataFrame:
    """(k1, k2, body) of every mark: the bytes of its lines."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, bodies = [], [], []
            for t, marks in zip(b.column(0), b.column(1), strict=True):
                lines = t.as_py().split("\n")
                for m in marks.as_py():
                    k1.append(m["k1"])
                    k2.append(m["k2"])
                    bodies.append("\n".join(lines[m["at"] : m["at"] + m["lines"]]).encode())
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bodies, pa.binary())], ["k1", "k2", "body"])

    own = marked.where(F.col("marks").isNotNull()).select(F.col(text).cast("string"), "marks")
    return own.mapInArrow(f, "k1 long, k2 long, body binary")


def _cut(marked: DataFrame, names: list[str], where: int) -> DataFrame:
    """``names`` of ``marked`` without the lines of marks to cut, and how many went."""
    outputs = [*marked.columns[: len(names)], "removed"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, removed = b.column(where).to_pylist(), np.zeros(b.num_rows, np.int64)
            for i, marks in enumerate(b.column(len(names))):
                spans = [m for m in marks.as_py() if m["cut"]] if marks.is_valid else []
                if spans:
                    lines = texts[i].split("\n")
                    gone = np.zeros(len(lines), bool)
                    for m in spans:
                        gone[m["at"] : m["at"] + m["lines"]] = True
                    texts[i] = "\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g)
                    removed[i] = gone.sum()
            columns = [b.column(k) if k != where else pa.array(texts, pa.string()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed)], outputs)

    kinds = [f"c{k} {'string' if k == where else f.dataType.simpleString()}" for k, f in enumerate(marked.schema.fields[: len(names)])]
    return marked.mapInArrow(f, ", ".join([*kinds, "removed long"])).toDF(*names, "removed_lines")


def dedup_passages(
    docs: DataFrame, rule: PassageRule = PassageRule(), id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = WIDTH
) -> DataFrame:
    """``docs`` with repeated passages cut from the text, and removed_lines long.

    A line goes if a passage that holds it occurs before, by (id, text's hash, line) and
    without sharing lines with it. Chunks of lines open where a rolling hash says; those that
    open alike in two places grow line by line to passages, which are grouped by hashes of
    their lines. Then the bytes of every passage to cut are compared with those of its first
    occurrence; if any differ, all is done again with digests of a byte more than
    ``digest_bytes``. So passages that differ in capitals are different ones, each with a
    first occurrence of its own. Null and empty texts stay as they are; rows of equal id and
    text are one document, cut alike; different texts of one id are documents of their own,
    which go by their hash; rows without id are never cut; a text that loses all lines becomes
    ''. A very long text is one row with a digest for each of its lines; no rows give no rows.
    All columns are kept, whatever their names, but for an older removed_lines.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    docs = docs.drop("removed_lines")
    names = docs.columns
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    own = own.where(F.col("id").isNotNull() & F.col("text").isNotNull()).withColumn("doc", F.xxhash64("text"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = plain[f"c{names.index(id_col)}"], f"c{names.index(text_col)}"
    for size in range(digest_bytes, 65):
        lines = scratch.keep(_line_table(own, size), "lines")
        heads = _head_table(lines, rule)
        known = scratch.keep(heads.groupBy("head").agg(F.count("*").alias("n")).where("n > 1").select("head"), "known")
        hits = join_sized(heads, known, ["head"]).groupBy("id", "doc").agg(F.collect_set("at").alias("heads"))
        rows = scratch.keep(_window_table(lines, hits, rule), "windows")
        repeated = rows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("id", "doc", "at")).alias("first"))
        repeated = scratch.keep(repeated.where("n > 1").select("k1", "k2", "first"), "repeated")
        same_text = (F.col("id") == F.col("first.id")) & (F.col("doc") == F.col("first.doc"))
        later = join_sized(rows, repeated, ["k1", "k2"]).where(~same_text | (F.col("at") >= F.col("first.at") + F.col("lines")))
        claims = scratch.keep(_claims(later), "claims")
        firsts = claims.select("first.id", "first.doc", "first.at", "lines", "k1", "k2", F.lit(False).alias("cut")).distinct()
        marks = claims.select("id", "doc", "at", "lines", "k1", "k2", F.lit(True).alias("cut")).unionByName(firsts)
        marks = marks.groupBy("id", "doc").agg(F.collect_set(F.struct("at", "lines", "k1", "k2", "cut")).alias("marks"))
        marks = marks.select(F.col("id").alias("_key"), F.col("doc").alias("_doc"), "marks")
        match = (key.cast("long") == marks["_key"]) & (F.xxhash64(plain[text].cast("string")) == marks["_doc"])
        joined = plain.join(marks.hint("merge"), match, "left")  # a row for each marked text: never broadcast
        marked = scratch.keep(joined.select(*plain.columns, "marks"), "marked")
        scratch.drop("lines", "known", "windows", "repeated", "claims")
        bodies = _bodies(marked, text).distinct()
        if bodies.groupBy("k1", "k2").count().where("count > 1").isEmpty():
            return _cut(marked, names, names.index(text_col))
    raise RuntimeError("digests of 64 bytes still take different passages for equal")
