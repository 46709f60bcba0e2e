"""Byte-level BPE encoding and decoding by a rank file.

``encode_words`` is the plain Spark form: a higher-order fold of ranked merges over the
byte array of each distinct word, with the ranks as a literal. Its cost for each distinct
word, and the shuffle that would carry the ids back to every occurrence, are beyond the
limits for whole corpora (figures in the README), so ``encode_texts`` folds the same
ranked merges over the byte arrays of the distinct words of an Arrow slice, in numpy.
``decode_ids`` is the Spark form: it concatenates binary pieces from a literal array.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.pretokens import piece_starts
from tidepool.llm.shared import map_text

#: Distinct words whose ids a worker remembers before it forgets all of them.
WORDS_KEPT = 200_000
#: Words longer than this merge through a heap instead of in numpy columns.
LONG_WORD = 512
NO_RANK = np.int32(2**31 - 1)


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a tiktoken rank file, by rank."""
    with open(path, "rb") as f:
        pairs = sorted((int(r), base64.b64decode(p)) for p, r in map(bytes.split, f))
    return [p for _, p in pairs]


class RankedMerges:
    """Folds merges over many words at once; pairs of ids are looked up in a hash table."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        rank = {p: i for i, p in enumerate(pieces)}
        self.byte = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (a << 20 | b, i)
            for i, p in enumerate(pieces)
            for cut in range(1, len(p))
            if (a := rank.get(p[:cut])) is not None and (b := rank.get(p[cut:])) is not None
        ]
        keys = np.array([k for k, _ in pairs], np.int64)
        values = np.array([v for _, v in pairs], np.int32)
        self.bits = max(8, int(len(pairs) * 4).bit_length())
        self.key = np.full((1 << self.bits) + 64, -1, np.int64)
        self.value = np.full(len(self.key), NO_RANK, np.int32)
        slot, left, self.probes = self.slot(keys), np.arange(len(keys)), 0
        while len(left):  # each round settles the first key that wants a free slot
            free = left[self.key[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.key[slot[won]], self.value[slot[won]] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] += 1
            self.probes += 1

    @functools.cached_property
    def plain(self) -> dict[int, int]:
        """The same table as a dictionary, for one pair at a time."""
        used = self.key >= 0
        return dict(zip(self.key[used].tolist(), self.value[used].tolist(), strict=True))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right
        slot = self.slot(keys)
        out = np.where(self.key[slot] == keys, self.value[slot], NO_RANK)
        todo = np.flatnonzero((self.key[slot] != keys) & (self.key[slot] >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            slot[todo] += 1
            here = self.key[slot[todo]]
            hit = here == keys[todo]
            out[todo[hit]] = self.value[slot[todo[hit]]]
            todo = todo[~hit & (here >= 0)]
        return out

    def fold(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of one length: each step merges the lowest-ranked pair of every word."""
        n, width = len(words), len(words[0])
        out: list[np.ndarray] = [None] * n
        parts = self.byte[np.frombuffer(b"".join(words), np.uint8)].reshape(n, width)
        row = np.arange(n)
        rank = self.ranks(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, width - 1)
        while len(row):
            if not rank.shape[1]:
                for r, p in zip(row.tolist(), parts, strict=True):
                    out[r] = p
                break
            at = rank.argmin(1)
            every = np.arange(len(row))
            best = rank[every, at]
            done = best == NO_RANK
            if done.any():
                for r, p in zip(row[done].tolist(), parts[done], strict=True):
                    out[r] = p
                parts, rank, row, at, best = parts[~done], rank[~done], row[~done], at[~done], best[~done]
                every = np.arange(len(row))
                if not len(row):
                    break
            parts[every, at] = best
            width = parts.shape[1] - 1
            keep = np.arange(width + 1)[None, :] != at[:, None] + 1
            parts = parts[keep].reshape(len(row), width)
            rank = rank[np.arange(width)[None, :] != at[:, None]].reshape(len(row), width - 1)
            near = np.flatnonzero(at > 0)
            rank[near, at[near] - 1] = self.ranks(parts[near, at[near] - 1], parts[near, at[near]])
            near = np.flatnonzero(at < width - 1)
            rank[near, at[near]] = self.ranks(parts[near, at[near]], parts[near, at[near] + 1])
        return out

    def fold_long(self, word: bytes) -> np.ndarray:
        """The same merges for one long word, in order of rank and place.

        The word's own pairs are sorted once, the pairs that merges make wait in a heap; both
        as rank times length plus place. A key counts if the pair there still has that rank.
        """
        start = self.byte[np.frombuffer(word, np.uint8)]
        n, rank = len(start), self.plain.get
        first = self.ranks(start[:-1], start[1:])
        own = np.flatnonzero(first != NO_RANK)
        own = np.sort(first[own].astype(np.int64) * n + own)
        coming = (key for at in range(0, len(own), 1 << 16) for key in own[at : at + (1 << 16)].tolist())
        ids, after, before = array("i", start.tobytes()), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        made: list[int] = []
        head = next(coming, None)
        while made or head is not None:
            if head is not None and (not made or head < made[0]):
                key, head = head, next(coming, None)
            else:
                key = heapq.heappop(made)
            r, i = divmod(key, n)
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i] << 20 | ids[j]) != r:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            left, right = before[i], after[i]
            if right < n:
                before[right] = i
                if (k := rank(r << 20 | ids[right])) is not None:
                    heapq.heappush(made, k * n + i)
            if left >= 0 and (k := rank(ids[left] << 20 | r)) is not None:
                heapq.heappush(made, k * n + left)
        out = np.frombuffer(ids, np.int32)
        return out[out >= 0]

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, where in by_length.items():
            if length == 1:
                found = [self.byte[w[0] : w[0] + 1] for w in (words[i] for i in where)]
            elif length > LONG_WORD:
                found = [self.fold_long(words[i]) for i in where]
            else:
                found = self.fold([words[i] for i in where])
            for i, ids in zip(where, found, strict=True):
                out[i] = ids
        return out


@functools.cache
def ranked_merges(path: str) -> tuple[RankedMerges, dict[bytes, np.ndarray]]:
    return RankedMerges(read_ranks(path)), {}


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """(id, *keep, ids array<int>) of every whole text; one narrow stage, no shuffle.

    Texts are cut by the byte-level pattern; special strings are ordinary text. Null and
    empty texts get an empty array; repeated rows are encoded each; null ids stay null; a very
    long text is one row, and a piece of any length takes time in proportion to n log n; only
    the columns named are read. ``path`` must be readable on every executor.
    """

    def make():
        merges, known = ranked_merges(path)

        def f(data, offsets):
            n = len(offsets) - 1
            starts = piece_starts(data, offsets)
            bounds = np.append(starts, len(data)).astype(np.int32)
            words = pa.Array.from_buffers(
                pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data.tobytes())]
            ).dictionary_encode()
            distinct = words.dictionary.to_pylist()
            new = [w for w in distinct if w not in known]
            if len(known) + len(new) > WORDS_KEPT:
                known.clear()
                new = distinct
            known.update(zip(new, merges.encode(new), strict=True))
            ids = [known[w] for w in distinct]
            size = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            first = np.cumsum(size) - size
            which = words.indices.to_numpy()
            each = size[which]
            upto = np.concatenate([[0], np.cumsum(each)])
            place = np.repeat(first[which] - upto[:-1], each) + np.arange(upto[-1])
            per_text = upto[np.searchsorted(starts, offsets)].astype(np.int32)
            return {"ids": pa.ListArray.from_arrays(pa.array(per_text), pa.array(flat[place], pa.int32()))} if n else {}

        return f

    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in (id_col, *keep)) + ", ids array<int>"
    return map_text(docs, [id_col, *keep], text_col, schema, make)


def decode_ids(ids: Column, path: str) -> Column:
    """The bytes of token ids: binary pieces from a literal array, concatenated in order.

    Null gives null, an empty array empty bytes; an id that the file lacks is an error.
    """
    pieces = json.dumps([base64.b64encode(p).decode() for p in read_ranks(path)])
    table = F.from_json(F.lit(pieces), "array<binary>")
    each = F.transform(ids, lambda i: F.element_at(table, i + 1).cast("string"))
    return F.array_join(each, "").cast("binary")


def encode_words(words: DataFrame, path: str, word_col: str = "word") -> DataFrame:
    """(word, ids) of each distinct word, as a Spark fold of ranked merges over its bytes.

    The ranks are a literal: an array of buckets by crc32 of the piece's hex, each a map,
    so a lookup reads one short map. Each step of the fold merges the first pair of lowest
    rank; a word of n bytes takes n - 1 steps. Null words are left out.
    """
    pieces = read_ranks(path)
    buckets: list[dict[str, int]] = [{} for _ in range(1 << 14)]
    import zlib

    for i, p in enumerate(pieces):
        buckets[zlib.crc32(p.hex().upper().encode()) % len(buckets)][p.hex().upper()] = i
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")
    none = F.lit(int(NO_RANK))

    def rank(piece: Column) -> Column:
        at = (F.crc32(piece.cast("binary")) % len(buckets) + 1).cast("int")
        return F.coalesce(F.try_element_at(F.element_at(table, at), piece), none)

    def step(parts: Column, _: Column) -> Column:
        pairs = F.zip_with(parts, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
        ranks = F.transform(F.filter(pairs, lambda p: p.isNotNull()), rank)
        best = F.array_min(ranks)
        at = F.array_position(ranks, best).cast("int")
        merged = F.concat(
            F.slice(parts, F.lit(1), at - 1),
            F.array(F.concat(F.element_at(parts, at), F.element_at(parts, at + 1))),
            F.slice(parts, at + 2, F.size(parts)),
        )
        return F.when((F.size(parts) > 1) & (best < none), merged).otherwise(parts)

    word = F.col(word_col).cast("binary")
    digits = F.hex(word)
    parts = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(digits, i * 2 - 1, F.lit(2)))
    folded = F.aggregate(F.sequence(F.lit(1), F.length(word)), parts, step)
    ids = F.when(F.length(word) == 0, F.array().cast("array<int>")).otherwise(F.transform(folded, rank))
    return words.where(F.col(word_col).isNotNull()).select(F.col(word_col)).distinct().select(word_col, ids.alias("ids"))
