"""Token counts by a finite-state tokenizer.

Byte-pair encoding of a piece is compiled, on demand, to a deterministic transducer over
bytes: a state is what any continuation can still see (the starts of unfinished tokens and
the last token before each), and a transition is annotated with the tokens it emits. The
number may be negative where a merge takes tokens back, and the sum over a piece is exactly
its token count. Texts are cut into chunks that all advance at once; a chunk's state map is
constant after its first piece start, so only its head needs the entry state, and a chunk
within one piece has a map of the entries that occur; a parallel prefix scan composes them.
"""

from __future__ import annotations

import functools
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.pretokens import piece_starts
from tidepool.llm.shared import map_text

CHUNK = 256
#: Bytes before a chunk whose state, from a cold start, is the first guess of its entry.
WARM = 96
#: Cells (states x bytes seen) kept before the table is emptied and compiled anew, which bounds memory.
MAX_CELLS = 40_000_000
_SHIFT, _BIAS = 7, 64


def byte_letters() -> dict[str, int]:
    """The byte for each letter of a byte-level vocabulary: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class CountingTransducer:
    """Compiles the merges of a byte-level BPE file (tokenizers' .json) as texts need them."""

    def __init__(self, path: str, max_cells: int = MAX_CELLS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_letters()
        raw = lambda s: bytes(byte[c] for c in s)
        self.special = [t["content"].encode() for t in spec["added_tokens"] if t["special"]]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.rank}
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t) + 1)}
        self.max_cells = max_cells
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((b"", None, 0),)
        self.ids, self.states = {start: 0}, [start]
        self.table = np.full((1024, 64), -1, np.int32)
        self.column = np.full(256, -1, np.int64)  # of each byte seen
        self.kept = 0  # states that the last emptying may grow to before the next

    def merge(self, piece: bytes) -> list[bytes]:
        """The ranked merges themselves, for short byte strings."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 30) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 30:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def adjacent(self, left: bytes | None, right: bytes) -> bool:
        """Whether the merges leave ``left`` and ``right`` as two tokens when they meet."""
        if left is None:
            return self.merge(right) == [right]
        key = (left, right)
        if key not in self.fits:
            if len(self.fits) > 1 << 20:
                self.fits.clear()
            self.fits[key] = self.merge(left + right) == [left, right]
        return self.fits[key]

    def compile(self, state: int, byte: int) -> None:
        """Adds one transition: packs the next state with the tokens emitted on the way."""
        b, live, last, emitted = bytes([byte]), [], None, None
        for suffix, before, count in self.states[state]:
            grown = suffix + b
            if grown in self.prefixes:
                live.append((grown, before, count))
                if emitted is None and grown in self.tokens and self.adjacent(before, grown):
                    last, emitted = grown, count + 1
        found = (*((s, t, c - emitted) for s, t, c in live), (b"", last, 0))
        to = self.ids.get(found)
        if to is None:
            to = self.ids[found] = len(self.states)
            self.states.append(found)
            if to >= len(self.table):
                more = np.full((len(self.table) // 2, self.table.shape[1]), -1, np.int32)
                self.table = np.concatenate([self.table, more])
        self.table[state, self.column[byte]] = to << _SHIFT | (emitted + _BIAS)

    def admit(self, data: np.ndarray) -> None:
        """Gives every byte of ``data`` a column."""
        new = np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0))
        used = int((self.column >= 0).sum())
        self.column[new] = np.arange(used, used + len(new))
        if (lack := used + len(new) - self.table.shape[1]) > 0:
            more = np.full((len(self.table), max(lack, 16)), -1, np.int32)
            self.table = np.concatenate([self.table, more], axis=1)

    def step(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        columns = self.column[data]
        packed = self.table[states, columns]
        missing = np.flatnonzero(packed < 0)
        if len(missing):
            need = np.unique(states[missing] << 8 | data[missing])
            for x in need:
                self.compile(int(x) >> 8, int(x) & 255)
            packed = self.table[states, columns]
        return packed

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text; texts hold no special strings."""
        if self.table.size > self.max_cells:
            self.reset()
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(n, np.int64)
        self.admit(data)
        starts = np.zeros(len(data), bool)
        starts[piece_starts(data, offsets)] = True

        # Chunks of each text, one lane each.
        per_text = -(-np.diff(offsets) // CHUNK)
        text = np.repeat(np.arange(n), per_text)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        lo = offsets[:-1][text] + nth * CHUNK
        length = np.minimum(CHUNK, offsets[1:][text] - lo)
        # Chunks by falling length, so that those still running are a prefix.
        order = np.argsort(-length, kind="stable")
        lo, length, text, nth = lo[order], length[order], text[order], nth[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        prior = np.where(nth > 0, place[np.maximum(order - 1, 0)], -1)

        # Bodies: from a chunk's first piece start on, whatever state it is entered in.
        state, total = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        head = length.copy()
        running = np.zeros(len(lo), bool)
        alive = len(lo)
        for k in range(int(length[0])):
            while length[alive - 1] <= k:
                alive -= 1
            at = lo[:alive] + k
            begins = starts[at]
            state[:alive][begins] = 0
            fresh = begins & ~running[:alive]
            head[:alive][fresh] = k
            running[:alive] |= begins
            if running[:alive].all():
                packed = self.step(state[:alive], data[at])
                state[:alive] = packed >> _SHIFT
                total[:alive] += (packed & 127) - _BIAS
            else:
                on = np.flatnonzero(running[:alive])
                packed = self.step(state[on], data[at[on]])
                state[on] = packed >> _SHIFT
                total[on] += (packed & 127) - _BIAS
            self.bound(state)

        total += self.scan(data, lo, head, state, running, prior)
        return np.bincount(text, total, n).astype(np.int64)

    def run(self, data: np.ndarray, lo: np.ndarray, length: np.ndarray, entry: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(exit state, tokens) of stretches of bytes, each entered in its state; all advance at once."""
        order = np.argsort(-length, kind="stable")
        state, total = entry[order].copy(), np.zeros(len(order), np.int64)
        at, length = lo[order], length[order]
        alive = len(order)
        for k in range(int(length[0]) if alive else 0):
            while length[alive - 1] <= k:
                alive -= 1
            packed = self.step(state[:alive], data[at[:alive] + k])
            state[:alive] = packed >> _SHIFT
            total[:alive] += (packed & 127) - _BIAS
            self.bound(state, *held)
        out, tokens = np.empty_like(state), np.empty_like(total)
        out[order], tokens[order] = state, total
        return out, tokens

    def scan(self, data: np.ndarray, lo: np.ndarray, head: np.ndarray, state: np.ndarray, running: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """Tokens of the heads, by a parallel prefix scan over the chunks' state maps.

        A map is held for the entry states that can occur: where the chunk before has a piece
        start, its one exit state; else the state that a few bytes before the border lead to,
        and whatever exit states the maps before turn out to have. Merges forget what is far
        back, so maps are closed after a round or two; equal chunks share their maps. Closed
        maps compose by doubling: after d steps a chunk knows its entry from d chunks before.
        """
        tokens = np.zeros(len(lo), np.int64)
        lanes = np.flatnonzero(head > 0)
        if not len(lanes):
            return tokens
        after_whole = ~running[prior[lanes]]
        first = lanes[~after_whole]
        entry = np.zeros(len(lo), np.int64)  # of the one entry known or guessed at first
        entry[first] = state[prior[first]]
        later = lanes[after_whole]
        if not len(later):
            tokens[first] = self.run(data, lo[first], head[first], entry[first], [])[1]
            return tokens
        guess = np.minimum(WARM, head[prior[later]])
        entry[later] = self.run(data, lo[later] - guess, guess, np.zeros(len(later), np.int64), [entry])[0]

        following = np.full(len(lo), -1)
        following[prior[later]] = later
        raw, contents = data.tobytes(), {}
        same = np.array([contents.setdefault(raw[a : a + h], i) for i, a, h in zip(lanes.tolist(), lo[lanes].tolist(), head[lanes].tolist(), strict=True)])
        content = np.full(len(lo), -1)
        content[lanes] = same
        lane_of, entry_of, exit_of, count_of = lanes, entry[lanes], np.zeros(0, np.int64), np.zeros(0, np.int64)
        done = 0
        while done < len(lane_of):  # new entries of this round: each distinct pair of bytes and entry runs once
            new_lane, new_entry = lane_of[done:], entry_of[done:]
            _, once, which = np.unique(content[new_lane] << 32 | new_entry, return_index=True, return_inverse=True)
            at = content[new_lane[once]]
            out, many = self.run(data, lo[at], head[at], new_entry[once], [entry_of, exit_of])
            exit_of, count_of = np.concatenate([exit_of, out[which]]), np.concatenate([count_of, many[which]])
            new_exit = exit_of[done:]
            done = len(lane_of)
            to = following[new_lane]
            asked = np.unique(to[to >= 0] << 32 | new_exit[to >= 0])
            asked = np.setdiff1d(asked, lane_of << 32 | entry_of, assume_unique=True)
            lane_of, entry_of = np.concatenate([lane_of, asked >> 32]), np.concatenate([entry_of, asked & 0xFFFFFFFF])

        # The node (chunk, entry) that follows each node; the last place stands for none.
        key = lane_of << 32 | entry_of
        by_key = np.argsort(key)
        to = following[lane_of]
        wanted = np.where(to >= 0, to << 32 | exit_of, 0)
        jump = np.append(by_key[np.minimum(np.searchsorted(key[by_key], wanted), len(key) - 1)], len(key))
        jump[:-1][to < 0] = len(key)
        reached = np.full(len(lo), len(key))
        reached[first] = np.searchsorted(lanes, first)
        back = np.where(np.isin(np.arange(len(lo)), later), prior, -1)  # the chunk d before, within a run of whole chunks
        while True:
            open_ = later[(reached[later] == len(key)) & (back[later] >= 0)]
            ready = open_[reached[back[open_]] < len(key)]
            if not len(ready):
                break
            reached[ready] = jump[reached[back[ready]]]
            jump = jump[jump]
            back = np.where(back >= 0, back[back], -1)
        tokens[lanes] = count_of[reached[lanes]]
        return tokens

    def bound(self, *held: np.ndarray) -> None:
        """Empties the table if it is too large, but for the states in use, which get new numbers in place."""
        if self.table.size <= self.max_cells or len(self.states) <= self.kept:
            return
        used = [self.states[i] for i in np.unique(np.concatenate(held)).tolist()]
        old = np.unique(np.concatenate(held))
        column = self.column
        self.reset()
        self.column = column
        new = np.array([self.ids.setdefault(s, len(self.ids)) for s in used])
        self.states = list(self.ids)
        size = max(1024, 2 * len(self.states))
        self.table = np.full((size, int((column >= 0).sum()) + 16), -1, np.int32)
        self.kept = 4 * len(self.states)
        for x in held:
            x[:] = new[np.searchsorted(old, x)]

    def count_texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text; a special string in a text is one token, as the library has it."""
        found: list[tuple[int, int]] = []
        joined = data.tobytes()
        for s in self.special:
            at = joined.find(s)
            while at >= 0:
                if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(s) - 1, "right"):
                    found.append((at, at + len(s)))
                    at = joined.find(s, at + len(s))
                else:
                    at = joined.find(s, at + 1)
        if not found:
            return self.count(data, offsets)
        found.sort()
        spans = [(int(a), int(b)) for a, b in zip(offsets, offsets[1:], strict=False)]
        pieces, owner, plain, i = [], [], np.zeros(len(spans), np.int64), 0
        for text, (a, b) in enumerate(spans):
            while i < len(found) and found[i][0] < b:
                pieces.append((a, found[i][0]))
                owner.append(text)
                plain[text] += 1
                a = found[i][1]
                i += 1
            pieces.append((a, b))
            owner.append(text)
        kept = np.concatenate([data[a:b] for a, b in pieces])
        cuts = np.concatenate([[0], np.cumsum([b - a for a, b in pieces])])
        return plain + np.bincount(owner, self.count(kept, cuts), len(spans)).astype(np.int64)


@functools.cache
def transducer(path: str) -> CountingTransducer:
    return CountingTransducer(path)


def count_tokens(
    docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """n_bytes, n_tokens and over_limit of every whole text; one narrow stage, no shuffle.

    Null and empty texts count 0 bytes and 0 tokens; repeated rows are counted each; null
    ids stay null; a very long text, also one of a single piece, advances in all its chunks
    at once. Other columns of ``docs``, whatever their names, are not read. ``path`` must
    be readable on every executor.
    """

    def make():
        count = transducer(path).count_texts

        def f(data, offsets):
            return {"n_bytes": np.diff(offsets), "n_tokens": count(data, offsets)}

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    counted = map_text(docs, [id_col], text_col, f"`{id_col}` {kind}, n_bytes long, n_tokens long", make)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
