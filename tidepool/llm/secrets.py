"""Secret scans: fixed patterns, and random strings shown by few characters per token."""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.shared import map_text

#: The base kinds in their order, then the kind that the method adds.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Digest lengths in hex digits (md5, sha1, sha224, sha256, sha384, sha512) and uuids: known, not secret.
DIGESTS = frozenset({32, 40, 56, 64, 96, 128})
UUID = re.compile(rb"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
SPANS_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _bytes_of(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_DIGIT, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_HEX = _bytes_of(_DIGIT + "abcdef")
_RUN = _bytes_of(_DIGIT + _LOWER + _LOWER.upper() + "+/_=-")


def runs(data: np.ndarray, table: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of a byte class that are at least so long."""
    inside = np.concatenate([[False], table[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


@functools.cache
def tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def looks_random(run: bytes, enc: tiktoken.Encoding, most_chars_per_token: float) -> bool:
    """Letters and digits mixed, no known digest or identifier, and few characters per token."""
    if run.isdigit() or run.isalpha() or not re.search(rb"[0-9]", run) or not re.search(rb"[A-Za-z]", run):
        return False
    if UUID.fullmatch(run) or (len(run) in DIGESTS and re.fullmatch(rb"[0-9a-fA-F]+", run)):
        return False
    return len(run) <= most_chars_per_token * len(enc.encode_ordinary(run.decode("ascii")))


def scan_secrets(
    docs: DataFrame,
    path: str,
    pattern: str,
    least_chars: int = 16,
    most_chars_per_token: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Secret spans of every whole text: (id, spans array<struct<kind,start,end>>).

    Base kinds, leftmost and non-overlapping within each: ``assign`` with a value of 8
    characters or more, ``access`` of 16 or more, ``hex`` runs of 32 or more. ``random``
    adds runs of at least ``least_chars`` key characters that touch no base span, mix
    letters with digits and come to at most ``most_chars_per_token``; digests and uuids
    are excluded. Positions are code points, end exclusive, by start, then kind; spans of
    two kinds may begin alike, and all are given. Null and empty texts have no spans;
    repeated rows get equal spans, null ids stay null; a very long text is one row, whose
    time grows with its length alone. Other columns, whatever their names, are not read.
    One narrow stage, no shuffle.
    """

    def make():
        enc = tokenizer(path, pattern)

        def f(data, offsets):
            n = len(offsets) - 1
            # A zero byte, which no pattern takes, keeps matches within a text.
            apart = np.zeros(len(data) + n, np.uint8)
            owner = np.repeat(np.arange(n), np.diff(offsets))
            apart[np.arange(len(data)) + owner] = data
            raw = apart.tobytes()
            starts = offsets[:-1] + np.arange(n)
            found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 8]
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 16]
            found += [(a, 2, b) for a, b in runs(apart, _HEX, 32)]
            taken = np.zeros(len(apart) + 1, bool)
            for a, _, b in found:
                taken[a:b] = True
            for a, b in runs(apart, _RUN, least_chars):
                if not taken[a:b].any() and looks_random(raw[a:b], enc, most_chars_per_token):
                    found.append((a, 3, b))
            found.sort()
            first = np.array([a for a, _, _ in found], np.int64)
            owners = np.searchsorted(starts, first, "right") - 1
            # Code points before each span: the bytes that begin one, counted once for all spans.
            begun = np.concatenate([[0], np.cumsum((apart & 0xC0) != 0x80)])
            places = begun[first] - begun[starts[owners]]
            spans: list[list] = [[] for _ in range(n)]
            for (a, kind, b), text, at in zip(found, owners.tolist(), places.tolist(), strict=True):
                spans[text].append({"kind": KINDS[kind], "start": at, "end": at + b - a})
            return {"spans": pa.array(spans, SPANS_TYPE)}

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, spans array<struct<kind:string,start:long,end:long>>"
    return map_text(docs, [id_col], text_col, schema, make)


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
