"""Where the pieces of the byte-level pre-tokenizer pattern begin, for many texts at once.

The pattern's pieces depend on the class of a character, of its neighbours and on the
contraction letters after an apostrophe, so the splitter is a local transducer: two
characters on either side fix its state. That lets numpy find all starts at once.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

LETTER, NUMBER, SPACE, WHITE, OTHER, EDGE = range(6)
#: The characters of Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What the pattern takes as contractions after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def char_classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = NUMBER
    for c in WHITE_SPACE:
        table[ord(c)] = WHITE
    table[ord(" ")] = SPACE
    return table


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions in ``data`` (valid UTF-8) at which a piece begins, ascending.

    ``offsets`` bounds the texts; pieces never cross them.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80) if len(code) != len(data) else np.arange(len(data))
    kind = char_classes()[code]
    n = len(kind)
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(lead, offsets)] = True
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[edge[:-1]] = EDGE
    after[edge[1:]] = EDGE

    white = (kind == SPACE) | (kind == WHITE)
    white_before = (before == SPACE) | (before == WHITE)
    text_after = after <= NUMBER
    text_after |= after == OTHER
    start = np.where(white, ~white_before | text_after, (before != SPACE) & (before != kind))
    quotes = np.flatnonzero((code == ord("'")) & (before != SPACE) & (before != OTHER))
    if len(quotes):
        padded = np.concatenate([code, np.zeros(3, np.uint32)])
        inside = ~np.concatenate([edge[1:], np.ones(3, bool)])  # the next character is of the same text
        for tail in CONTRACTIONS:
            hit = quotes[inside[quotes]]
            for i, c in enumerate(tail, 1):
                hit = hit[padded[hit + i] == ord(c)]
                if i < len(tail):
                    hit = hit[inside[hit + i]]
            if len(hit):
                for i in range(1, len(tail) + 1):
                    start[hit + i] = False
                last = hit[inside[hit + len(tail)]] + len(tail) + 1
                follows = kind[last]
                start[last[(follows == LETTER) | (follows == NUMBER) | (follows == OTHER)]] = True
    return lead[start]
