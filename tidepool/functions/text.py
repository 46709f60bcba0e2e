"""Text as columns: terms, folding, bounds, cleaning, script."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"
MOST_QUERY_BYTES, MOST_TERMS = 4096, 32


def terms(text: Column) -> Column:
    """Runs of letters and numbers; marks stay with their letter."""
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def n_terms(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TERM)), F.lit(0))


@cache
def _latin_fold() -> tuple[str, str]:
    """Lower-case Latin letters that are one base letter and one mark, and their base letters."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and "a" <= parts[0] <= "z" and unicodedata.combining(parts[1]):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Lower case without the accents of Latin letters; Cyrillic letters keep theirs."""
    plain = F.translate(F.lower(text), *_latin_fold())
    return F.regexp_replace(plain, r"\p{Mn}(?<=[a-z]\p{Mn})", "")


def tokens(text: Column) -> Column:
    """Index tokens: folded terms in order."""
    return terms(folded(text))


def query_status(text: Column) -> Column:
    """ok, empty or too_long: at most 4096 bytes and 32 terms, and not blank."""
    long = (F.octet_length(text) > MOST_QUERY_BYTES) | (F.size(terms(text)) > MOST_TERMS)
    blank = F.coalesce(F.regexp_replace(text, r"[\s\p{Z}]+", "") == "", F.lit(True))
    return F.when(long, "too_long").when(blank, "empty").otherwise("ok")


def script(text: Column) -> Column:
    """latin, cyrillic, mixed, other, or short for fewer than four letters."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", "")
    return (
        F.when(F.length(letters) < 4, "short")
        .when(letters.rlike(r"^\p{IsLatin}+$"), "latin")
        .when(letters.rlike(r"^\p{IsCyrillic}+$"), "cyrillic")
        .when(letters.rlike(r"^[\p{IsLatin}\p{IsCyrillic}]+$"), "mixed")
        .otherwise("other")
    )


def _windows_1252() -> tuple[str, str]:
    """Characters of Windows-1252 beyond Latin-1 and the Latin-1 characters of their bytes."""
    pairs = []
    for b in range(0x80, 0xA0):
        try:
            pairs.append((bytes([b]).decode("cp1252"), chr(b)))
        except UnicodeDecodeError:
            continue
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: UTF-8 sequences of two to four bytes, read as Latin-1 characters; no overlong or surrogate forms.
_MISREAD = (
    "[\\u00C2-\\u00DF][\\u0080-\\u00BF]|\\u00E0[\\u00A0-\\u00BF][\\u0080-\\u00BF]"
    "|[\\u00E1-\\u00EC\\u00EE\\u00EF][\\u0080-\\u00BF]{2}|\\u00ED[\\u0080-\\u009F][\\u0080-\\u00BF]"
    "|\\u00F0[\\u0090-\\u00BF][\\u0080-\\u00BF]{2}|[\\u00F1-\\u00F3][\\u0080-\\u00BF]{3}|\\u00F4[\\u0080-\\u008F][\\u0080-\\u00BF]{2}"
)


def mojibake(text: Column) -> Column:
    """Whether a text holds U+FFFD or UTF-8 bytes that were read as Latin-1 or Windows-1252."""
    return text.contains("�") | F.translate(text, *_windows_1252()).rlike(_MISREAD)


def _controls() -> dict[int, str | None]:
    """Translation for one pass of fixes: quotes, line breaks, ligatures, wide forms, controls."""
    table: dict[int, str | None] = {}
    for code in (*range(0x00, 0x09), 0x0B, *range(0x0E, 0x20), 0x7F, *range(0x206A, 0x2070), 0xFEFF, *range(0xFFF9, 0xFFFD)):
        table[code] = None
    for code in (*range(0x0132, 0x0134), *range(0x01C4, 0x01CD), *range(0x01F1, 0x01F4), *range(0xFB00, 0xFB07)):
        table[code] = unicodedata.normalize("NFKC", chr(code))
    for code in range(0xFF01, 0xFFF0):
        table[code] = unicodedata.normalize("NFKC", chr(code))
    table |= dict.fromkeys((0x2BC, *range(0x2018, 0x201C)), "'") | dict.fromkeys(range(0x201C, 0x2020), '"')
    table |= dict.fromkeys((0x0D, 0x85, 0x2028, 0x2029), "\n") | {0x3000: " "}
    for wide, latin in zip(*_windows_1252(), strict=True):
        table[ord(latin)] = wide if ord(latin) != 0x85 else "…"
    return table


_ENTITY = re.compile(r"&#?[0-9A-Za-z]{1,24};")
_ESCAPE = re.compile(r"\x1b\[[\d;]*[a-zA-Z]")


def decoded(match: re.Match) -> str:
    """The character of an entity; an upper-case name that stands for none takes the lower-case one's, in upper case."""
    found = html.unescape(match[0])
    if found == match[0] and match[0] == match[0].upper():
        low = html.unescape(match[0].lower())
        found = low.upper() if low != match[0].lower() else found
    return found


def clean_description(text: str | None) -> str | None:
    """A description as its encoder wants it: entities, quotes, widths, controls, blanks, lower case."""
    if text is None:
        return None
    table, out, decode = _controls(), [], True
    for line in text.split("\n"):
        decode = decode and "<" not in line  # markup from here on: entities are meant literally
        while True:  # each round shortens the line or leaves it in a normal form
            fixed = _ENTITY.sub(decoded, line) if decode else line
            fixed = unicodedata.normalize("NFC", _ESCAPE.sub("", fixed).translate(table))
            if fixed == line:
                break
            line = fixed
        out.append(line)
    joined = html.unescape(html.unescape("\n".join(out)))
    return re.sub(r"\s+", " ", joined).strip(" ").lower()


def clean_text(text: Column) -> Column:
    """Cleaned text, by Arrow batches: normal forms and entities have no built-in function."""

    @F.pandas_udf("string")
    def cleaned(s: pd.Series) -> pd.Series:
        return s.map(clean_description, na_action="ignore")

    return cleaned(text)


def safe_path(path: Column) -> Column:
    """Relative, without empty, '.' or '..' parts, backslash or NUL."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", "..")) | path.contains("\\") | path.contains("\0")
    return ~F.coalesce(bad, F.lit(True))
