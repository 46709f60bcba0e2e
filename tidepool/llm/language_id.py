"""Language identification by compression: the dictionary that shortens a text most names it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.shared import map_text

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries by language, in name order."""

    names: tuple[str, ...]
    contents: tuple[bytes, ...]
    window: int = 1024


def fit_languages(
    labelled: DataFrame,
    lang_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    docs_per_language: int = 200,
    chars_per_doc: int = 256,
    window: int = 1024,
) -> LanguageModel:
    """Fits on a bounded sample of labelled rows: ``docs_per_language`` of each language.

    The sample is the first in md5 order of the id. Each gives ``chars_per_doc`` characters
    from its middle, so a dictionary holds at most their product (51,200) of characters.
    Rows without language or text are left out. Only the sample reaches the driver.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    middle = F.greatest(F.lit(1), ((F.length(text_col) - chars_per_doc) / 2).cast("int"))
    rows = rows.select(
        F.col(lang_col).alias("lang"),
        order.alias("place"),
        F.substring(F.col(text_col), middle, F.lit(chars_per_doc)).alias("piece"),
    )
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place", "piece"))
    sample = rows.withColumn("nth", nth).where(F.col("nth") <= docs_per_language).collect()
    pieces: dict[str, list[str]] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["nth"])):
        pieces.setdefault(r["lang"], []).append(r["piece"])
    return LanguageModel(tuple(pieces), tuple("\n".join(p).lower().encode() for p in pieces.values()), window)


#: Zeros after each window: a block that shrinks anyway is never stored raw, so every match shows.
PADDING = bytes(64)


def coder(content: bytes) -> zstd.ZstdCompressor:
    """A compressor with a raw-content dictionary whose matches may be as short as four bytes."""
    params = zstd.ZstdCompressionParameters(
        strategy=zstd.STRATEGY_LAZY, min_match=4, window_log=19, hash_log=16, chain_log=16, search_log=3,
        target_length=16, write_checksum=False, write_content_size=False, write_dict_id=False,
    )
    d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(dict_data=d, compression_params=params)


def language_sizes(model: LanguageModel):
    """f(lower-cased bytes) -> compressed bytes under each dictionary, over every window of the text."""
    coders = [coder(c) for c in model.contents]

    def sizes(text: bytes) -> np.ndarray:
        total = np.zeros(len(coders))
        for at in range(0, len(text), model.window):
            part = text[at : at + model.window] + PADDING
            total += [len(c.compress(part)) for c in coders]
        return total

    return sizes


def identify_languages(
    docs: DataFrame,
    model: LanguageModel,
    narrow: float = 0.002,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, *keep, lang_pred, score, rejected) of every whole text; one narrow stage, no shuffle.

    Each window of a text is compressed with each language's dictionary; the language with
    the smallest sum wins, ties to the first name. score is the winner's share of
    exp(-bytes / 4). A text is rejected if it is null, has no letter (both 'und', score 0) or
    if the runner-up is within ``narrow`` of the winner's bytes. A model of one language
    takes everything; of none, nothing. Repeated rows get equal answers, null ids stay null;
    a very long text is one row whose windows are read one by one; no rows give no rows.
    Columns that are not named, whatever their names, are not read.
    """

    def make():
        sizes = language_sizes(model)

        def f(data, offsets):
            raw = data.tobytes()
            pred, score, rejected = [], [], []
            for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
                text = raw[a:b].decode("utf-8", "replace")
                if not model.names or not any(map(str.isalpha, text)):
                    pred.append(UNKNOWN), score.append(0.0), rejected.append(True)
                    continue
                s = sizes(text.lower().encode())
                best = int(np.argmin(s))
                pred.append(model.names[best])
                score.append(float(1 / np.exp(np.maximum(-700, (s[best] - s) / 4)).sum()))
                rest = np.delete(s, best)
                rejected.append(bool(len(rest) and rest.min() - s[best] <= narrow * s[best]))
            return {"lang_pred": pred, "score": score, "rejected": rejected}

        return f

    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    kept = ", ".join(f"`{c}` {fields[c]}" for c in (id_col, *keep))
    return map_text(docs, [id_col, *keep], text_col, f"{kept}, lang_pred string, score double, rejected boolean", make)
