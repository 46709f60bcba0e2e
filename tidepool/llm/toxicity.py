"""Toxicity by compression distance: a window that toxic text's dictionary shortens more than ordinary text's does.

The two dictionaries are trained alike, each on its own class: what is typical of the class
(word beginnings whose share of documents is far above the other class's, with the words
that have them) in front of the same sample of common text. The common part cancels what
both classes share, so that the difference of two lengths shows the typical part alone.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.shared import map_text

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are weighed, in characters with the blank before.
STARTS = range(4, 10)
#: Zeros after each window: a block that shrinks anyway is never stored raw, so every match shows.
PADDING = bytes(32)
#: Stands in for text where one dictionary is shorter, so that the common part lies at equal distances.
FILLER = b"\x01"
N_FEATURES = 6


@dataclass(frozen=True)
class ToxicityModel:
    """Raw dictionaries of ordinary and of toxic text, and calibrated weights of the features."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    window: int = 64


def coder(content: bytes) -> zstd.ZstdCompressor:
    params = zstd.ZstdCompressionParameters(
        strategy=zstd.STRATEGY_LAZY, min_match=4, window_log=19, hash_log=17, chain_log=17, search_log=5,
        target_length=16, write_checksum=False, write_content_size=False, write_dict_id=False,
    )
    d = zstd.ZstdCompressionDict(content or bytes(16), dict_type=zstd.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(dict_data=d, compression_params=params)


def windows(raw: bytes, step: int) -> list[bytes]:
    """Cuts at the first blank ``step`` bytes on, or at 16 times that, so that words stay whole."""
    out, a = [], 0
    while a < len(raw):
        b = raw.find(b" ", a + step, a + 16 * step + 1)
        b = b if b > 0 else min(len(raw), a + 16 * step)
        out.append(raw[a:b])
        a = b
    return out


def gain_features(model: ToxicityModel):
    """f(text) -> features of the bytes that the toxic dictionary saves in each window of the whole text."""
    ordinary, toxic = coder(model.ordinary), coder(model.toxic)

    def features(text: str) -> list[float]:
        parts = (w + PADDING for w in windows((" " + text.lower()).encode(), model.window))
        gains = np.array([len(ordinary.compress(p)) - len(toxic.compress(p)) for p in parts])
        top = np.sort(gains)[::-1]
        many = [3 * math.log1p(int((gains >= least).sum())) for least in (2, 4)]
        return [float(top[0]), float(top[:3].sum()) / 3, 10 * float(gains.mean()), *many, math.log(len(gains))]

    return features


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, ...]:
    """Weights of a ridge logistic regression by Newton steps, the intercept first."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.diag([1e-6, *[1.0] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def different(texts: list[str], values: int = 16) -> list[int]:
    """Places of the texts that are no near copy of one before, so that a copied text counts once.

    A copy shares half of its smallest hashes of three-word shingles with texts before it.
    """
    seen, out = set(), []
    for i, t in enumerate(texts):
        w = t.split()
        least = sorted({zlib.crc32(" ".join(w[k : k + 3]).encode()) for k in range(max(1, len(w) - 2))})[:values]
        if 2 * sum(x in seen for x in least) <= len(least):
            out.append(i)
            seen.update(least)
    return out


def word_starts(text: str) -> set[str]:
    return {f" {w}"[:n] for w in set(WORD.findall(text)) for n in STARTS if len(w) + 1 >= n}


def typical(texts: list[str], others: list[str], lift: float = 5.0, evidence: float = 12.0, words_each: int = 24, most_bytes: int = 16384) -> bytes:
    """Words typical of ``texts``: those with a beginning ``lift`` times as frequent, by documents, as in ``others``.

    ``evidence`` is the least log-likelihood ratio of that frequency, whatever the size of
    the sample, so rare vocabularies count if they are clear. Of nested beginnings the
    clearest stays. Each gives its most frequent words; the most telling come last, up to
    ``most_bytes``.
    """
    here, there, seen = Counter(), Counter(), Counter()
    for t in texts:
        here.update(word_starts(t))
        seen.update(set(WORD.findall(t)))
    for t in others:
        there.update(word_starts(t))
    n, m = max(1, len(texts)), max(1, len(others))
    found = []
    for s, c in here.items():
        d = there[s]
        if c < 4 or c / n < lift * (d + 0.5) / m:
            continue
        likely = c * math.log(c * (n + m) / ((c + d) * n)) + (d * math.log(d * (n + m) / ((c + d) * m)) if d else 0)
        if likely >= evidence:
            found.append((likely, len(s), s))
    chosen: dict[str, Counter] = {}
    for *_, s in sorted(found, reverse=True):
        if not any(s.startswith(x) or x.startswith(s) for x in chosen):
            chosen[s] = Counter()
    for w, c in seen.items():
        if own := next((s for k in STARTS if (s := f" {w}"[:k]) in chosen), None):
            chosen[own][f" {w}"] += c
    ranked = [[w for w, _ in sorted(x.items(), key=lambda y: (-y[1], y[0]))[:words_each]] for x in chosen.values()]
    out, size = [], 0
    for i in range(words_each):
        for words in ranked:
            if i < len(words) and size < most_bytes:
                out.append(words[i])
                size += len(words[i].encode())
    return "".join(reversed(out)).encode()


def dictionaries(toxic: list[str], ordinary: list[str], pieces: int = 500, chars: int = 200) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary contents: each class's typical words, then common text of ``pieces`` ordinary texts."""
    common = "\n".join(t[max(0, len(t) - chars) // 2 :][:chars] for t in ordinary[:pieces]).encode()
    own = typical(ordinary, toxic), typical(toxic, ordinary)
    width = max(map(len, own))
    return tuple(FILLER * (width - len(x)) + x + common for x in own)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    toxic_docs: int = 2500,
    ordinary_docs: int = 5000,
    chars_per_doc: int = 16384,
) -> ToxicityModel:
    """Fits on a bounded sample: the first toxic_docs and ordinary_docs labelled rows in md5 order of the id.

    Three in five of either class, near copies left out, make the dictionaries, from at most
    ``chars_per_doc`` characters of their middle, which is all that the driver holds of a
    text. The whole texts of the rest calibrate the weights, where they are, so the
    thresholds are those of unseen text. Rows without label or text are left out, repeated
    rows are one; ties of the order go by id; without both classes every score is 0.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).distinct()
    nth = F.row_number().over(Window.partitionBy("_label").orderBy(F.md5(F.col("_id").cast("string")), "_id"))
    ids = known.withColumn("_nth", nth).where(F.col("_nth") <= F.when(F.col("_label") == 1, toxic_docs).otherwise(ordinary_docs))
    ids = ids.where(F.col("_nth") <= max(toxic_docs, ordinary_docs))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where(F.col("_text") != "")
    rows = texts.join(F.broadcast(ids), "_id").distinct()  # ids: the two bounds at most
    middle = F.greatest(F.lit(1), ((F.length("_text") - chars_per_doc) / 2).cast("int"))
    piece = F.lower(F.substring(F.col("_text"), middle, F.lit(chars_per_doc))).alias("piece")
    sample = sorted((r["_label"], r["_nth"], r["piece"]) for r in rows.select("_label", "_nth", piece).collect())
    chosen = {}
    for y in (0, 1):
        of = [(n, t) for label, n, t in sample if label == y]
        chosen[y] = [of[i] for i in different([t for _, t in of])]
    if not chosen[0] or not chosen[1]:
        return ToxicityModel(b"", b"", (-30.0, *[0.0] * N_FEATURES))
    cut = {y: max(1, len(x) * 3 // 5) for y, x in chosen.items()}
    ordinary, toxic = dictionaries(*[[t for _, t in chosen[y][: cut[y]]] for y in (1, 0)])
    held = {y: [n for n, _ in chosen[y][cut[y] :] or chosen[y]] for y in (0, 1)}
    asked = docs.sparkSession.createDataFrame([(y, n) for y in (0, 1) for n in held[y]], "_label int, _nth int")
    measured = gains(rows.join(F.broadcast(asked), ["_label", "_nth"]), ToxicityModel(ordinary, toxic, ()), "_label", "_text").collect()
    order = sorted((r["_label"], *r["gains"]) for r in measured)
    weights = logistic(np.array([x[1:] for x in order]), np.array([x[0] for x in order], float))
    return ToxicityModel(ordinary, toxic, weights)


def gains(docs: DataFrame, model: ToxicityModel, id_col: str, text_col: str) -> DataFrame:
    """(id, gains array<double>): the features of every whole text."""

    def make():
        features = gain_features(model)

        def f(data, offsets):
            raw = data.tobytes()
            texts = (raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False))
            return {"gains": pa.array([features(t) for t in texts], pa.list_(pa.float64()))}

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    return map_text(docs, [id_col], text_col, f"`{id_col}` {kind}, gains array<double>", make)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text, 0 to 1; one narrow stage, no shuffle.

    Every window is compressed with both dictionaries; the savings of the best windows, the
    mean, the numbers of windows beyond two thresholds and of all give the score. Null and
    empty texts count as one window without savings; a very long text is one row whose
    windows are read one by one. Repeated rows get equal scores; null ids stay null; other
    columns, whatever their names, are not read.
    """
    measured = gains(docs, model, id_col, text_col)
    sum_ = F.lit(model.weights[0])
    for i, w in enumerate(model.weights[1:]):
        sum_ = sum_ + w * F.col("gains")[i]
    return measured.select(F.col(id_col), (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), sum_))))).alias("score"))
