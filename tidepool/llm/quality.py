"""Quality by the votes of the nearest labelled documents in a latent space.

A document is a row of a document-term matrix whose terms are character trigrams, patterns of
character classes, and how far back each word and line occurred before. The singular vectors
of a bounded labelled sample span the latent space; the sample's vectors in it are broadcast,
every document meets all of them in blocks, and its nearest vote with their similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.shared import map_text

#: Hashed columns of trigrams and of class patterns, and columns of distances to the last equal word and line.
TRIGRAMS, PATTERNS, STEPS = 1024, 1024, 16
WIDTH = TRIGRAMS + PATTERNS + 2 * STEPS
#: Weights of the four kinds of terms; a document's terms of each kind are scaled to this length.
KINDS = ((0, TRIGRAMS, 1.0), (TRIGRAMS, PATTERNS, 1.0), (TRIGRAMS + PATTERNS, STEPS, 1.5), (TRIGRAMS + PATTERNS + STEPS, STEPS, 1.0))
#: Bytes of a text that are hashed at once; a longer text is counted piece by piece.
PIECE = 2 << 20
#: Documents whose products with all labelled vectors are held at once.
BLOCK = 256

_CLASS = np.full(256, 7, np.uint64)  # other signs
_CLASS[[*range(97, 123), *range(128, 256)]] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[[44, 46]] = 5
_CLASS[[33, 63]] = 6
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _pieces(ends: np.ndarray) -> list[int]:
    """Cuts after about PIECE bytes each, behind a marked byte, so that no stretch between marks is cut."""
    cuts = [0]
    while len(ends) - cuts[-1] > PIECE:
        ahead = np.flatnonzero(ends[cuts[-1] + PIECE :])
        if not len(ahead):
            break
        cuts.append(cuts[-1] + PIECE + int(ahead[0]) + 1)
    return [*cuts, len(ends)] if len(ends) > cuts[-1] else cuts


def _tokens(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the stretches between bytes that ``ends`` marks; empty ones are left out."""
    inside, fresh = ~ends, np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | fresh[1:-1]
    last[:-1] &= ~inside[1:] | fresh[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes, cuts = [], _pieces(ends)
    for a, b in zip(cuts, cuts[1:], strict=False):
        sums = np.append(np.uint64(0), np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * _powers(_STEP, b - a), dtype=np.uint64))
        i, j = np.searchsorted(start, (a, b))
        hashes.append(_mixed((sums[end[i:j] - a] - sums[start[i:j] - a]) * _powers(_BACK, b - a)[start[i:j] - a]))
    return np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.searchsorted(offsets, start, "right") - 1


def _steps_back(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each token 1 + log2 of how many tokens ago its text had it before, at most STEPS - 1; 0 if never."""
    order = np.lexsort((hashes, text))
    out = np.zeros(len(order), np.int64)
    same = np.zeros(len(order), bool)
    same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
    ago = order[same] - order[np.flatnonzero(same) - 1]
    out[order[same]] = np.minimum(STEPS - 1, 1 + np.log2(ago).astype(np.int64))
    return out


def term_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The document-term matrix of whole texts: roots of term frequencies, each kind scaled to its weight.

    A text without terms of a kind, and so a null, empty or blank one, has zeros there.
    """
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH), np.float32)

    def put(rows: np.ndarray, terms: np.ndarray, at: int, size: int) -> None:
        out[:, at : at + size] += np.bincount(rows * size + terms, minlength=n * size).reshape(n, size)

    for a in range(0, len(data), PIECE):  # a gram belongs to the piece that it ends in
        wide, kind = data[max(0, a - 3) : a + PIECE].astype(np.uint64), _CLASS[data[max(0, a - 3) : a + PIECE]]
        text = np.searchsorted(offsets, np.arange(max(0, a - 3), max(0, a - 3) + len(wide)), "right") - 1
        skip = min(a, 1)  # the byte before a piece's first trigram ended in the piece before
        for grams, bits, m, at, size in ((wide[skip:], 8, 3, 0, TRIGRAMS), (kind, 3, 4, TRIGRAMS, PATTERNS)):
            if (count := len(grams) - m + 1) > 0:
                own = text[len(text) - len(grams) :]
                whole = own[m - 1 :] == own[:count]
                code = sum(grams[i : i + count] << np.uint64(bits * (m - 1 - i)) for i in range(m))
                put(own[m - 1 :][whole], (_mixed(code) % np.uint64(size)).astype(np.int64)[whole], at, size)
    if len(data):
        for i, ends in enumerate((np.isin(_CLASS[data], (3, 4)), data == 10)):
            hashes, own = _tokens(data, offsets, ends)
            put(own, _steps_back(hashes, own), TRIGRAMS + PATTERNS + i * STEPS, STEPS)
    for at, size, weight in KINDS:
        part = np.sqrt(out[:, at : at + size])
        norm = np.sqrt((part * part).sum(1, keepdims=True))
        out[:, at : at + size] = weight * part / np.maximum(norm, 1e-9)
    return out


@dataclass(frozen=True)
class QualityModel:
    """A latent space, labelled unit vectors in it, their labels, and how neighbours vote."""

    middle: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = 25
    sharpness: float = 8.0

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Rows of the document-term matrix as unit vectors of the latent space."""
        found = (rows - self.middle) @ self.axes
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by a power of their cosine."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        k, out = min(self.neighbours, len(self.labels)), np.empty(len(rows))
        for i in range(0, len(rows), BLOCK):
            cosine = self.place(rows[i : i + BLOCK]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-3).astype(np.float64) ** self.sharpness
            out[i : i + BLOCK] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.clip(out, 0.0, 1.0)


def _rows(docs: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """The ids and ``row binary``, the document-term row as floats."""

    def make():
        return lambda data, offsets: {"row": pa.array([r.tobytes() for r in term_rows(data, offsets)], pa.binary())}

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in id_cols)
    return map_text(docs, id_cols, text_col, f"{kinds}, row binary", make)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    low_docs: int = 2048,
    good_docs: int = 4096,
    dimensions: int = 32,
) -> QualityModel:
    """Fits on a bounded sample: the first low_docs and good_docs labelled rows in md5 order of the id.

    Whole texts are counted where they are; the driver holds one row of WIDTH floats for each
    sampled document (50 MB) and decomposes their covariance. Rows without id or label are
    left out, a null text is an empty one, repeated rows are one; ties of the order go by id.
    Without labelled rows every score is 0.5; with one class it is that class.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).distinct()
    nth = F.row_number().over(Window.partitionBy("_label").orderBy(F.md5(F.col("_id").cast("string")), "_id"))
    ids = known.withColumn("_nth", nth).where(F.col("_nth") <= F.when(F.col("_label") == 1, good_docs).otherwise(low_docs))
    ids = ids.where(F.col("_nth") <= max(low_docs, good_docs))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    sample = texts.join(F.broadcast(ids), "_id").distinct()  # ids: the two bounds at most
    found = _rows(sample, ["_label", "_nth"], "_text").toArrow()
    order = sorted(range(len(found)), key=lambda i: (found["_label"][i].as_py(), found["_nth"][i].as_py(), found["row"][i].as_py()))
    rows = np.array([np.frombuffer(found["row"][i].as_py(), np.float32) for i in order], np.float32).reshape(len(order), WIDTH)
    middle = rows.mean(0) if len(rows) else np.zeros(WIDTH, np.float32)
    off = rows - middle
    _, axes = np.linalg.eigh((off.T @ off).astype(np.float64))
    axes = axes[:, ::-1][:, :dimensions].astype(np.float32)
    model = QualityModel(middle, axes, np.zeros((0, axes.shape[1]), np.float32), np.zeros(0))
    return QualityModel(middle, axes, model.place(rows), np.array([found["_label"][i].as_py() for i in order], np.float64))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text, 0 to 1; one narrow stage, no shuffle.

    The model, WIDTH by its dimensions and a vector for each row of the bounded sample, is
    broadcast. Null and empty texts are documents without terms and get their neighbours'
    score; a very long text is counted in pieces. Repeated rows get equal scores; null ids stay
    null; other columns, whatever their names, are not read; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda data, offsets: {"score": shared.value.scores(term_rows(data, offsets))}

    return map_text(docs, [id_col], text_col, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double", make)
