"""Recognised lines: their rules, overlaps between tiles, and the merge of what tiles saw twice."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.vectors import broken

LINE = "struct<text:string,confidence:double,x:double,y:double,w:double,h:double>"
SHARE, VERTICAL = 0.6, 0.7


def result_problems(revision: Column, languages: Column, lines: Column) -> Column:
    """Names of the rules that a recognised result breaks."""
    unit = lambda x: (x >= 0) & (x <= 1)
    box = lambda l: unit(l["x"]) & unit(l["y"]) & (l["w"] >= 0) & (l["h"] >= 0) & (l["x"] + l["w"] <= 1) & (l["y"] + l["h"] <= 1)  # noqa: E731, E741
    total = F.aggregate(lines, F.lit(0), lambda s, l: s + F.octet_length(l["text"]))  # noqa: E741
    return broken([
        ("revision", ~revision.between(1, 3)),
        ("languages", ~F.size(languages).between(1, 16) | (F.size(F.array_distinct(languages)) != F.size(languages))),
        ("lines", F.size(lines) > 20_000),
        ("text", F.exists(lines, lambda l: (F.trim(l["text"]) == "") | (F.octet_length(l["text"]) > 65_536))),  # noqa: E741
        ("size", total > 4 << 20),
        ("confidence", F.exists(lines, lambda l: ~unit(l["confidence"]))),  # noqa: E741
        ("box", F.exists(lines, lambda l: ~box(l))),  # noqa: E741
    ])


def joined_text(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda l: l["text"]), "\n")  # noqa: E741


def _shared(a: dict[str, Column], b: dict[str, Column]) -> tuple[Column, Column]:
    """Shared width and height of two boxes."""
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return wide, high


#: Boxes of a band of an asset, about, and boxes beyond which bands are cut across too.
BAND_BOXES, CUT_ACROSS, MOST_BANDS, ACROSS = 16, 256, 1024, 8


def box_overlaps(boxes: DataFrame) -> DataFrame:
    """(asset_id, tile, seq, other_tile, other_seq, overlap) of boxes of different tiles that cover each other.

    The unit square of an asset with many boxes is cut into bands, and beyond CUT_ACROSS
    boxes into cells. A box is in every cell that it touches, and a pair is compared in one
    of them, that of its common part's lower left corner. So an asset is many groups, and
    boxes that are far from each other never meet.
    """
    counts = boxes.groupBy("asset_id").agg(F.count("*").alias("_n"))
    rows_, columns_ = F.least(F.lit(MOST_BANDS), F.ceil(F.col("_n") / BAND_BOXES)), F.when(F.col("_n") > CUT_ACROSS, ACROSS).otherwise(1)
    placed = boxes.join(counts.select("asset_id", rows_.cast("int").alias("_rows"), columns_.cast("int").alias("_columns")), "asset_id")
    cell = lambda v, n: F.floor(F.greatest(F.lit(0.0), F.least(v, F.lit(1.0 - 1e-9))) * n).cast("int")
    touched = lambda at, size, n: F.explode(F.sequence(cell(F.col(at), F.col(n)), cell(F.col(at) + F.col(size), F.col(n))))
    placed = placed.where((F.col("w") > 0) & (F.col("h") > 0))
    placed = placed.withColumn("_row", touched("y", "h", "_rows")).withColumn("_column", touched("x", "w", "_columns"))
    names = ("tile", "seq", "x", "y", "w", "h")
    left = placed.select("asset_id", "_row", "_column", "_rows", "_columns", *[F.col(c).alias(f"l_{c}") for c in names])
    right = placed.select("asset_id", "_row", "_column", *[F.col(c).alias(f"r_{c}") for c in names])
    a, b = ({c: F.col(f"{s}_{c}") for c in "xywh"} for s in "lr")
    wide, high = _shared(a, b)
    here = (cell(F.greatest(a["y"], b["y"]), F.col("_rows")) == F.col("_row")) & (cell(F.greatest(a["x"], b["x"]), F.col("_columns")) == F.col("_column"))
    pairs = left.join(right, ["asset_id", "_row", "_column"]).where((F.col("l_tile") < F.col("r_tile")) & (wide > 0) & (high > 0) & here)
    share = wide * high / F.least(a["w"] * a["h"], b["w"] * b["h"])
    pairs = pairs.where((share >= SHARE) & (high / F.least(a["h"], b["h"]) >= VERTICAL))
    return pairs.select(
        "asset_id", F.col("l_tile").alias("tile"), F.col("l_seq").alias("seq"), F.col("r_tile").alias("other_tile"),
        F.col("r_seq").alias("other_seq"), share.alias("overlap"),
    )


class Detection(NamedTuple):
    """A line as one tile saw it."""

    asset_id: int | None
    tile: int
    seq: int
    text: str
    confidence: float
    interior: bool
    x: float
    y: float
    w: float
    h: float


class _Seen:
    """A detection with its letters and digits, which is what spellings are compared by."""

    def __init__(self, row):
        self.row = row
        self.word = "".join(filter(str.isalnum, row.text.lower()))
        self.middle = row.y + row.h / 2

    def agrees(self, other: _Seen) -> bool:
        short, long = sorted((self.word, other.word), key=len)
        return bool(short) and (short == long or (len(short) >= 4 and short in long))

    def repeats(self, other: _Seen) -> bool:
        """Whether two tiles saw one line: boxes cover each other, and words agree or boxes are alike."""
        a, b = self.row, other.row
        if a.tile == b.tile or min(a.w, a.h, b.w, b.h) <= 0:
            return False
        wide = min(a.x + a.w, b.x + b.w) - max(a.x, b.x)
        high = min(a.y + a.h, b.y + b.h) - max(a.y, b.y)
        if wide <= 0 or high <= 0:
            return False
        share = wide * high / min(a.w * a.h, b.w * b.h)
        if share < SHARE or high / min(a.h, b.h) < VERTICAL:
            return False
        alike = min(a.w, b.w) >= 0.75 * max(a.w, b.w) and min(a.h, b.h) >= 0.7 * max(a.h, b.h)
        level = abs(self.middle - other.middle) <= 0.2 * max(a.h, b.h)
        return self.agrees(other) or (share >= 0.85 and alike and level)

    def beats(self, other: _Seen) -> bool:
        """Preference: longer of agreeing words, interior, confident, longer, lower tile; ties to self."""
        a, b = self.row, other.row
        lengths = (len(self.word), len(other.word))
        first = lengths if self.agrees(other) else (0, 0)
        mine = (first[0], a.interior, a.confidence, lengths[0], -a.tile)
        return mine >= (first[1], b.interior, b.confidence, lengths[1], -b.tile)


def _merged(rows: list[Detection]) -> list[tuple]:
    """(asset_id, seq, place, text) of the lines that stay of an asset's detections, which come by tile and sequence."""
    kept: list[_Seen] = []
    for row in rows:
        best, rest = _Seen(row), []
        new = best
        for old in kept:
            if old.repeats(new):
                best = old if old.beats(best) else best
            else:
                rest.append(old)
        kept = [*rest, best]
    kept.sort(key=lambda k: (-k.middle, k.row.x))
    return [(k.row.asset_id, k.row.seq, i, k.row.text) for i, k in enumerate(kept)]


def merge_lines(detections: DataFrame) -> DataFrame:
    """(asset_id, seq, place, text) of the lines that stay of (asset_id, tile, seq, text, confidence, interior, x, y, w, h).

    Detections are taken by tile and sequence; one that repeats lines already kept meets
    them in turn and the winner takes their place. Reading order is top to bottom, then left
    to right. The lines of one asset are bounded by the result rules; a task takes its assets
    one after another from sorted Arrow batches, with no frame or call for each.
    """
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string()]
    floats = [c in ("confidence", "x", "y", "w", "h") for c in Detection._fields]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["asset_id", "seq", "place", "text"])
        rows: list[Detection] = []
        for batch in batches:
            out: list[tuple] = []
            columns = [[math.nan if v is None else v for v in c.to_pylist()] if f else c.to_pylist() for c, f in zip(batch.columns, floats, strict=True)]
            for row in map(Detection, *columns):
                if rows and row.asset_id != rows[0].asset_id:
                    out += _merged(rows)
                    rows = []
                rows.append(row)
            if out:
                yield pack(out)
        if rows:
            yield pack(_merged(rows))

    by_asset = detections.select(*Detection._fields).repartition("asset_id")
    ordered = by_asset.sortWithinPartitions("asset_id", F.col("tile").asc_nulls_last(), F.col("seq").asc_nulls_last())
    return ordered.mapInArrow(merge, "asset_id long, seq int, place int, text string")
