"""Tiles of an image, boxes in them, and decode sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE, OVERLAP, MARGIN = 2048, 256, 8


def spans(length: Column, edge: int = EDGE, overlap: int = OVERLAP) -> Column:
    """(start, size) of the tiles along an axis; the last one is cut off by its end."""
    step = edge - overlap
    last = F.greatest(F.ceil((length - edge) / step), F.lit(0)) * step
    starts = F.sequence(F.lit(0), last.cast("int"), F.lit(step))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.lit(edge), length - s).cast("int").alias("size")))


def tile_plan(images: DataFrame, edge: int = EDGE, overlap: int = OVERLAP) -> DataFrame:
    """A row for each tile of (image, width, height): tile, x, y, tile_width, tile_height.

    The origin is bottom-left; the top row of tiles comes first.
    """
    rows = images.select("*", F.posexplode(F.reverse(spans(F.col("height"), edge, overlap))).alias("_row", "_y"))
    across = spans(F.col("width"), edge, overlap)
    tiles = rows.select("*", F.size(across).alias("_n"), F.posexplode(across).alias("_col", "_x"))
    return tiles.select(
        *images.columns, (F.col("_row") * F.col("_n") + F.col("_col")).cast("int").alias("tile"),
        F.col("_x.start").alias("x"), F.col("_y.start").alias("y"),
        F.col("_x.size").alias("tile_width"), F.col("_y.size").alias("tile_height"),
    )


def mapped_box(box: dict[str, Column], tile: dict[str, Column], image: dict[str, Column]) -> dict[str, Column]:
    """A box in shares of a tile as shares of the image, and whether it is interior.

    An interior box keeps MARGIN pixels from every tile edge that has a neighbour beyond it.
    """
    placed, interior = {}, F.lit(True)
    for at, size, edge in (("x", "w", "width"), ("y", "h", "height")):
        near = box[at] * tile[edge]
        far = (1 - (box[at] + box[size])) * tile[edge]
        placed[at] = (tile[at] + near) / image[edge]
        placed[size] = box[size] * tile[edge] / image[edge]
        interior &= (tile[at] == 0) | (near >= MARGIN)
        interior &= (tile[at] + tile[edge] == image[edge]) | (far >= MARGIN)
    return placed | {"interior": interior}


def resize_geometry(width: Column, height: Column, side: int = 224) -> dict[str, Column]:
    """Size with the short edge at ``side``, and the centred crop's corner."""
    short = F.least(width, height)
    w = F.when(width == short, F.lit(side)).otherwise(F.floor(width * side / short)).cast("int")
    h = F.when(height == short, F.lit(side)).otherwise(F.floor(height * side / short)).cast("int")
    return {
        "resized_width": w,
        "resized_height": h,
        "crop_x": F.bround((w - side) / 2.0).cast("int"),
        "crop_y": F.bround((h - side) / 2.0).cast("int"),
    }


def thumbnail_edge(width: Column, height: Column, short_edge: int = 1600, most_pixels: int = 24_000_000) -> Column:
    """Longest edge to decode to: the short edge at most 1600 and 24 million pixels; never larger than it is."""
    long, short = F.greatest(width, height).cast("double"), F.least(width, height).cast("double")
    scale = F.least(F.lit(1.0), short_edge / short, F.sqrt(most_pixels / (long * short)))
    return F.greatest(F.lit(1), F.floor(long * scale)).cast("int")


#: Longest side and most pixels of a source that is decoded.
MOST_SIDE, MOST_SOURCE_PIXELS = 65_536, 100_000_000


def decode_problem(width: Column, height: Column) -> Column:
    """Why an image of this size isn't decoded: invalidImage without an extent, imageTooLarge beyond a side or the pixels; else null."""
    wide, high = width.cast("long"), height.cast("long")
    no = ~F.coalesce((wide > 0) & (high > 0), F.lit(False))
    large = (wide > MOST_SIDE) | (high > MOST_SIDE) | (wide * high > MOST_SOURCE_PIXELS)
    return F.when(no, "invalidImage").when(large, "imageTooLarge")
