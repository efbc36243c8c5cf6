"""Page geometry as column expressions. Rectangles are (x0, y0, x1, y1), y up in source space, down on display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x0, y0, x1, y1) -> Column:
    """A rectangle with its corners in order."""
    x0, y0, x1, y1 = (F.lit(v) if not isinstance(v, Column) else v for v in (x0, y0, x1, y1))
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def intersection(a: Column, b: Column) -> Column:
    """The common part; null if it is empty."""
    x0, y0, x1, y1 = F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])
    return F.when((x0 < x1) & (y0 < y1), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def display_size(box: Column, rotation: Column, unit: Column) -> Column:
    """(width, height) of a page as shown."""
    w, h = (box["x1"] - box["x0"]) * unit, (box["y1"] - box["y0"]) * unit
    turned = rotation.isin(90, 270)
    return F.struct(F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"))


def to_display(x: Column, y: Column, box: Column, rotation: Column, unit: Column) -> Column:
    """Where a source point is shown: origin top left, y down, turned clockwise by ``rotation``."""
    left, right, below, above = x - box["x0"], box["x1"] - x, y - box["y0"], box["y1"] - y
    px = F.when(rotation == 90, below).when(rotation == 180, right).when(rotation == 270, above).otherwise(left)
    py = F.when(rotation == 90, left).when(rotation == 180, below).when(rotation == 270, right).otherwise(above)
    return F.struct((px * unit).alias("x"), (py * unit).alias("y"))


def to_source(x: Column, y: Column, box: Column, rotation: Column, unit: Column) -> Column:
    """The inverse of to_display()."""
    px, py = x / unit, y / unit
    sx = F.when(rotation == 90, box["x0"] + py).when(rotation == 180, box["x1"] - px).when(rotation == 270, box["x1"] - py).otherwise(box["x0"] + px)
    sy = F.when(rotation == 90, box["y0"] + px).when(rotation == 180, box["y0"] + py).when(rotation == 270, box["y1"] - px).otherwise(box["y1"] - py)
    return F.struct(sx.alias("x"), sy.alias("y"))


def rect_by(mapping, r: Column, box: Column, rotation: Column, unit: Column) -> Column:
    """A rectangle through to_display or to_source: both corners, put in order."""
    a, b = mapping(r["x0"], r["y0"], box, rotation, unit), mapping(r["x1"], r["y1"], box, rotation, unit)
    return rect(a["x"], a["y"], b["x"], b["y"])


def tile_of(v: Column, size: Column, tiles: Column) -> Column:
    """Index of the tile that holds a coordinate, held inside the page."""
    return F.least(F.greatest(F.floor(v * tiles / size), F.lit(0).cast("long")), (tiles - 1).cast("long"))


def affine_product(first: Column, then: Column) -> Column:
    """Of two (a, b, c, d, e, f): apply ``first``, then ``then``."""
    p, q = first, then
    return F.struct(
        (p["a"] * q["a"] + p["b"] * q["c"]).alias("a"), (p["a"] * q["b"] + p["b"] * q["d"]).alias("b"),
        (p["c"] * q["a"] + p["d"] * q["c"]).alias("c"), (p["c"] * q["b"] + p["d"] * q["d"]).alias("d"),
        (p["e"] * q["a"] + p["f"] * q["c"] + q["e"]).alias("e"), (p["e"] * q["b"] + p["f"] * q["d"] + q["f"]).alias("f"),
    )


def image_fit(width: Column, height: Column, box: Column, mode: str) -> Column:
    """Where an image is drawn in a box: ``stretch`` fills it; ``contain`` and ``cover`` keep the proportions, in its middle."""
    box_width, box_height = box["x1"] - box["x0"], box["y1"] - box["y0"]
    w, h = box_width, box_height
    if mode != "stretch":
        ratio = {"contain": F.least, "cover": F.greatest}[mode](box_width / width, box_height / height)
        w, h = width * ratio, height * ratio
    return F.struct((box["x0"] + (box_width - w) / 2).alias("x"), (box["y0"] + (box_height - h) / 2).alias("y"), w.alias("width"), h.alias("height"))
