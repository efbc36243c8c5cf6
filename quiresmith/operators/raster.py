"""Integer raster kernels over arrays of pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area_weights(source: int, target: int) -> list[list[tuple[int, int]]]:
    """For each target cell the (source cell, weight) it covers along one axis, in units of 1 / target."""
    out = []
    for i in range(target):
        lo, hi = i * source, (i + 1) * source
        out.append([(s, min(hi, (s + 1) * target) - max(lo, s * target)) for s in range(source) if min(hi, (s + 1) * target) > max(lo, s * target)])
    return out


def thumbnail(pixels: Column, width: int, height: int, out_width: int, out_height: int) -> Column:
    """Exact integer area average of row-major pixels, rounded half up; the grid sizes are fixed arguments."""
    xs, ys, area = area_weights(width, out_width), area_weights(height, out_height), width * height
    cells = []
    for row in ys:
        for col in xs:
            total = sum((F.get(pixels, F.lit(y * width + x)) * (wy * wx) for y, wy in row for x, wx in col), F.lit(0))
            cells.append(F.floor((2 * total + area) / (2 * area)).cast("int"))
    return F.array(*cells)


def winding(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Winding number of a closed polygon around a point: half-open crossings strictly right of it."""
    total = F.lit(0)
    for (x0, y0), (x1, y1) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if y0 == y1:
            continue
        cross = F.lit(float(x0)) + (y - float(y0)) * float(x1 - x0) / float(y1 - y0)
        up = y1 > y0
        inside = (y >= float(min(y0, y1))) & (y < float(max(y0, y1))) & (cross > x)
        total = total + F.when(inside, 1 if up else -1).otherwise(0)
    return total


def rotated(pixels: Column, width: int, height: int, rotation: Column) -> Column:
    """Row-major pixels turned clockwise by 0, 90, 180 or 270 degrees."""

    def source(i: Column) -> Column:
        across, down = i % height, F.floor(i / height)  # of the turned grid, where its sides are exchanged
        return F.when(rotation == 90, (height - 1 - across) * width + down).when(rotation == 180, width * height - 1 - i).when(rotation == 270, across * width + width - 1 - down).otherwise(i).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: F.get(pixels, source(i)))
