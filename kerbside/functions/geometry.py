"""Box and line arithmetic as column expressions.

A box is a tuple of four columns (x1, y1, x2, y2).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", source=None) -> Box:
    pick = (lambda n: F.col(n)) if source is None else (lambda n: source[n])
    return tuple(pick(f"{prefix}{n}") for n in ("x1", "y1", "x2", "y2"))


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def overlap(a: Box, b: Box) -> Column:
    """Area that two boxes share."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for an empty union."""
    shared = overlap(a, b)
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def inner_ratio(inner: Box, outer: Box) -> Column:
    """Share of the inner box that lies in the outer one."""
    size = area(inner)
    return F.when(size > 0, overlap(inner, outer) / size).otherwise(F.lit(0.0))


def centre_in_raised(inner: Box, outer: Box, up: float) -> Column:
    """Whether the inner box's centre lies in the outer box extended upwards by a share of its height."""
    cx, cy = (inner[0] + inner[2]) / 2.0, (inner[1] + inner[3]) / 2.0
    top = outer[1] - (outer[3] - outer[1]) * F.lit(up)
    return cx.between(outer[0], outer[2]) & cy.between(top, outer[3])


def centre_in(inner: Box, outer: Box) -> Column:
    return centre_in_raised(inner, outer, 0.0)


def bottom_centre(b: Box) -> tuple[Column, Column]:
    return F.floor((b[0] + b[2]) / 2.0).cast("long"), b[3]


def turn(ax, ay, bx, by, x, y) -> Column:
    """Which side of the line from a to b a point lies on: its sign."""
    return F.signum(((y - ay) * (bx - ax) - (by - ay) * (x - ax)).cast("double")).cast("int")


def line_pixels(fractions: tuple[float, float, float, float], width: int, height: int) -> tuple[int, int, int, int]:
    ax, ay, bx, by = fractions
    return int(ax * width), int(ay * height), int(bx * width), int(by * height)


def expanded(b: Box, left: Column, top: Column, right: Column, bottom: Column, width: int, height: int) -> Box:
    """A box grown by shares of its size, whole pixels, clipped to the frame."""
    w, h = b[2] - b[0], b[3] - b[1]
    return (
        F.greatest(F.lit(0), (b[0] - w * left).cast("long")),
        F.greatest(F.lit(0), (b[1] - h * top).cast("long")),
        F.least(F.lit(width), (b[2] + w * right).cast("long")),
        F.least(F.lit(height), (b[3] + h * bottom).cast("long")),
    )


def clipped(b: Box, width: int, height: int) -> Box:
    return F.greatest(F.lit(0), b[0]), F.greatest(F.lit(0), b[1]), F.least(F.lit(width), b[2]), F.least(F.lit(height), b[3])


def padded(b: Box, width: int, height: int, across: float = 0.15, down: float = 0.25, least: int = 6) -> Box:
    """A box with a margin of shares of its size, at least some pixels, clipped to the frame."""
    x = F.greatest(F.lit(least), ((b[2] - b[0]) * across).cast("long"))
    y = F.greatest(F.lit(least), ((b[3] - b[1]) * down).cast("long"))
    return clipped((b[0] - x, b[1] - y, b[2] + x, b[3] + y), width, height)


def to_crop(b: Box, ox: Column, oy: Column, scale: Column) -> Box:
    """A box of the frame in the pixels of a crop that starts at (ox, oy) and is enlarged by a scale."""
    return tuple(((v - o) * scale).cast("long") for v, o in zip(b, (ox, oy, ox, oy)))


def to_frame(b: Box, ox: Column, oy: Column, scale: Column) -> Box:
    """The way back from a crop: over the scale, whole pixels, moved by the crop's origin."""
    return tuple((v / scale).cast("long") + o for v, o in zip(b, (ox, oy, ox, oy)))


def snapshot_score(b: Box, sharpness: Column, confidence: Column, is_clipped: Column) -> Column:
    size = F.sqrt((area(b)).cast("double"))
    return size * (F.least(sharpness, F.lit(400)) / 400.0 + 0.2) * F.when(is_clipped, 0.5).otherwise(1.0) * (confidence + 0.5)
