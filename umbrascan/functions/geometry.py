"""Column functions on colours and rectangles. A rectangle is four DOUBLE columns or a struct of x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the relative luminance and the thresholds of the detectors.
KNEE, GAMMA = 0.03928, 2.4
LOW_CONTRAST, WHITE, TINY = 1.5, 240, 4.0
STRIP = 8.0
MIN_BOX = 8.0
MAX_UPLOAD = 4_000_000


def channels(colour: Column) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(colour, s).bitwiseAND(255) for s in (16, 8, 0))


def luminance(rgb: tuple[Column, Column, Column]) -> Column:
    linear = lambda c: F.when(c / 255 <= KNEE, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(GAMMA)))
    r, g, b = map(linear, rgb)
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def contrast(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def rect(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + c) for c in ("x0", "y0", "x1", "y1"))


def area(r) -> Column:
    return F.greatest(r[2] - r[0], F.lit(0.0)) * F.greatest(r[3] - r[1], F.lit(0.0))


def common_part(a, b) -> tuple[Column, Column, Column, Column]:
    return F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])


def overlap(a, b) -> Column:
    """Which share of a lies in b; 0 if a has no area."""
    return F.when(area(a) > 0, area(common_part(a, b)) / area(a)).otherwise(F.lit(0.0))


def same_line(span, line, least: float = 0.5) -> Column:
    """They meet, and share at least half of the shorter one's height."""
    inter = common_part(span, line)
    shorter = F.least(span[3] - span[1], line[3] - line[1])
    return (inter[2] > inter[0]) & (inter[3] > inter[1]) & (inter[3] - inter[1] >= least * shorter)


def union(prefix: str = "") -> list[Column]:
    """Aggregates for the rectangle around a group."""
    return [F.min(prefix + "x0").alias("x0"), F.min(prefix + "y0").alias("y0"), F.max(prefix + "x1").alias("x1"), F.max(prefix + "y1").alias("y1")]


def to_pixels(r, zoom: float = 2.0) -> list[Column]:
    return [c * zoom for c in r]


def polygon_box(points: Column, zoom: float = 2.0) -> Column:
    """The box in points around an array of [x, y] pixels."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct((F.array_min(xs) / zoom).alias("x0"), (F.array_min(ys) / zoom).alias("y0"), (F.array_max(xs) / zoom).alias("x1"), (F.array_max(ys) / zoom).alias("y1"))


def clamped(a0: Column, a1: Column, size: Column) -> tuple[Column, Column]:
    """An interval inside 0..size; a strip along the edge if it lies wholly past that edge."""
    c0, c1 = (F.least(F.greatest(a, F.lit(0.0)), size) for a in (a0, a1))
    after, before = a0 >= size, a1 <= 0
    strip = (c1 - c0 < STRIP) & (after | before)
    return F.when(strip, F.when(after, size - STRIP).otherwise(F.lit(0.0))).otherwise(c0), F.when(strip, F.when(after, size).otherwise(F.lit(STRIP))).otherwise(c1)


def overlay_box(r, technique: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """(the box to draw inside the page, to a tenth of a point, whether the text leaves the page)."""
    x, y = clamped(r[0], r[2], width), clamped(r[1], r[3], height)
    off = (technique == "off_page") | (r[0] < 0) | (r[1] < 0) | (r[2] > width) | (r[3] > height)
    return F.struct(*[F.bround(c, 1).alias(n) for c, n in ((x[0], "x0"), (y[0], "y0"), (x[1], "x1"), (y[1], "y1"))]), off


def upper_median(samples: Column) -> Column:
    """Of an array of r, g, b structs the middle one by brightness sum, the later of two; order of sampling on ties; null if empty."""
    keyed = F.transform(samples, lambda s, i: F.struct((s["r"] + s["g"] + s["b"]).alias("sum"), i.alias("at"), s.alias("rgb")))
    return F.get(F.array_sort(keyed), (F.size(samples) / 2).cast("int"))["rgb"]


def token_cap(n: Column, base: int = 100, each: int = 120, most: int | None = 4096) -> Column:
    cap = base + each * n
    return cap if most is None else F.least(cap, F.lit(most))


def too_large(size: Column) -> Column:
    return size > MAX_UPLOAD

