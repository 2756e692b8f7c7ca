"""Boxes as Columns: [x0, top, x1, bottom] in points, fractions of a page, or pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.text import _c

#: Dots per inch of rendered crops, page size where none is known (points): fixed values.
DPI, PAGE_W, PAGE_H = 200, 612.0, 792.0


def part(box, i: int) -> Column:
    return F.get(_c(box), F.lit(i))


def area(box) -> Column:
    """0 for empty, inverted and null boxes."""
    b = [part(box, i) for i in range(4)]
    return F.coalesce(F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1]), F.lit(0.0))


def overlap(a, b) -> Column:
    x = [part(a, i) for i in range(4)]
    y = [part(b, i) for i in range(4)]
    return F.greatest(F.lit(0.0), F.least(x[2], y[2]) - F.greatest(x[0], y[0])) * F.greatest(F.lit(0.0), F.least(x[3], y[3]) - F.greatest(x[1], y[1]))


def iou(a, b) -> Column:
    """Intersection over union; null where both boxes are empty."""
    i = overlap(a, b)
    return F.try_divide(i, area(a) + area(b) - i)


def largest_shift(a, b) -> Column:
    return F.greatest(*(F.abs(part(a, i) - part(b, i)) for i in range(4)))


def near(a, b, gap: float) -> Column:
    """Boxes whose gap is at most this in both directions."""
    x = [part(a, i) for i in range(4)]
    y = [part(b, i) for i in range(4)]
    return ~((x[2] + gap < y[0]) | (y[2] + gap < x[0]) | (x[3] + gap < y[1]) | (y[3] + gap < x[1]))


def round4(x: Column) -> Column:
    """Half up at four places, the same in every engine."""
    return F.floor(x * 10000.0 + 0.5).cast("double") / 10000.0


def normalised(box, width, height) -> Column:
    """Fractions of the page: the first corner is held at 0, the second at 1."""
    w, h = _c(width), _c(height)
    return F.when(
        F.size(_c(box)) == 4,
        F.array(
            round4(F.greatest(F.lit(0.0), part(box, 0) / w)),
            round4(F.greatest(F.lit(0.0), part(box, 1) / h)),
            round4(F.least(F.lit(1.0), part(box, 2) / w)),
            round4(F.least(F.lit(1.0), part(box, 3) / h)),
        ),
    )


def in_points(box, width, height) -> Column:
    """A selection in page fractions as points."""
    w, h = _c(width), _c(height)
    return F.array(part(box, 0) * w, part(box, 1) * h, part(box, 2) * w, part(box, 3) * h)


def crop_pixels(box, width=None, height=None, px_w=None, px_h=None) -> Column:
    """struct<nx, ny, nw, nh>: a crop's place and size in the pixels of its own image file; where the file's size is
    not known, at the rendering resolution."""
    w = F.coalesce(_c(width), F.lit(PAGE_W)) if width is not None else F.lit(PAGE_W)
    h = F.coalesce(_c(height), F.lit(PAGE_H)) if height is not None else F.lit(PAGE_H)
    bw = F.greatest((part(box, 2) - part(box, 0)) * w, F.lit(1e-6))
    bh = F.greatest((part(box, 3) - part(box, 1)) * h, F.lit(1e-6))
    k = F.lit(DPI / 72)
    have = (_c(px_w).isNotNull() & _c(px_h).isNotNull()) if px_w is not None else F.lit(False)
    pw = F.when(have, _c(px_w)).otherwise(bw * k) if px_w is not None else bw * k
    ph = F.when(have, _c(px_h)).otherwise(bh * k) if px_h is not None else bh * k
    r2 = lambda x: F.floor(x * 100.0 + 0.5).cast("double") / 100.0  # noqa: E731  (half up, the same in every engine)
    return F.struct(r2(part(box, 0) * w * pw / bw).alias("nx"), r2(part(box, 1) * h * ph / bh).alias("ny"), r2(pw).alias("nw"), r2(ph).alias("nh"))


def valid_selection(box, width=None, height=None, least_points: float = 5.0) -> Column:
    """Four finite numbers from 0 to 1, ordered, and large enough on the page."""
    b = _c(box)
    finite = (F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= 1))
    w = _c(width) if width is not None else F.lit(PAGE_W)
    h = _c(height) if height is not None else F.lit(PAGE_H)
    large = ((F.abs(part(b, 2) - part(b, 0)) * w) >= least_points) & ((F.abs(part(b, 3) - part(b, 1)) * h) >= least_points)
    return F.coalesce(finite & large, F.lit(False))


def ordered(box) -> Column:
    """The box with its corners in order."""
    b = [part(box, i) for i in range(4)]
    return F.array(F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3]))


def centre_inside(inner, outer) -> Column:
    cx = (part(inner, 0) + part(inner, 2)) / 2
    cy = (part(inner, 1) + part(inner, 3)) / 2
    return (cx >= part(outer, 0)) & (cx <= part(outer, 2)) & (cy >= part(outer, 1)) & (cy <= part(outer, 3))
