"""Boxes as structs of floats: column functions.

Arithmetic stays in FLOAT: Spark divides floats as doubles, so quotients are cast back, which rounds to the same value as
a division in single precision. Boxes have their origin at the top left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.schema import BBOX


def f32(value: float | Column) -> Column:
    return (value if isinstance(value, Column) else F.lit(float(value))).cast("float")


def raw_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")).cast(BBOX)


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box whose corners are put in order."""
    return raw_box(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))


def from_array(a: Column) -> Column:
    """A box from its wire form [x0, y0, x1, y1]."""
    return box(*(f32(F.get(a, F.lit(i))) for i in range(4)))


def to_array(b: Column) -> Column:
    return F.array(b["x0"], b["y0"], b["x1"], b["y1"])


def width(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], f32(0))


def height(b: Column) -> Column:
    return F.greatest(b["y1"] - b["y0"], f32(0))


def area(b: Column) -> Column:
    return width(b) * height(b)


def center_x(b: Column) -> Column:
    return (b["x0"] + b["x1"]) * f32(0.5)


def center_y(b: Column) -> Column:
    return (b["y0"] + b["y1"]) * f32(0.5)


def intersection(a: Column, b: Column) -> Column:
    """The common box; null unless it has both width and height."""
    x0, y0 = F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"])
    x1, y1 = F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])
    return F.when((x0 < x1) & (y0 < y1), raw_box(x0, y0, x1, y1))


def common_area(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(f32(0))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, f32(part / F.when(whole > 0, whole))).otherwise(f32(0))


def iou(a: Column, b: Column) -> Column:
    both = common_area(a, b)
    return _share(both, area(a) + area(b) - both)


def overlap_ratio(a: Column, b: Column) -> Column:
    """The share of ``a`` that ``b`` covers; 0 for an empty ``a``."""
    return _share(common_area(a, b), area(a))


def smaller_overlap(a: Column, b: Column) -> Column:
    """The common area's share of the smaller box."""
    return _share(common_area(a, b), F.least(area(a), area(b)))


def y_overlap_ratio(a: Column, b: Column) -> Column:
    """The common height's share of the lower box."""
    both = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when(both <= 0, f32(0)).otherwise(_share(both, F.least(height(a), height(b))))


def vertical_gap(a: Column, b: Column) -> Column:
    return F.least(F.abs(b["y0"] - a["y1"]), F.abs(a["y0"] - b["y1"]))


def union(a: Column, b: Column) -> Column:
    return raw_box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def union_all(boxes: Column) -> Column:
    """The box around an array of boxes; the zero box for none."""
    end = lambda f, name: f(F.transform(boxes, lambda b: b[name]))
    around = raw_box(end(F.array_min, "x0"), end(F.array_min, "y0"), end(F.array_max, "x1"), end(F.array_max, "y1"))
    return F.when(F.size(boxes) > 0, around).otherwise(raw_box(*[f32(0)] * 4))


def center_distance_sq(a: Column, b: Column) -> Column:
    dx, dy = center_x(a) - center_x(b), center_y(a) - center_y(b)
    return dx * dx + dy * dy


def scale(b: Column, factor: Column | float) -> Column:
    k = f32(factor)
    return box(b["x0"] * k, b["y0"] * k, b["x1"] * k, b["y1"] * k)


def offset(b: Column, dx: Column | float, dy: Column | float) -> Column:
    return box(b["x0"] + f32(dx), b["y0"] + f32(dy), b["x1"] + f32(dx), b["y1"] + f32(dy))


def denormalize(b: Column, w: Column, h: Column) -> Column:
    """From shares of a page's sides to its units."""
    return box(b["x0"] * f32(w), b["y0"] * f32(h), b["x1"] * f32(w), b["y1"] * f32(h))


def to_thousandths(b: Column, w: Column, h: Column) -> Column:
    """[x0, y0, x1, y1] as whole thousandths of the page's sides, cut toward zero; null for a page without extent."""

    def part(v: Column, side: Column) -> Column:
        x = f32(v * f32(1000)) / F.when(side > 0, side)
        return F.least(F.greatest(f32(x).cast("double"), F.lit(-2147483648.0)), F.lit(2147483647.0)).cast("int")

    w, h = f32(w), f32(h)
    return F.when((w > 0) & (h > 0), F.array(part(b["x0"], w), part(b["y0"], h), part(b["x1"], w), part(b["y1"], h)))


def from_thousandths(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Shares of the sides from whole thousandths; null if one lies outside 0 to 1000 or the box is empty."""
    inside = reduce(lambda x, y: x & y, [v.between(0, 1000) for v in (a, b, c, d)])
    part = lambda v: f32(f32(v) / f32(1000))
    return F.when(inside & (a != c) & (b != d), box(part(a), part(b), part(c), part(d)))


def from_center(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    half = f32(0.5)
    return raw_box(cx - half * w, cy - half * h, cx + half * w, cy + half * h)


def quad_box(points: Column) -> Column:
    """The box around an array of (x, y) points."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return raw_box(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))


def flat_quad_box(values: Column) -> Column:
    """The box around [x0, y0, x1, y1, ...]: even places are x, odd ones y."""
    lane = lambda k: F.filter(values, lambda v, i: i % 2 == k)
    return raw_box(F.array_min(lane(0)), F.array_min(lane(1)), F.array_max(lane(0)), F.array_max(lane(1)))


def page_to_top_left(left: Column, bottom: Column, right: Column, top: Column, page_height: Column) -> Column:
    """A box with its origin at the bottom left, turned about the page's height rounded up."""
    h = f32(F.ceil(F.abs(page_height)))
    return box(left, h - top, right, h - bottom)


def structure_box(b: Column, w: Column, h: Column, side: int = 488) -> Column:
    """A box of a structure model's padded frame in the frame's longer side's scale."""
    w, h = f32(w), f32(h)
    ratio = F.least(f32(f32(side) / h), f32(f32(side) / w))
    kx, ky = f32(f32(side) / (w * ratio)), f32(f32(side) / (h * ratio))
    return box(b["x0"] * kx, b["y0"] * ky, b["x1"] * kx, b["y1"] * ky)


def corner_distance(a: Column, b: Column) -> Column:
    """Sum of the four corners' moves plus the smaller of the upper-left and lower-right ones, in doubles."""
    d = lambda k: F.abs(b[k].cast("double") - a[k].cast("double"))
    first, last = d("x0") + d("y0"), d("x1") + d("y1")
    return d("x0") + d("y0") + d("x1") + d("y1") + F.least(first, last)


def iou_double(a: Column, b: Column) -> Column:
    """Intersection over union in doubles; touching boxes have 0."""
    v = lambda c, k: c[k].cast("double")
    top, bottom = F.greatest(v(a, "y0"), v(b, "y0")), F.least(v(a, "y1"), v(b, "y1"))
    left, right = F.greatest(v(a, "x0"), v(b, "x0")), F.least(v(a, "x1"), v(b, "x1"))
    own = lambda c: (v(c, "x1") - v(c, "x0")) * (v(c, "y1") - v(c, "y0"))
    both = (bottom - top) * (right - left)
    whole = own(a) + own(b) - both
    return F.when((top >= bottom) | (left >= right) | (whole == 0), F.lit(0.0)).otherwise(both / F.when(whole != 0, whole))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return f32(F.sqrt(((bx - ax) * (bx - ax) + (by - ay) * (by - ay)).cast("double")))


def _edges(points: Column) -> Column:
    """Each point with the next, the last with the first."""
    n = F.size(points)
    return F.transform(points, lambda p, i: F.struct(p.alias("a"), F.element_at(points, (i + 1) % n + 1).alias("b")))


def polygon_area(points: Column) -> Column:
    twice = F.aggregate(_edges(points), f32(0), lambda s, e: f32(s + f32(e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])))
    return F.abs(twice * f32(0.5))


def polygon_perimeter(points: Column) -> Column:
    return F.aggregate(_edges(points), f32(0), lambda s, e: f32(s + distance(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])))


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Even-odd rule."""

    def crosses(e: Column) -> Column:
        (xi, yi), (xj, yj) = (e["b"]["x"], e["b"]["y"]), (e["a"]["x"], e["a"]["y"])
        at = f32(((xj - xi) * (y - yi)) / F.when(yj != yi, yj - yi)) + xi
        return F.coalesce(((yi > y) != (yj > y)) & (x < at), F.lit(False))

    return F.aggregate(_edges(points), F.lit(False), lambda inside, e: inside != crosses(e))


def line_through(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """a, b, c of the line a x + b y + c = 0 through two points."""
    return F.struct((y2 - y1).alias("a"), (x1 - x2).alias("b"), (x2 * y1 - x1 * y2).alias("c"))


def side_of_line(line: Column, x: Column, y: Column) -> Column:
    return line["a"] * x + line["b"] * y + line["c"]


def ordered_corners(points: Column) -> Column:
    """Four corners as upper left, upper right, lower right, lower left: the two left ones by height, then the two right ones."""
    by_x = F.array_sort(points, lambda p, q: F.when(p["x"] < q["x"], -1).when(p["x"] > q["x"], 1).otherwise(0))
    a, b, c, d = (F.element_at(by_x, i) for i in range(1, 5))
    left = F.when(a["y"] <= b["y"], F.struct(a.alias("u"), b.alias("l"))).otherwise(F.struct(b.alias("u"), a.alias("l")))
    right = F.when(c["y"] <= d["y"], F.struct(c.alias("u"), d.alias("l"))).otherwise(F.struct(d.alias("u"), c.alias("l")))
    return F.array(left["u"], right["u"], right["l"], left["l"])


def kernel_length(side: Column) -> Column:
    return (F.sqrt(side.cast("double")) * 1.2).cast("int")


def sigmoid(x: Column) -> Column:
    """In single precision as far as built-in functions reach."""
    return f32(f32(1) / (f32(1) + f32(F.exp(-x.cast("double")))))


def round4(x: Column) -> Column:
    return f32(F.round(f32(x * f32(10_000)).cast("double")) / 10_000.0)
