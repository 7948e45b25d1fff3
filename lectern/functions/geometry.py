"""Boxes on a page. A box is four columns or an array [x0, y0, x1, y1]; fractions of the page unless said otherwise."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(box: Column, i: int) -> Column:
    return F.get(box, F.lit(i))


def poly_to_box(poly: Column) -> Column:
    """Bounding box of an array of [x, y] points."""
    xs, ys = F.transform(poly, lambda p: F.get(p, F.lit(0))), F.transform(poly, lambda p: F.get(p, F.lit(1)))
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def iou(a: Column, b: Column) -> Column:
    ax0, ay0, ax1, ay1 = (_part(a, i) for i in range(4))
    bx0, by0, bx1, by1 = (_part(b, i) for i in range(4))
    ix = F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0))
    iy = F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))
    union = (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - ix * iy
    return F.when(union > 0, ix * iy / union).otherwise(F.lit(0.0))


def center_in(a: Column, b: Column, pad: float = 0.02) -> Column:
    cx, cy = (_part(a, 0) + _part(a, 2)) / 2, (_part(a, 1) + _part(a, 3)) / 2
    return cx.between(_part(b, 0) - pad, _part(b, 2) + pad) & cy.between(_part(b, 1) - pad, _part(b, 3) + pad)


def overlaps(a: Column, b: Column) -> Column:
    return (iou(a, b) >= 0.2) | center_in(b, a) | center_in(a, b)


def expand_region(box: Column, pad: float = 0.02, min_w: float = 0.25, min_h: float = 0.05) -> Column:
    """The box with a margin, at least min_w by min_h of the page, moved back inside the page."""
    def grow(lo: Column, hi: Column, least: float) -> tuple[Column, Column]:
        lo, hi = lo - pad, hi + pad
        mid = (lo + hi) / 2
        small = (hi - lo) < least
        return F.when(small, mid - least / 2).otherwise(lo), F.when(small, mid + least / 2).otherwise(hi)

    x0, x1 = grow(_part(box, 0), _part(box, 2), min_w)
    y0, y1 = grow(_part(box, 1), _part(box, 3), min_h)
    zero = F.lit(0.0)
    dx = F.greatest(zero, -x0) - F.greatest(zero, x1 - 1)
    dy = F.greatest(zero, -y0) - F.greatest(zero, y1 - 1)
    sides = (F.greatest(zero, x0 + dx), F.greatest(zero, y0 + dy), F.least(F.lit(1.0), x1 + dx), F.least(F.lit(1.0), y1 + dy))
    return F.array(*[F.bround(F.round(v, 8), 4) for v in sides])  # first what addition left at the far end: halves are common here


def normalise_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    def part(v: Column, size: Column) -> Column:
        return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / size)), 4)

    return F.array(part(x0, width), part(y0, height), part(x1, width), part(y1, height))


def parse_box_reply(reply: Column) -> Column:
    """Struct(page, box) from the first ``{... bbox_2d ...}`` object of a reply; NULL when there is none or it is not JSON."""
    raw = F.regexp_extract(F.coalesce(reply, F.lit("")), r"\{[^{}]*bbox_2d[^{}]*\}", 0)
    obj = F.from_json(raw, "page string, bbox_2d array<double>")
    b = obj["bbox_2d"]
    ok = (raw != "") & (F.size(b) >= 4) & ~F.exists(F.slice(b, 1, 4), lambda v: v.isNull())
    x1, y1, x2, y2 = (_part(b, i) for i in range(4))
    return F.when(ok, F.struct(
        obj["page"].try_cast("int").alias("page"),
        F.array(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)).alias("box")))
