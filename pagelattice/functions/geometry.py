"""Rectangle arithmetic as Column expressions.

A rectangle is anything indexable by ``"l" "t" "r" "b"`` that yields Columns: a struct
column, the lambda variable of a higher-order function, or :func:`rect` for flat
columns. One definition therefore serves joins, windows and array folds alike.
Ratios are compared by integer cross multiplication, so no result hangs on float rounding; only rules in mean lengths use doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rect(prefix: str = "") -> dict[str, Column]:
    return {side: F.col(prefix + side) for side in "ltrb"}


def width(a) -> Column:
    return F.greatest(a["r"] - a["l"], F.lit(0))


def height(a) -> Column:
    return F.greatest(a["b"] - a["t"], F.lit(0))


def area(a) -> Column:
    return width(a).cast("long") * height(a)


def center_x(a) -> Column:
    return F.shiftright(a["l"] + a["r"], 1)


def center_y(a) -> Column:
    return F.shiftright(a["t"] + a["b"], 1)


def floor_div(x: Column, n) -> Column:
    return F.floor(x / F.lit(n)).cast("int")


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("int")


def clamp(x: Column, lo, hi) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, as_col(lo)), as_col(hi))


def contains(a, x: Column, y: Column, margin: int = 0, edge: str = "inclusive") -> Column:
    """Point in rectangle; ``edge='exclusive'`` leaves the right and bottom side out."""
    low = (x >= a["l"] - margin) & (y >= a["t"] - margin)
    if edge == "exclusive":
        return low & (x < a["r"] + margin) & (y < a["b"] + margin)
    return low & (x <= a["r"] + margin) & (y <= a["b"] + margin)


def holds_center(outer, inner, margin: int = 0, edge: str = "inclusive") -> Column:
    return contains(outer, center_x(inner), center_y(inner), margin, edge)


def overlap_x(a, b) -> Column:
    return F.greatest(F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"]), F.lit(0))


def overlap_y(a, b) -> Column:
    return F.greatest(F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"]), F.lit(0))


def intersection(a, b) -> Column:
    return overlap_x(a, b).cast("long") * overlap_y(a, b)


def gap_x(a, b) -> Column:
    return F.greatest(F.greatest(a["l"], b["l"]) - F.least(a["r"], b["r"]), F.lit(0))


def gap_y(a, b) -> Column:
    return F.greatest(F.greatest(a["t"], b["t"]) - F.least(a["b"], b["b"]), F.lit(0))


def center_dx(a, b) -> Column:
    return F.abs(center_x(a) - center_x(b))


def center_dy(a, b) -> Column:
    return F.abs(center_y(a) - center_y(b))


def center_dist2(a, b) -> Column:
    dx, dy = center_dx(a, b).cast("long"), center_dy(a, b).cast("long")
    return dx * dx + dy * dy


def min_area(a, b) -> Column:
    return F.least(area(a), area(b))


def ratio_over(num: Column, den: Column, percent: int) -> Column:
    """``num/den > percent %`` for non-negative integers, false when den is 0."""
    return (den > 0) & (num * 100 > den * percent)


def ratio_at_least(num: Column, den: Column, percent: int) -> Column:
    return (den > 0) & (num * 100 >= den * percent)


def iou_over(a, b, percent: int) -> Column:
    inter = intersection(a, b)
    return ratio_over(inter, area(a) + area(b) - inter, percent)


def containment_over(a, b, percent: int) -> Column:
    """Intersection over the smaller rectangle."""
    return ratio_over(intersection(a, b), min_area(a, b), percent)


def covered_at_least(a, b, percent: int) -> Column:
    """At least ``percent`` % of ``a`` lies inside ``b``."""
    return ratio_at_least(intersection(a, b), area(a), percent)


def same_rect(a, b) -> Column:
    return (a["l"] == b["l"]) & (a["t"] == b["t"]) & (a["r"] == b["r"]) & (a["b"] == b["b"])


def union_rect(a, b) -> dict[str, Column]:
    return {
        "l": F.least(a["l"], b["l"]), "t": F.least(a["t"], b["t"]),
        "r": F.greatest(a["r"], b["r"]), "b": F.greatest(a["b"], b["b"]),
    }
