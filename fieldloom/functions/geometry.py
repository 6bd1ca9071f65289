"""Boxes on a page as column expressions.  A box is a struct (l, t, r, b) in points with the origin at the bottom left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slack of a direction test: half the label's side, at least this many points.
LEAST_SLACK = 2.0


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(*[x.cast("double").alias(n) for x, n in zip((left, top, right, bottom), "ltrb", strict=True)])


def center_x(b: Column) -> Column:
    return (b["l"] + b["r"]) / 2


def center_y(b: Column) -> Column:
    return (b["t"] + b["b"]) / 2


def width(b: Column) -> Column:
    return b["r"] - b["l"]


def height(b: Column) -> Column:
    return F.abs(b["t"] - b["b"])


def _ranges_meet(a_low: Column, a_high: Column, b_low: Column, b_high: Column, slack: Column) -> Column:
    return F.greatest(a_low, b_low) - slack < F.least(a_high, b_high) + slack


def vertical_overlap(a: Column, b: Column, slack: Column) -> Column:
    return _ranges_meet(F.least(a["t"], a["b"]), F.greatest(a["t"], a["b"]), F.least(b["t"], b["b"]), F.greatest(b["t"], b["b"]), slack)


def horizontal_overlap(a: Column, b: Column, slack: Column) -> Column:
    return _ranges_meet(a["l"], a["r"], b["l"], b["r"], slack)


def same_row(label: Column, value: Column) -> Column:
    return vertical_overlap(label, value, F.greatest(height(label) * 0.5, F.lit(LEAST_SLACK)))


def same_column(label: Column, value: Column) -> Column:
    return horizontal_overlap(label, value, F.greatest(width(label) * 0.5, F.lit(LEAST_SLACK)))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(center_x(a) - center_x(b), center_y(a) - center_y(b))


def overlap(a: Column, b: Column) -> Column:
    """Whether two boxes share a point."""
    top, low = lambda x: F.greatest(x["t"], x["b"]), lambda x: F.least(x["t"], x["b"])
    return (a["r"] >= b["l"]) & (b["r"] >= a["l"]) & (top(a) >= low(b)) & (top(b) >= low(a))


def lies(direction: Column | str, label: Column, value: Column) -> Column:
    """Whether ``value`` lies right of, left of, below or above ``label``; a direction given as text costs one test."""
    tests = {
        "right": lambda: (center_x(value) > center_x(label)) & same_row(label, value),
        "left": lambda: (center_x(value) < center_x(label)) & same_row(label, value),
        "below": lambda: (center_y(value) < center_y(label)) & same_column(label, value),
        "above": lambda: (center_y(value) > center_y(label)) & same_column(label, value),
    }
    if isinstance(direction, str):
        return tests[direction]() if direction in tests else F.lit(False)
    out = None
    for name, test in tests.items():
        out = (F if out is None else out).when(direction == name, test())
    return out.otherwise(F.lit(False))
