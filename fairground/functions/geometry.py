"""Boxes, points and rectangles as column expressions."""

from __future__ import annotations

from math import cos, radians, sin

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(x1, y1, x2, y2) -> Column:
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))


def iou(a: tuple, b: tuple) -> Column:
    """Intersection over union of two boxes of four columns each; 0 without an area."""
    both = area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    union = area(*a) + area(*b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def foot_point(x1, y1, x2, y2, width, height) -> tuple[Column, Column]:
    """The middle of a box's lower edge, as a share of the frame."""
    return (x1 + x2) / 2 / width, y2 / height


def side_of(px, py, line: tuple[float, float, float, float]) -> Column:
    """Signed distance of a point from the infinite line through two points; null for no line."""
    x1, y1, x2, y2 = line
    length = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
    if length == 0:
        return F.lit(None).cast("double")
    return ((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) / length


def touches_line(x1, y1, x2, y2, line: tuple[float, float, float, float]) -> Column:
    """Whether the infinite line through two points cuts a box: its corners lie on both sides."""
    sides = [side_of(px, py, line) for px in (x1, x2) for py in (y1, y2)]
    return F.coalesce((F.least(*sides) < 0) & (F.greatest(*sides) > 0), F.lit(False))


def in_rectangle(px, py, x: float, y: float, width: float, height: float, rotation: float = 0.0) -> Column:
    """Whether a point is in a rectangle that is turned about its centre by so many degrees."""
    cx, cy, turn = x + width / 2, y + height / 2, radians(-rotation)
    rx = (px - cx) * cos(turn) - (py - cy) * sin(turn)
    ry = (px - cx) * sin(turn) + (py - cy) * cos(turn)
    return (F.abs(rx) <= width / 2) & (F.abs(ry) <= height / 2)


def edge_distance(px, py, x: float, y: float, width: float, height: float) -> Column:
    """From a point to a rectangle as it would stand without rotation; 0 inside."""
    dx = F.greatest(F.lit(x) - px, F.lit(0.0), px - (x + width))
    dy = F.greatest(F.lit(y) - py, F.lit(0.0), py - (y + height))
    return F.sqrt(dx * dx + dy * dy)


def project(px, py, h: list[list[float]]) -> tuple[Column, Column]:
    """A 3 x 3 homography applied to a point."""
    w = px * h[2][0] + py * h[2][1] + h[2][2]
    return (px * h[0][0] + py * h[0][1] + h[0][2]) / w, (px * h[1][0] + py * h[1][1] + h[1][2]) / w


def cell(x, size: float) -> Column:
    """Index of a grid cell, truncated towards zero."""
    return (x / size).cast("int")
