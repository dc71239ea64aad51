"""Boxes as four double columns, and what is computed from them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    def struct(self) -> Column:
        return F.struct(*(c.alias(n) for n, c in zip(self._fields, self, strict=True)))

    @classmethod
    def of(cls, column: str | Column | None = None, suffix: str = "") -> Box:
        """Of a struct column, or of the columns x1..y2 (with a suffix)."""
        if column is None:
            return cls(*(F.col(n + suffix) for n in cls._fields))
        column = F.col(column) if isinstance(column, str) else column
        return cls(*(column[n] for n in cls._fields))


def _num(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def width(b: Box) -> Column:
    return F.greatest(b.x2 - b.x1, F.lit(0.0))


def height(b: Box) -> Column:
    return F.greatest(b.y2 - b.y1, F.lit(0.0))


def area(b: Box) -> Column:
    return width(b) * height(b)


def center(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2


def diagonal(b: Box) -> Column:
    return F.sqrt(width(b) * width(b) + height(b) * height(b))


def distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = center(a), center(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def scaled(b: Box, sx: float | Column, sy: float | Column) -> Box:
    return Box(b.x1 * _num(sx), b.y1 * _num(sy), b.x2 * _num(sx), b.y2 * _num(sy))


def integer_bounds(b: Box) -> Box:
    return Box(F.floor(b.x1), F.floor(b.y1), F.ceil(b.x2), F.ceil(b.y2))


def clipped(b: Box, frame_width: float | Column, frame_height: float | Column) -> Box:
    """Inverted corners are put right first; a negative frame size is an error."""
    w, h = (F.when(_num(s) < 0, F.raise_error(F.lit("negative frame size")).cast("double")).otherwise(_num(s)) for s in (frame_width, frame_height))
    into = lambda x, most: F.least(F.greatest(x, F.lit(0.0)), most)
    return Box(into(F.least(b.x1, b.x2), w), into(F.least(b.y1, b.y2), h), into(F.greatest(b.x1, b.x2), w), into(F.greatest(b.y1, b.y2), h))


def union(a: Box, b: Box) -> Box:
    return Box(F.least(a.x1, b.x1), F.least(a.y1, b.y1), F.greatest(a.x2, b.x2), F.greatest(a.y2, b.y2))


def iou(a: Box, b: Box) -> Column:
    """Zero for disjoint and for degenerate boxes."""
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    shared = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    whole = area(a) + area(b) - shared
    return F.when((shared > 0) & (whole > 0), shared / whole).otherwise(0.0)


def expanded(b: Box, margin: float | Column, frame_width: float | Column, frame_height: float | Column) -> Box:
    dx, dy = width(b) * _num(margin), height(b) * _num(margin)
    return clipped(Box(b.x1 - dx, b.y1 - dy, b.x2 + dx, b.y2 + dy), frame_width, frame_height)


def mapped(b: Box, from_size: tuple, to_size: tuple) -> Box:
    """Between two resolutions, clipped to the second; sizes that are not positive are an error."""
    (fw, fh), (tw, th) = ([_num(s) for s in size] for size in (from_size, to_size))
    bad = (fw <= 0) | (fh <= 0) | (tw <= 0) | (th <= 0)
    sure = lambda x: F.when(bad, F.raise_error(F.lit("frame sizes must be positive")).cast("double")).otherwise(x)
    return clipped(scaled(b, sure(tw / fw), sure(th / fh)), tw, th)


def crop_rectangle(b: Box, margin: float | Column, frame_width: int | Column, frame_height: int | Column) -> Column:
    """The integer rectangle around an expanded box: struct x1, y1, x2, y2, is_empty. Its corner is the origin of
    points found inside it."""
    w, h = _num(frame_width), _num(frame_height)
    r = integer_bounds(expanded(b, margin, w, h))
    into = lambda x, most: F.least(F.greatest(x, F.lit(0)), most.cast("long"))
    r = Box(into(r.x1, w), into(r.y1, h), into(r.x2, w), into(r.y2, h))
    return F.struct(*(c.alias(n) for n, c in zip(Box._fields, r, strict=True)), ((r.x2 <= r.x1) | (r.y2 <= r.y1)).alias("is_empty"))


def usable(b: Box, frame_width: int | Column, frame_height: int | Column, least: int = 1) -> Column:
    """Finite corners that leave at least so many pixels in both directions after clamping."""
    r = crop_rectangle(b, 0.0, frame_width, frame_height)
    fine = F.lit(True)
    for c in b:
        fine = fine & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return fine & (r["x2"] - r["x1"] >= least) & (r["y2"] - r["y1"] >= least)


def on_edge(x: Column, y: Column, a: Column, b: Column) -> Column:
    """Whether a point lies on the edge from a to b (structs of x, y)."""
    cross = (y - a["y"]) * (b["x"] - a["x"]) - (x - a["x"]) * (b["y"] - a["y"])
    along = (x - a["x"]) * (x - b["x"]) + (y - a["y"]) * (y - b["y"])
    return (F.abs(cross) <= EPSILON) & (along <= EPSILON)


def crosses(x: Column, y: Column, a: Column, b: Column) -> Column:
    """Whether the line from a point to the right crosses the edge from a to b."""
    hit = ((b["y"] > y) != (a["y"] > y)) & (x < (a["x"] - b["x"]) * (y - b["y"]) / F.nullif(a["y"] - b["y"], F.lit(0.0)) + b["x"])
    return F.coalesce(hit, F.lit(False))


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Even-odd rule over an array of struct<x, y>; a point on an edge is inside."""
    before = F.concat(F.slice(points, -1, 1), F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))))
    edges = F.zip_with(before, points, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    odd = F.aggregate(edges, F.lit(False), lambda inside, e: inside != crosses(x, y, e["a"], e["b"]))
    return F.exists(edges, lambda e: on_edge(x, y, e["a"], e["b"])) | odd
