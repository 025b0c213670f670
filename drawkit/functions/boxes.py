"""Boxes (x, y, w, h) in page units of 0 to 1, and corner boxes (x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def center(x: Column, w: Column) -> Column:
    """G2."""
    return x + w / 2


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def intersection(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area that two boxes share."""
    return overlap(a["x"], a["x"] + a["w"], b["x"], b["x"] + b["w"]) * overlap(a["y"], a["y"] + a["h"], b["y"], b["y"] + b["h"])


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Shared area over joint area; 0 for empty boxes."""
    shared = intersection(a, b)
    joint = a["w"] * a["h"] + b["w"] * b["h"] - shared
    return F.when(joint > 0, shared / joint).otherwise(0.0)


def overlap_ratio(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Shared area over the smaller area."""
    smaller = F.least(a["w"] * a["h"], b["w"] * b["h"])
    return F.when(smaller > 0, intersection(a, b) / smaller).otherwise(0.0)


def box(alias: str) -> dict[str, Column]:
    return {k: F.col(f"{alias}.{k}") for k in ("x", "y", "w", "h")}


def union_box() -> list[Column]:
    """A10: aggregates that give the envelope of a group of boxes."""
    x0, y0 = F.min("x"), F.min("y")
    rounded = lambda c, name: F.coalesce(F.round(c, 6), F.lit(0.0)).alias(name)
    return [rounded(x0, "x"), rounded(y0, "y"), rounded(F.max(F.col("x") + F.col("w")) - x0, "w"), rounded(F.max(F.col("y") + F.col("h")) - y0, "h")]


def parse_bbox(values: Column) -> Column:
    """Four numbers as a corner box, anything else as null."""
    n = [F.get(values, F.lit(i)).try_cast("double") for i in range(4)]
    ok = (F.size(values) == 4) & n[0].isNotNull() & n[1].isNotNull() & n[2].isNotNull() & n[3].isNotNull()
    return F.when(ok, F.struct(*(c.alias(k) for c, k in zip(n, ("x0", "y0", "x1", "y1"), strict=True))))


def polygon_box(points: Column, width: Column, height: Column) -> Column:
    """G1: the box of a polygon's points, normalised by the page, to 8 places."""
    xs, ys = F.transform(points, lambda p: p["px"]), F.transform(points, lambda p: p["py"])
    part = lambda c, by, name: F.round(c / by, 8).alias(name)
    return F.struct(part(F.array_min(xs), width, "x"), part(F.array_min(ys), height, "y"), part(F.array_max(xs) - F.array_min(xs), width, "w"), part(F.array_max(ys) - F.array_min(ys), height, "h"))
