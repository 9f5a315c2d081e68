"""Plane geometry of page corners and what image tools print: the parts of page clean-up that are plain arithmetic or text. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sort_corners(points: Column) -> Column:
    """Four points (x, y) as top-left, top-right, bottom-right, bottom-left: by the sum and the difference of their coordinates."""
    by = lambda f, end: F.element_at(F.array_sort(F.transform(points, lambda p: F.struct(f(p).alias("k"), p.alias("p")))), end)["p"]
    total, diff = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(by(total, 1), by(diff, 1), by(total, -1), by(diff, -1))


def rectangularity(corners: Column) -> Column:
    """1 for a rectangle, less by how far its four angles are from 90 degrees: 1 - min(sum / 180, 1). Corners in order."""

    def angle(p, i):
        at = lambda k: F.get(corners, F.pmod(i + k, F.lit(4)))
        ax, ay, bx, by = at(-1)["x"] - p["x"], at(-1)["y"] - p["y"], at(1)["x"] - p["x"], at(1)["y"] - p["y"]
        size = F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by))
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(ax * bx + ay * by, F.nullif(size, F.lit(0.0))), F.lit(1.0))))))

    off = F.aggregate(F.transform(corners, lambda p, i: F.abs(angle(p, i) - 90)), F.lit(0.0), lambda a, v: a + v)
    return 1 - F.least(off / 180, F.lit(1.0))


def orientation(text: Column, least: float = 0.5) -> Column:
    """Degrees from an orientation report; null if it is not confident enough."""
    sure = F.regexp_extract(text, r"Orientation confidence:\s*([\d.]+)", 1).try_cast("double")
    return F.when(sure >= least, F.regexp_extract(text, r"Orientation in degrees:\s*(\d+)", 1).try_cast("int"))


def page_count(text: Column) -> Column:
    return F.regexp_extract(text, r"Pages:\s*(\d+)", 1).try_cast("int")
