"""Boxes (x0, y0, x1, y1) and one-dimensional spans (start, end) as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def contains(a: Column, x: Column, y: Column) -> Column:
    return (a["x0"] <= x) & (x < a["x1"]) & (a["y0"] <= y) & (y < a["y1"])


def intersects(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def big_enough(a: Column, least: float) -> Column:
    return (a["x1"] - a["x0"] > least) & (a["y1"] - a["y0"] > least)


def unscaled(a: Column, zoom: Column) -> Column:
    return F.struct(*((a[c] / zoom).alias(c) for c in ("x0", "y0", "x1", "y1")))


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)
