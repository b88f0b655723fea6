"""Coordinate transforms of points; each multiplies the weight by its Jacobian."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]


def _checked(points: DataFrame, dims: int, closed: bool) -> Column:
    """The coordinates, or an error for a point of another dimension or outside the unit cube."""
    c = F.col("continuous")
    inside = F.forall(c, lambda x: (x >= 0) & ((x <= 1) if closed else (x < 1)))
    good = (F.size(c) == dims) & inside
    return F.when(good, c).otherwise(F.raise_error(F.lit(f"expected {dims} coordinates in the unit interval")).cast("array<double>"))


def spherical(points: DataFrame) -> DataFrame:
    """The unit cube to all of space in spherical coordinates."""
    rows = points.withColumn("_c", _checked(points, 3, closed=False))
    u, v, w = (F.col("_c")[i] for i in range(3))
    r = u / (1 - u)
    cos = 2 * v - 1
    sin = F.sqrt(F.greatest(F.lit(0.0), 1 - cos * cos))
    phi = 2 * math.pi * w
    jacobian = 4 * math.pi * r * r / ((1 - u) * (1 - u))
    at = F.array(r * sin * F.cos(phi), r * sin * F.sin(phi), r * cos)
    return rows.withColumn("continuous", at).withColumn("weight", F.col("weight") * jacobian).drop("_c")


def unit_ball(points: DataFrame, dims: int) -> DataFrame:
    """The unit cube to the unit ball in hyperspherical coordinates."""
    rows = points.withColumn("_c", _checked(points, dims, closed=True))
    u = [F.col("_c")[i] for i in range(dims)]
    if dims == 1:
        return rows.withColumn("continuous", F.array(2 * u[0] - 1)).withColumn("weight", F.col("weight") * 2.0).drop("_c")
    r = u[0]
    angles = [(2 * math.pi if k == dims - 2 else math.pi) * x for k, x in enumerate(u[1:])]
    jacobian = F.lit(2 * math.pi ** (dims - 1)) * F.pow(r, F.lit(float(dims - 1)))
    at, sines = [], r
    for k, a in enumerate(angles):
        at.append(sines * F.cos(a))
        sines = sines * F.sin(a)
        if k < dims - 2:
            jacobian = jacobian * F.pow(F.sin(a), F.lit(float(dims - 2 - k)))
    return rows.withColumn("continuous", F.array(*at, sines)).withColumn("weight", F.col("weight") * jacobian).drop("_c")


def chain(points: DataFrame, transforms: list[Transform]) -> DataFrame:
    """The transforms one after another; none leaves the points as they are."""
    return reduce(lambda df, t: t(df), transforms, points)


def build(specs: list[dict], dims: int) -> list[Transform]:
    """Transforms from their settings (``kind``)."""
    known = {"spherical": spherical, "unit_ball": lambda df: unit_ball(df, dims)}
    unknown = [s["kind"] for s in specs if s["kind"] not in known]
    if unknown:
        raise ValueError(f"unknown transforms: {unknown}")
    if any(s["kind"] == "spherical" for s in specs) and dims != 3:
        raise ValueError("the spherical transform needs three dimensions")
    return [known[s["kind"]] for s in specs]
