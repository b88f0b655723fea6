"""Column helpers: finiteness, guarded ratios, complex numbers as structs, vectors as arrays, counter-based uniforms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def is_finite(x: Column) -> Column:
    """False for NaN and infinities, and for null."""
    return F.coalesce(F.abs(x) < F.lit(INF), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def modulus(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def modulus_squared(a: Column) -> Column:
    return a["re"] * a["re"] + a["im"] * a["im"]


def complex_sin(a: Column) -> Column:
    return complex_of(F.sin(a["re"]) * F.cosh(a["im"]), F.cos(a["re"]) * F.sinh(a["im"]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return ratio(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def linspace(index: Column, start: float, stop: float, count: int) -> Column:
    """The ``index``-th of ``count`` evenly spaced values; ``start`` alone if there is at most one."""
    if count <= 1:
        return F.lit(float(start))
    return F.lit(float(start)) + index.cast("double") / F.lit(float(count - 1)) * F.lit(float(stop) - float(start))


def uniform(seed, index: Column, dim) -> Column:
    """A number in [0, 1) that depends on seed, sample and dimension only, so not on how rows are partitioned."""
    key = F.concat_ws(":", F.lit(str(seed)), index.cast("string"), F.lit(str(dim)) if not isinstance(dim, Column) else dim.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def coprime_stride(n: int) -> int:
    """A step near the golden section of ``n`` that is coprime to it, so that multiples of it visit every index once."""
    if n <= 1:
        return 1
    stride = min(max(math.floor(n * 0.6180339887498949), 1), n - 1)
    while math.gcd(stride, n) != 1:
        stride = stride + 1 if stride + 1 < n else 1
    return stride


def permuted(index: Column, n: int) -> Column:
    return index if n <= 1 else (index * F.lit(coprime_stride(n)).cast("bigint")) % F.lit(n).cast("bigint")
