"""Raster geometries and their checks."""

from __future__ import annotations

import math
from dataclasses import dataclass

PARALLEL = 1e-9


@dataclass(frozen=True)
class Linspace:
    start: float
    stop: float
    count: int

    def check(self) -> None:
        if self.count <= 0:
            raise ValueError("linspace count must be positive")
        if not (math.isfinite(self.start) and math.isfinite(self.stop)):
            raise ValueError("linspace bounds must be finite")


@dataclass(frozen=True)
class LineRaster:
    offset: tuple[float, ...]
    direction: tuple[float, ...]
    linspace: Linspace
    discrete: tuple[int, ...] = ()

    @property
    def points(self) -> int:
        return self.linspace.count

    def check(self) -> None:
        self.linspace.check()
        _check_vectors(self.offset, self.direction)


@dataclass(frozen=True)
class PlaneRaster:
    offset: tuple[float, ...]
    u_vector: tuple[float, ...]
    v_vector: tuple[float, ...]
    u_linspace: Linspace
    v_linspace: Linspace
    discrete: tuple[int, ...] = ()

    @property
    def points(self) -> int:
        return self.u_linspace.count * self.v_linspace.count

    def check(self) -> None:
        self.u_linspace.check()
        self.v_linspace.check()
        _check_vectors(self.offset, self.u_vector, self.v_vector)
        dot = sum(a * b for a, b in zip(self.u_vector, self.v_vector))
        norms = math.sqrt(sum(a * a for a in self.u_vector) * sum(b * b for b in self.v_vector))
        if 1 - abs(dot / norms) <= PARALLEL:
            raise ValueError("plane vectors must not be parallel")


def _check_vectors(offset: tuple[float, ...], *vectors: tuple[float, ...]) -> None:
    if not offset:
        raise ValueError("a geometry needs a dimension")
    for v in vectors:
        if len(v) != len(offset):
            raise ValueError("geometry vectors differ in dimension")
        if not any(v):
            raise ValueError("geometry vectors must not be zero")
    if not all(math.isfinite(x) for v in (offset, *vectors) for x in v):
        raise ValueError("geometry vectors must be finite")
