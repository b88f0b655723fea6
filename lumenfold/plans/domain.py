"""Sampling domains: continuous leaves under nested discrete axes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass


@dataclass(frozen=True)
class Continuous:
    dims: int


@dataclass(frozen=True)
class Discrete:
    axis: str
    branches: tuple[tuple[int, Domain], ...]


Domain = Continuous | Discrete


def rectangular(continuous: int, discrete: int = 0) -> Domain:
    """``discrete`` nested axes of one branch each over a continuous leaf."""
    out: Domain = Continuous(continuous)
    for level in reversed(range(discrete)):
        out = Discrete(f"axis_{level}", ((0, out),))
    return out


def nested(axes: list[tuple[str, int]], dims: int) -> Domain:
    """A full tree: every branch of an axis holds the next axis, the last one the continuous leaf."""
    if not axes:
        return Continuous(dims)
    (label, count), rest = axes[0], axes[1:]
    return Discrete(label, tuple((i, nested(rest, dims)) for i in range(count)))


def leaves(domain: Domain, path: tuple[int, ...] = (), labels: tuple[str, ...] = ()) -> Iterator[tuple[tuple[int, ...], tuple[str, ...], int]]:
    """(path, axis labels, dims) of every continuous leaf: the flat form that joins use."""
    if isinstance(domain, Continuous):
        yield path, labels, domain.dims
        return
    for index, branch in domain.branches:
        yield from leaves(branch, (*path, index), (*labels, domain.axis))


def fixed_continuous_dims(domain: Domain) -> int | None:
    dims = {d for _, _, d in leaves(domain)}
    return dims.pop() if len(dims) == 1 else None


def fixed_discrete_depth(domain: Domain) -> int | None:
    """Discrete axes above every leaf, if that is one number; an axis without branches counts itself."""
    if isinstance(domain, Continuous):
        return 0
    below = {fixed_discrete_depth(b) for _, b in domain.branches} or {0}
    depth = below.pop()
    return None if below or depth is None else depth + 1


def fixed_rectangular_dims(domain: Domain) -> tuple[int, int] | None:
    c, d = fixed_continuous_dims(domain), fixed_discrete_depth(domain)
    return None if c is None or d is None else (c, d)


def to_json(domain: Domain) -> dict:
    if isinstance(domain, Continuous):
        return {"kind": "continuous", "dims": domain.dims}
    return {"kind": "discrete", "axis_label": domain.axis, "branches": [{"index": i, "domain": to_json(b)} for i, b in domain.branches]}


def from_json(spec: dict) -> Domain:
    if spec["kind"] == "continuous":
        return Continuous(int(spec["dims"]))
    return Discrete(spec["axis_label"], tuple((int(b["index"]), from_json(b["domain"])) for b in spec["branches"]))
