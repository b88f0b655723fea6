"""Tasks of a run and how a stage finds its sampler, observable and transforms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from lumenfold.plans.geometry import LineRaster, Linspace, PlaneRaster

LATEST = "latest"


@dataclass(frozen=True)
class Source:
    """Where a stage takes a setting from: the latest stage, a named one, or a configuration of its own."""

    kind: str = LATEST
    name: str | None = None
    config: dict | None = None

    @classmethod
    def parse(cls, spec: Any) -> Source:
        if spec is None or spec == LATEST:
            return cls()
        if isinstance(spec, dict) and set(spec) == {"from_name"}:
            name = spec["from_name"]
            if not name.strip() or name != name.strip():
                raise ValueError(f"not a stage name: {name!r}")
            return cls("name", name=name)
        if isinstance(spec, dict) and set(spec) == {"config"}:
            return cls("config", config=spec["config"])
        raise ValueError(f"not a source: {spec!r}")


@dataclass(frozen=True)
class Task:
    kind: str  # sample, image or plot_line
    name: str | None = None
    nr_samples: int | None = None
    sampler: Source = field(default_factory=Source)
    observable: Source = field(default_factory=Source)
    transforms: tuple[dict, ...] | None = None
    geometry: LineRaster | PlaneRaster | None = None
    display: str = "auto"
    complex: bool = False

    def named(self, sequence: int) -> str:
        return self.name or f"{self.kind}-{sequence}"

    def expected_samples(self) -> int | None:
        return self.geometry.points if self.geometry else self.nr_samples

    def full_observable(self) -> str | None:
        return None if self.geometry is None else "full_complex" if self.complex else "full_scalar"

    def check(self) -> None:
        if self.nr_samples is not None and self.nr_samples < 0:
            raise ValueError("nr_samples must not be negative")
        trains = self.sampler.kind == "config" and (self.sampler.config or {}).get("kind") == "havana_training"
        if self.kind == "sample" and trains and not self.nr_samples:
            raise ValueError("a training task needs nr_samples")
        if self.kind in ("image", "plot_line"):
            if self.geometry is None:
                raise ValueError(f"{self.kind} needs a geometry")
            self.geometry.check()
        elif self.kind != "sample":
            raise ValueError(f"unknown task: {self.kind}")


def parse_task(spec: dict) -> Task:
    kind = spec["kind"]
    geometry = None
    if raw := spec.get("geometry"):
        line = lambda x: Linspace(float(x["start"]), float(x["stop"]), int(x["count"]))
        vector = lambda k: tuple(map(float, raw[k]))
        discrete = tuple(raw.get("discrete", ()))
        if kind == "image":
            geometry = PlaneRaster(vector("offset"), vector("u_vector"), vector("v_vector"), line(raw["u_linspace"]), line(raw["v_linspace"]), discrete)
        else:
            geometry = LineRaster(vector("offset"), vector("direction"), line(raw["linspace"]), discrete)
    transforms = spec.get("batch_transforms")
    task = Task(
        kind, spec.get("name"), spec.get("nr_samples"), Source.parse(spec.get("sampler_aggregator")), Source.parse(spec.get("observable")),
        None if transforms is None else tuple(transforms), geometry, spec.get("display", "auto"), bool(spec.get("complex", False)),
    )
    task.check()
    return task


def preflight(tasks: Sequence[Task], existing: Sequence[str] = (), first_sequence: int = 1) -> list[str]:
    """The tasks' names; every name is new and every named source comes before its task."""
    names = list(existing)
    for i, task in enumerate(tasks):
        task.check()
        for source in (task.sampler, task.observable):
            if source.kind == "name" and source.name not in names:
                raise ValueError(f"no earlier task {source.name!r}")
        name = task.named(first_sequence + i)
        if name in names:
            raise ValueError(f"two tasks are called {name!r}")
        names.append(name)
    return names[len(existing) :]


@dataclass(frozen=True)
class Snapshot:
    """What a stage leaves for later ones."""

    id: int
    name: str
    sequence: int | None
    queue_empty: bool = True
    sampler: dict | None = None
    observable: str | None = None
    transforms: tuple[dict, ...] = ()
    task_id: int | None = None

    @property
    def has_grid(self) -> bool:
        return bool(self.sampler and "grid" in self.sampler)


def latest_before(snapshots: Sequence[Snapshot], sequence: int, grid: bool = False) -> Snapshot | None:
    """The latest finished snapshot strictly before a place; those without a place come last, newer ones first."""
    found = [s for s in snapshots if s.queue_empty and (s.sequence is None or s.sequence < sequence) and (s.has_grid or not grid)]
    return max(found, key=lambda s: (s.sequence is not None, s.sequence or 0, s.id), default=None)


def resolve(source: Source, snapshots: Sequence[Snapshot], sequence: int) -> Snapshot | None:
    if source.kind == "config":
        return None
    if source.kind == LATEST:
        return latest_before(snapshots, sequence)
    found = latest_before([s for s in snapshots if s.name == source.name], sequence)
    if found is None:
        raise ValueError(f"no earlier snapshot of {source.name!r}")
    return found


@dataclass(frozen=True)
class Stage:
    sampler: dict | None
    handoff: Snapshot | None
    observable: str | None
    transforms: tuple[dict, ...]


def resolve_stage(task: Task, snapshots: Sequence[Snapshot], sequence: int, checkpoint: Snapshot | None = None) -> Stage:
    """A stage's settings. A raster has its own sampler and full observable; others prefer their own configuration, then
    the named or latest source, then the run's root. A checkpoint, if there is one, continues the stage itself."""
    base = latest_before(snapshots, sequence)
    if task.geometry is not None:
        sampler: dict | None = {"kind": "raster_plane" if task.kind == "image" else "raster_line"}
        source = None
    elif task.sampler.kind == "config":
        sampler, source = task.sampler.config, None
    else:
        source = resolve(task.sampler, snapshots, sequence) or base
        sampler = source.sampler if source else None
    handoff = checkpoint or source
    if handoff is None and sampler and sampler.get("kind") == "havana_inference":
        wanted = sampler.get("snapshot")
        handoff = next((s for s in snapshots if s.id == wanted), None) if wanted else latest_before(snapshots, sequence, grid=True)
    if task.full_observable():
        observable = task.full_observable()
    elif checkpoint is not None:
        observable = checkpoint.observable
    elif task.observable.kind == "config":
        observable = (task.observable.config or {}).get("kind")
    else:
        found = resolve(task.observable, snapshots, sequence) or base
        observable = found.observable if found else None
    inherited = source or base
    transforms = task.transforms if task.transforms is not None else inherited.transforms if inherited else ()
    return Stage(sampler, handoff or base, observable, transforms)


def view_mode(kind: str, display: str, complex_: bool) -> str:
    """How an image or a line is shown unless told otherwise."""
    if display != "auto":
        return display
    if kind == "image":
        return "complex_phase" if complex_ else "scalar_heatmap"
    return "components" if complex_ else "scalar_curve"


def resolve_reference(reference: str, runs: dict[int, str]) -> int:
    """A run by its number or its name; an ambiguous name lists the candidates."""
    if reference.isdigit():
        if int(reference) not in runs:
            raise ValueError(f"no run {reference}")
        return int(reference)
    found = [i for i, name in runs.items() if name == reference]
    if len(found) != 1:
        raise ValueError(f"{'ambiguous' if found else 'unknown'} run {reference!r}: {found}")
    return found[0]
