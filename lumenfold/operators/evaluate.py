"""Integrands: columns over a point's coordinates, and a registry for them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.expression import compile_expression
from lumenfold.functions.numeric import complex_of, complex_sin, modulus, modulus_squared
from lumenfold.plans.domain import Continuous, Domain, nested, rectangular

SCALAR, COMPLEX, BOTH = ("scalar", "full_scalar"), ("complex", "full_complex"), ("scalar", "full_scalar", "complex", "full_complex", "histograms")


@dataclass(frozen=True)
class Evaluator:
    """An integrand: its domain, its value (double or complex struct) and the observables it can feed."""

    domain: Domain
    value: Callable[[Column, Column], Column]
    observables: tuple[str, ...]

    def check(self, observable: str) -> None:
        if observable not in self.observables:
            raise ValueError(f"this integrand feeds {self.observables}, not {observable}")


def unit(dims: int, depth: int = 0, kind: str = "scalar") -> Evaluator:
    one = F.lit(1.0) if kind == "scalar" else complex_of(F.lit(1.0), F.lit(0.0))
    return Evaluator(rectangular(dims, depth), lambda c, d: one, SCALAR if kind == "scalar" else COMPLEX)


def sine_gauss() -> Evaluator:
    """sin(x) exp(-x^2)."""
    return Evaluator(Continuous(1), lambda c, d: F.sin(c[0]) * F.exp(-c[0] * c[0]), SCALAR)


def complex_sine() -> Evaluator:
    """sin(x + iy)."""
    return Evaluator(Continuous(2), lambda c, d: complex_sin(complex_of(c[0], c[1])), COMPLEX)


def expression(text: str, arguments: list[str]) -> Evaluator:
    """A user's expression of named coordinates."""
    return Evaluator(Continuous(len(arguments)), lambda c, d: compile_expression(text, {a: c[i] for i, a in enumerate(arguments)}), SCALAR)


def external(value: Callable[[Column, Column], Column], axes: list[tuple[str, int]], dims: int) -> Evaluator:
    """An integrand from elsewhere, such as a pandas UDF, over nested discrete axes and a continuous leaf."""
    return Evaluator(nested(axes, dims), value, BOTH)


REGISTRY: dict[str, Callable[..., Evaluator]] = {
    "unit": unit, "sin_evaluator": sine_gauss, "sinc_evaluator": complex_sine, "symbolica": expression, "external": external,
}


def build(spec: dict) -> Evaluator:
    settings = dict(spec)
    kind = settings.pop("kind")
    if kind not in REGISTRY:
        raise ValueError(f"unknown integrand: {kind}")
    return REGISTRY[kind](**settings)


def evaluate(points: DataFrame, evaluator: Evaluator) -> DataFrame:
    """Points with ``value``."""
    return points.withColumn("value", evaluator.value(F.col("continuous"), F.col("discrete")))


def training_projection(value: Column, kind: str) -> Column:
    """The real number that a sampler learns from a complex value."""
    return {"real": lambda: value["re"], "imag": lambda: value["im"], "abs": lambda: modulus(value), "abs_sq": lambda: modulus_squared(value)}[kind]()


def training_values(evaluated: DataFrame, kind: str | None = None) -> DataFrame:
    """Evaluated points with ``training``: value times signed weight."""
    value = F.col("value") if kind is None else training_projection(F.col("value"), kind)
    return evaluated.withColumn("training", value * F.col("weight"))


def training_mismatches(batches: DataFrame) -> DataFrame:
    """Batches (batch_id, nr_samples, required, values) whose training values are missing, unasked for or of another number."""
    n = F.when(F.col("values").isNotNull(), F.size("values"))
    return batches.where((F.col("required") != F.col("values").isNotNull()) | (n != F.col("nr_samples"))).select("batch_id")
