"""Model graphs: factors, deterministic parts and simulators, bound to labels and conditioned on observations.

A model is a driver-side graph. Sampling and densities compile to column expressions over one row a sample, so a model of
any number of samples is one projection; a simulator is a stage of its own between two projections.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import density as D
from fieldloom.operators.ensemble import normal


class ModelError(ValueError):
    pass


@dataclass(frozen=True)
class Law:
    """A law of one value: its log density at a column, and a draw from a standard normal column."""

    log_density: Callable[[Column], Column]
    draw: Callable[[Column], Column]


def normal_law(mean: Column | float, sd: Column | float) -> Law:
    m, s = (v if isinstance(v, Column) else F.lit(float(v)) for v in (mean, sd))
    return Law(lambda x: D.normal(x, m, s), lambda z: m + s * z)


def log_normal_law(median: float, geometric_sd: float) -> Law:
    import math

    return Law(lambda x: D.log_normal(x, median, geometric_sd), lambda z: median * F.exp(math.log(geometric_sd) * z))


def logit_normal_law(low: float, high: float, median: float, sd: float) -> Law:
    import math

    m = (median - low) / (high - low)
    center = math.log(m / (1 - m))
    return Law(lambda x: D.logit_normal(x, low, high, median, sd), lambda z: low + (high - low) / (1 + F.exp(-(center + sd * z))))


@dataclass(frozen=True)
class Factor:
    """A component with a law that may read other names."""

    name: str
    law: Callable[..., Law]
    reads: tuple[str, ...] = ()


@dataclass(frozen=True)
class Deterministic:
    name: str
    formula: Callable[..., Column]
    reads: tuple[str, ...] = ()


@dataclass(frozen=True)
class Simulator:
    """A stage from a frame with the read names to the same frame with its outputs; NULL outputs are failed runs."""

    outputs: tuple[str, ...]
    reads: tuple[str, ...]
    stage: Callable[[DataFrame], DataFrame]

    @property
    def name(self) -> str:
        return "+".join(self.outputs)


Part = Factor | Deterministic | Simulator


def _writes(part: Part) -> tuple[str, ...]:
    return part.outputs if isinstance(part, Simulator) else (part.name,)


@dataclass
class Model:
    """Parts in an order in which each reads what stands before it."""

    parts: list[Part]
    inputs: tuple[str, ...] = ()
    _by: dict[str, Part] = field(init=False)

    def __post_init__(self) -> None:
        self._by = {}
        for part in self.parts:
            for n in _writes(part):
                if n in self._by or n in self.inputs:
                    raise ModelError(f"{n} is given twice")
                self._by[n] = part
        for part in self.parts:
            if lacking := [n for n in part.reads if n not in self._by and n not in self.inputs]:
                raise ModelError(f"{part.name} reads {', '.join(lacking)}, which nothing gives")
        order, held, left = [], set(self.inputs), list(self.parts)
        while left:
            ready = [p for p in left if set(p.reads) <= held]
            if not ready:
                raise ModelError(f"{', '.join(p.name for p in left)} read each other in a circle")
            order += ready
            held |= {n for p in ready for n in _writes(p)}
            left = [p for p in left if p not in ready]
        self.parts = order

    def ancestors(self, names: Sequence[str]) -> set[str]:
        """Names that the given ones depend on, themselves included."""
        out, todo = set(), list(names)
        while todo:
            n = todo.pop()
            if n not in out:
                out.add(n)
                if n in self._by:
                    todo += self._by[n].reads
        return out

    def restricted(self, names: Sequence[str]) -> Model:
        """The model without the parts that the given names don't depend on."""
        needed = self.ancestors(names)
        return Model([p for p in self.parts if needed.intersection(_writes(p))], self.inputs)

    def sample(self, frame: DataFrame, seed: int, key: str = "sample") -> DataFrame:
        """Ancestral draws of every factor for each row; a factor's stream depends on its name, not on its place."""
        for part in self.parts:
            if isinstance(part, Factor):
                law = part.law(*(F.col(n) for n in part.reads))
                frame = frame.withColumn(part.name, law.draw(normal(seed ^ crc32(part.name.encode()), key)))
            elif isinstance(part, Deterministic):
                frame = frame.withColumn(part.name, part.formula(*(F.col(n) for n in part.reads)))
            else:
                frame = part.stage(frame)
        return frame

    def complete(self, frame: DataFrame) -> DataFrame:
        """Deterministic parts and simulator outputs for given factors."""
        for part in self.parts:
            if isinstance(part, Deterministic):
                frame = frame.withColumn(part.name, part.formula(*(F.col(n) for n in part.reads)))
            elif isinstance(part, Simulator):
                frame = part.stage(frame)
        return frame

    def log_density(self, names: Sequence[str] | None = None) -> Column:
        """Sum of the factors' log densities, minus infinity where one is undefined."""
        total = F.lit(0.0)
        for part in self.parts:
            if isinstance(part, Factor) and (names is None or part.name in names):
                total = total + part.law(*(F.col(n) for n in part.reads)).log_density(F.col(part.name))
        return F.when(total.isNull() | F.isnan(total), F.lit(float("-inf"))).otherwise(total)


@dataclass
class Posterior:
    """A model with some factors observed. Targets are the unobserved factors that the observed depend on; the rest is barren."""

    model: Model
    observed: Mapping[str, float]

    def __post_init__(self) -> None:
        factors = {p.name for p in self.model.parts if isinstance(p, Factor)}
        if bad := set(self.observed) - factors:
            raise ModelError(f"{', '.join(sorted(bad))} can't be observed: no factor")
        needed = self.model.ancestors(list(self.observed))
        self.targets = [p.name for p in self.model.parts if isinstance(p, Factor) and p.name in needed and p.name not in self.observed]
        self.barren = [p.name for p in self.model.parts if isinstance(p, Factor) and p.name not in needed and p.name not in self.observed]
        self.pruned = self.model.restricted(list(self.observed))

    def evaluate(self, theta: DataFrame) -> DataFrame:
        """``theta`` with log prior, log likelihood, their sum and validity; the simulator runs once for all rows."""
        frame = self.pruned.complete(theta.withColumns({n: F.lit(float(v)) for n, v in self.observed.items()}))
        prior, likelihood = self.pruned.log_density(self.targets), self.pruned.log_density(list(self.observed))
        frame = frame.withColumn("log_prior", prior).withColumn("log_likelihood", likelihood)
        frame = frame.withColumn("valid", (F.col("log_likelihood") > float("-inf")) & (F.col("log_prior") > float("-inf")))
        return frame.withColumn("log_density", F.when(F.col("valid"), F.col("log_prior") + F.col("log_likelihood")).otherwise(F.lit(float("-inf"))))

    def replicate(self, theta: DataFrame, seed: int, key: str = "sample") -> DataFrame:
        """New draws of the observed factors given each row, named ``<name>_new``."""
        frame = self.pruned.complete(theta.withColumns({n: F.lit(float(v)) for n, v in self.observed.items()}))
        for part in self.pruned.parts:
            if isinstance(part, Factor) and part.name in self.observed:
                frame = frame.withColumn(f"{part.name}_new", part.law(*(F.col(n) for n in part.reads)).draw(normal(seed ^ crc32(part.name.encode()), key)))
        return frame
