"""Layouts: named components with labels as one flat vector, and the tables that go with it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.plans.support import Interval, Support


@dataclass(frozen=True)
class Component:
    """A named value: its labelled dims in order, its element names, units and support."""

    name: str
    dims: Mapping[str, Sequence[object]] = field(default_factory=dict)
    elements: Sequence[str] = ()
    units: str = "1"
    support: Support = Interval()

    def __post_init__(self) -> None:
        for dim, labels in self.dims.items():
            if len(set(labels)) != len(labels):
                raise ValueError(f"labels of {dim} repeat in {self.name}")

    @property
    def entries(self) -> list[tuple[dict[str, object], str | None]]:
        """Labels and element of every entry: dims vary slowest first, elements fastest."""
        out: list[dict[str, object]] = [{}]
        for dim, labels in self.dims.items():
            out = [{**x, dim: label} for x in out for label in labels]
        return [(x, e) for x in out for e in (self.elements or (None,))]


class Layout:
    """Components in their order of declaration as entries 0 to n - 1 of a flat vector."""

    def __init__(self, components: Sequence[Component]):
        if len({c.name for c in components}) != len(components):
            raise ValueError("names of components repeat")
        self.components = list(components)
        self.index = [(c, labels, element) for c in components for labels, element in c.entries]

    def __len__(self) -> int:
        return len(self.index)

    def slice(self, name: str) -> slice:
        """Where a component stands in the flat vector."""
        places = [i for i, (c, *_) in enumerate(self.index) if c.name == name]
        if not places:
            raise KeyError(name)
        return slice(places[0], places[-1] + 1)

    def positions(self, components: Sequence[str] | None = None, **labels: Sequence[object]) -> list[int]:
        """Entries of components and labels; an entry without a selected dim is kept."""
        return [
            i for i, (c, held, _) in enumerate(self.index) if (components is None or c.name in components) and all(d not in held or held[d] in list(x) for d, x in labels.items())
        ]

    def entry_name(self, i: int) -> str:
        c, labels, element = self.index[i]
        inside = ",".join([*(f"{d}={x}" for d, x in labels.items()), *([element] if element is not None else [])])
        return f"{c.name}[{inside}]" if inside else c.name

    def table(self, spark) -> DataFrame:
        """``entry, component, labels, element``: the layout as a small dimension table."""
        rows = [(i, c.name, {d: str(x) for d, x in labels.items()}, element) for i, (c, labels, element) in enumerate(self.index)]
        return spark.createDataFrame(rows, "entry int, component string, labels map<string,string>, element string")

    def to_entries(self, frame: DataFrame, keys: Sequence[str], flat: str) -> DataFrame:
        """Flat vectors as ``keys, entry, value``; a vector of another length fails the query."""
        exact = F.when(F.size(flat) != len(self), F.raise_error(F.lit("a vector doesn't have the layout's length"))).otherwise(F.col(flat))
        return frame.select(*keys, F.posexplode(exact).alias("entry", "value"))

    def to_flat(self, entries: DataFrame, keys: Sequence[str], flat: str) -> DataFrame:
        """``keys, entry, value`` as flat vectors; each must have every entry once."""
        packed = F.array_sort(F.collect_list(F.struct("entry", "value")))
        whole = F.when(F.count("*") != len(self), F.raise_error(F.lit("a vector lacks entries or has too many"))).otherwise(F.transform(packed, lambda x: x["value"]))
        return entries.groupBy(*keys).agg(whole.alias(flat))

    def named(self, frame: DataFrame, keys: Sequence[str], flat: str) -> DataFrame:
        """Flat vectors as a column for each entry."""
        return frame.select(*keys, *(F.element_at(flat, i + 1).alias(self.entry_name(i)) for i in range(len(self))))

    def natural(self, flat: Column) -> Column:
        """The vector of natural values of an unconstrained one, interval by interval."""
        return F.array(*(self.index[i][0].support.natural(F.element_at(flat, i + 1)) for i in range(len(self))))

    def unconstrained(self, flat: Column) -> Column:
        return F.array(*(self.index[i][0].support.unconstrained(F.element_at(flat, i + 1)) for i in range(len(self))))

    def log_jacobian(self, flat: Column) -> Column:
        """Log derivative of ``natural`` at an unconstrained vector."""
        out = F.lit(0.0)
        for i, (c, *_) in enumerate(self.index):
            out = out + c.support.log_derivative(F.element_at(flat, i + 1))
        return out
