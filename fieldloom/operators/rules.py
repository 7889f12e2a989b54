"""Ordered projection rules from values to simulator parameters, and the initial state of a run."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One output, the names it reads, and its expression of them."""

    output: str
    reads: tuple[str, ...]
    expression: Callable[..., Column]


def copy(output: str, name: str) -> Rule:
    return Rule(output, (name,), lambda x: x)


def compute(output: str, function: Callable[..., Column]) -> Rule:
    """A formula whose argument names are what it reads."""
    code = function.__code__
    return Rule(output, code.co_varnames[: code.co_argcount], function)


def fixed(output: str, value: float) -> Rule:
    return Rule(output, (), lambda: F.lit(float(value)))


def fixed_by(output: str, label: str, values: Mapping[str, float]) -> Rule:
    """A value for each label; a label without one fails the query."""

    def pick(x: Column) -> Column:
        found = F.raise_error(F.concat(F.lit(f"{output} has no value for "), x.cast("string")))
        for name, value in sorted(values.items(), reverse=True):
            found = F.when(x == name, F.lit(float(value))).otherwise(found)
        return found

    return Rule(output, (label,), pick)


def simplex(outputs: Sequence[str], name: str) -> list[Rule]:
    """All but the last element of a simplex, each to its output."""
    return [Rule(o, (name,), lambda x, i=i: F.element_at(x, i + 1)) for i, o in enumerate(outputs)]


class RuleError(ValueError):
    pass


def dependencies(rules: Sequence[Rule]) -> dict[str, frozenset[str]]:
    """The inputs, not outputs of earlier rules, on which each output depends."""
    out: dict[str, frozenset[str]] = {}
    for r in rules:
        out[r.output] = frozenset().union(*(out.get(n, frozenset([n])) for n in r.reads)) if r.reads else frozenset()
    return out


def apply(frame: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """``keys`` and every rule's output, as one projection; an output has one writer and reads only what is there."""
    held: dict[str, Column] = {c: F.col(c) for c in frame.columns}
    written: dict[str, Column] = {}
    for r in rules:
        if r.output in written:
            raise RuleError(f"two rules write {r.output}")
        if lacking := [n for n in r.reads if n not in held]:
            raise RuleError(f"the rule for {r.output} reads {', '.join(lacking)}, which nothing gives")
        written[r.output] = held[r.output] = r.expression(*(held[n] for n in r.reads))
    return frame.select(*keys, *(c.alias(n) for n, c in written.items()))


def photosynthesis(capacity: str, share: str) -> list[Rule]:
    """Maximum photosynthesis and base foliar respiration from a capacity and the share of it that respires."""
    return [
        Rule("a_max", (capacity, "leaf_c_per_area", share, "a_max_fraction"), lambda p, c, rho, f: p * c * (1 - rho) / f),
        Rule("base_fol_resp_frac", (share, "a_max_fraction"), lambda rho, f: rho * f / (1 - rho)),
    ]


def initial_state(leaf_per_area: str, fine: str, coarse: str, deciduous: str) -> list[Rule]:
    """Initial pools in g m-2, leaf area, soil wetness and root shares from carbon in kg m-2 and moisture in percent.

    A deciduous site starts without leaves, whatever its leaf carbon.
    """
    return [
        Rule("soil_init", ("soil_organic_carbon",), lambda s: 1000 * s),
        Rule("plant_wood_init", ("wood_carbon", fine, coarse), lambda w, f, g: 1000 * w / (1 - f - g)),
        Rule("lai_init", ("leaf_carbon", leaf_per_area, deciduous), lambda c, a, d: F.when(d, F.lit(0.0)).otherwise(1000 * c / a)),
        Rule("soil_wfrac_init", ("soil_moisture",), lambda m: m / 100),
        copy("fine_root_frac", fine),
        copy("coarse_root_frac", coarse),
    ]


#: The least share of the wood that roots leave, and the least leaf carbon an area of leaf that the simulator takes as given.
LEAST_WOOD, LEAST_LEAF = 0.01, 1e-6


def refused_states(frame: DataFrame, keys: Sequence[str], leaf_per_area: str, fine: str, coarse: str, deciduous: str, least: float = LEAST_WOOD) -> DataFrame:
    """Rows that no initial state can be made of, with the first reason; leaf carbon counts at evergreen sites alone."""

    def finite(name: str) -> Column:
        return F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) != float("inf"))

    wood = 1 - F.col(fine) - F.col(coarse)
    reasons = [(~(finite(p) & (F.col(p) >= 0)), f"{p} is negative or not finite") for p in ("soil_organic_carbon", "wood_carbon")]
    reasons += [
        (~F.col(deciduous) & ~(finite("leaf_carbon") & (F.col("leaf_carbon") >= 0)), "leaf_carbon is negative or not finite"),
        (~(finite("soil_moisture") & F.col("soil_moisture").between(0, 100)), "soil_moisture is no percentage"),
        (~(finite(leaf_per_area) & (F.col(leaf_per_area) >= LEAST_LEAF)), f"{leaf_per_area} is below the simulator's least"),
        *((~(finite(r) & F.col(r).between(0, 1)), f"{r} is no share") for r in (fine, coarse)),
        (wood < least, "roots take all wood"),
    ]
    found = F.coalesce(*(F.when(bad, F.lit(reason)) for bad, reason in reasons))
    return frame.withColumn("reason", found).where("reason is not null").select(*keys, "reason")


def member_states(states: DataFrame, parameters: DataFrame, labels: Sequence[str], leaf_per_area: str, fine: str, coarse: str, deciduous: str) -> DataFrame:
    """Initial states of an ensemble: its members' pools with the parameters of the same labels.

    ``labels`` are the batch dims and site of the states; parameters carry any of them and are matched by those they carry. A
    state without its parameters, or that can't be converted, fails the query.
    """
    shared = [x for x in labels if x in parameters.columns]
    if extra := [c for c in parameters.columns if c not in (*labels, leaf_per_area, fine, coarse, deciduous)]:
        raise RuleError(f"the parameters have dims that the states lack: {', '.join(extra)}")
    held = states.join(parameters.withColumn("__held", F.lit(True)), shared, "left") if shared else states.crossJoin(F.broadcast(parameters.limit(2).withColumn("__held", F.lit(True))))
    refused = refused_states(held, [*labels, "__held"], leaf_per_area, fine, coarse, deciduous)
    reason = F.when(F.col("__held").isNull(), F.lit("it has no parameters")).otherwise(F.col("__reason"))
    marked = held.join(refused.select(*labels, F.col("reason").alias("__reason")), list(labels), "left").withColumn("__why", reason)
    ok = F.when(F.col("__why").isNotNull(), F.raise_error(F.concat(F.lit("no initial state: "), F.col("__why")))).otherwise(F.lit(True))
    return apply(marked.where(ok), initial_state(leaf_per_area, fine, coarse, deciduous), labels)
