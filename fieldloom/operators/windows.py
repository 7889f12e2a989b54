"""Event-time cells and windows over steps ``(start, end]`` that are labelled by their end.

Fields are long tables: any batch columns, ``site``, a stamp and a value. Steps are assigned to fixed cells by integer
arithmetic, so a cell aggregate is one partial and one final aggregation. Arbitrary windows and as-of labels are range
joins; intervals are cut into buckets, so the join is an equi-join on the bucket with a residual condition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.aggregates import present, reduction, reduction_for
from fieldloom.functions.time import DAY, cell_end, micros, month_end, stamp, year_end


def cell_label(at: Column, freq: str) -> Column:
    """Right edge of the cell that holds a stamp: ``MS`` and ``YS`` for months and years, ``<n>h`` or ``<n>D`` else."""
    if freq == "MS":
        return month_end(at)
    if freq == "YS":
        return year_end(at)
    unit = {"D": DAY, "h": DAY // 24, "min": DAY // 1440}
    for suffix, step in unit.items():
        if freq.endswith(suffix) and (freq[: -len(suffix)] or "1").isdigit():
            return stamp(cell_end(micros(at), int(freq[: -len(suffix)] or 1) * step))
    raise ValueError(f"{freq!r} is no cell frequency")


def aggregate_cells(field: DataFrame, keys: Sequence[str], freq: str, *, time: str = "time", value: str = "value", kind: str | None = None, how: str | None = None, weight: str | None = None, counts: bool = True) -> DataFrame:
    """One row for each key and cell: the gap-aware reduction, and the rows and present values of the cell."""
    named = reduction_for(kind, how)
    step = field.withColumn("cell", cell_label(F.col(time), freq)).withColumn(value, present(F.col(value).cast("double")))
    found = [reduction(named, F.col(value), F.col(time), F.col(weight) if weight else None).alias(named)]
    if counts:
        found += [F.count("*").alias("n_steps"), F.count(value).alias("n_present")]
    return step.groupBy(*keys, "cell").agg(*found)


def cells_with(cells: DataFrame, least: int) -> DataFrame:
    """Cells with at least ``least`` present values."""
    return cells.where(F.col("n_present") >= least)


def bucketed_windows(windows: DataFrame, width: int = DAY, start: str = "window_start", end: str = "window_end") -> DataFrame:
    """Each window once for every bucket of ``width`` that it meets; a step has one bucket, so no pair repeats."""
    lo, hi = micros(F.col(start)), micros(F.col(end))
    return windows.withColumn("bucket", F.explode(F.sequence(cell_end(lo + 1, width), cell_end(hi, width), F.lit(width))))


def steps_in_windows(steps: DataFrame, windows: DataFrame, on: Sequence[str] = (), *, time: str = "time", width: int = DAY) -> DataFrame:
    """Steps joined with the window ``(window_start, window_end]`` that holds their end."""
    left = steps.withColumn("bucket", cell_end(micros(F.col(time)), width))
    joined = left.join(bucketed_windows(windows, width), [*on, "bucket"])
    return joined.where((F.col(time) > F.col("window_start")) & (F.col(time) <= F.col("window_end"))).drop("bucket")


def reduce_windows(steps: DataFrame, windows: DataFrame, hows: Sequence[str], keys: Sequence[str], on: Sequence[str] = (), *, time: str = "time", value: str = "value", weight: str | None = None, width: int = DAY) -> DataFrame:
    """Every window with its gap-aware reductions; NULL and a count of 0 where it holds no step."""
    clean = steps.withColumn(value, present(F.col(value).cast("double")))
    inside = steps_in_windows(clean, windows, on, time=time, width=width)
    found = inside.groupBy(*keys).agg(
        *(reduction(h, F.col(value), F.col(time), F.col(weight) if weight else None).alias(h) for h in hows), F.count("*").alias("n_steps"), F.count(value).alias("n_present")
    )
    return windows.join(found, list(keys), "left").fillna(0, ["n_steps", "n_present"])


def window_span(steps: DataFrame, windows: DataFrame, keys: Sequence[str], on: Sequence[str] = (), *, start: str = "timestep_start", time: str = "time") -> DataFrame:
    """First start, last end and total length (microseconds) of the steps of each window."""
    inside = steps_in_windows(steps, windows, on, time=time)
    length = micros(F.col(time)) - micros(F.col(start))
    return inside.groupBy(*keys).agg(F.min(start).alias("span_start"), F.max(time).alias("span_end"), F.sum(length).alias("span_micros"))


def as_of(labels: DataFrame, steps: DataFrame, on: Sequence[str] = (), *, label: str = "time", start: str = "timestep_start", end: str = "timestep_end", width: int = DAY, how: str = "left") -> DataFrame:
    """Each label with the step ``start < label <= end`` that holds it."""
    cut = bucketed_windows(steps, width, start, end)
    left = labels.withColumn("bucket", cell_end(micros(F.col(label)), width))
    held = (F.col(label) > F.col(start)) & (F.col(label) <= F.col(end))
    right = cut.withColumnsRenamed({k: f"__{k}" for k in (*on, "bucket")})
    condition = F.col("bucket") == F.col("__bucket")
    for k in on:
        condition &= F.col(k) == F.col(f"__{k}")
    return left.join(right, condition & held, how).drop("bucket", "__bucket", *(f"__{k}" for k in on))


def whole_run(steps: DataFrame, keys: Sequence[str], hows: Sequence[str], *, time: str = "time", value: str = "value") -> DataFrame:
    """Reductions over a whole record, with its first and last stamp."""
    clean = steps.withColumn(value, present(F.col(value).cast("double")))
    return clean.groupBy(*keys).agg(*(reduction(h, F.col(value), F.col(time)).alias(h) for h in hows), F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def daily_windows(spark, first_day: str, last_day: str, start_hours: float, end_hours: float) -> DataFrame:
    """``(day + start, day + end]`` of every day of a range, with its position."""
    days = spark.sql(f"select explode(sequence(date'{first_day}', date'{last_day}')) as day")
    base = F.unix_micros(F.col("day").cast("timestamp"))
    return days.select("day", stamp(base + int(start_hours * 3_600_000_000)).alias("window_start"), stamp(base + int(end_hours * 3_600_000_000)).alias("window_end"))


def annual_windows(years: DataFrame, year: str = "year") -> DataFrame:
    """``window_start`` and ``window_end`` of calendar years: 1 January and the next."""
    first = F.make_date(F.col(year), F.lit(1), F.lit(1))
    return years.withColumns({"window_start": first.cast("timestamp_ntz"), "window_end": F.make_date(F.col(year) + 1, F.lit(1), F.lit(1)).cast("timestamp_ntz")})


def inside_record(windows: DataFrame, records: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Windows that lie in the record ``(record_start, record_end]``; records are one row a key."""
    joined = windows.join(records, list(on)) if on else windows.crossJoin(F.broadcast(records.limit(1)))
    return joined.where((F.col("window_start") >= F.col("record_start")) & (F.col("window_end") <= F.col("record_end")))


def outside_record(windows: DataFrame, records: DataFrame, on: Sequence[str], slack: int = 0) -> DataFrame:
    """Windows that reach beyond the record by more than ``slack`` microseconds: the violations of a coverage guard."""
    joined = windows.join(records, list(on), "left")
    early = micros(F.col("window_start")) + slack < micros(F.col("record_start"))
    late = micros(F.col("window_end")) - slack > micros(F.col("record_end"))
    return joined.where(F.col("record_start").isNull() | early | late)


def without_padding(field: DataFrame, value: str = "value", start: str = "timestep_start") -> DataFrame:
    """Rows with an interval; a value on a row without one is an error."""
    return field.where(F.when(F.col(start).isNull() & F.col(value).isNotNull(), F.raise_error(F.lit("a padding row has a value"))).otherwise(F.col(start).isNotNull()))


def to_utc(field: DataFrame, offsets: DataFrame, on: Sequence[str], step: int, *, time: str = "time", offset_hours: str = "utc_offset_hours") -> DataFrame:
    """Local stamps moved to UTC by a fixed offset a key, which must be a whole number of steps."""
    shift = F.rint(F.col(offset_hours) * 3_600_000_000).cast("long")
    checked = F.when(F.pmod(shift, F.lit(step)) != 0, F.raise_error(F.lit("an offset isn't a whole number of steps"))).otherwise(shift)
    return field.join(offsets, list(on)).withColumn(time, stamp(micros(F.col(time)) - checked)).drop(offset_hours)


def aggregate_run(outputs: DataFrame, keys: Sequence[str], freq: str, kinds: Mapping[str, str], *, time: str = "time") -> DataFrame:
    """Every variable of a wide run table in cells, by its kind's default, in one aggregation."""
    clean = outputs.withColumns({v: present(F.col(v).cast("double")) for v in kinds}).withColumn("cell", cell_label(F.col(time), freq))
    return clean.groupBy(*keys, "cell").agg(*(reduction(reduction_for(k, None), F.col(v), F.col(time)).alias(v) for v, k in kinds.items()))
