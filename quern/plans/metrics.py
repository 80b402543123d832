"""Metrics declared once and compiled into DataFrame plans: simple, ratio, derived, cumulative and compared over time.

A definition names physical or logical columns of a table; names are resolved before a plan is made, and whatever cannot be
resolved, is ambiguous or recurs is refused with a MetricError that carries a code.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.rounds import settled

AGGREGATES = ("sum", "count", "count_distinct", "avg", "min", "max", "median", "percentile")
GRAINS = ("hour", "day", "week", "month", "quarter", "year")


class MetricError(ValueError):
    def __init__(self, code: str, detail: str) -> None:
        super().__init__(f"{code}: {detail}")
        self.code = code


@dataclass(frozen=True)
class Simple:
    """One aggregate over a table. filter is a SQL predicate; time_column is what windows and grains refer to."""

    table: str
    agg: str
    expr: str | None = None
    filter: str | None = None
    percentile: float | None = None
    time_column: str | None = None


@dataclass(frozen=True)
class Ratio:
    """Numerator over denominator as doubles; null where the denominator is null or zero. A number may stand for either."""

    numerator: str | float
    denominator: str | float


@dataclass(frozen=True)
class Derived:
    """Arithmetic over other metrics by name; division is true division."""

    expr: str


@dataclass(frozen=True)
class Cumulative:
    """The sum of another metric by period: over a trailing interval, both bounds included, or from the start of a grain."""

    of: str
    window: tuple[int, str] | None = None
    to_date: str | None = None


@dataclass
class Catalog:
    """Tables by name, logical names of their columns, and metrics by name."""

    tables: Mapping[str, Callable[[], DataFrame]]
    metrics: Mapping[str, Simple | Ratio | Derived | Cumulative]
    names: Mapping[str, Mapping[str, str]] = field(default_factory=dict)

    def column(self, table: str, name: str) -> str:
        """The physical column that a logical or physical name stands for; one that stands for two is unknown."""
        physical = self.tables[table]().columns
        found = {p for logical, p in self.names.get(table, {}).items() if logical == name} | ({name} if name in physical else set())
        if len(found) != 1 or not found <= set(physical):
            raise MetricError("unknown_column", f"{name} of {table}")
        return found.pop()


def truncated(column: str | Column, grain: str) -> Column:
    """The start of the period, without a time zone."""
    if grain not in GRAINS:
        raise MetricError("time_filter_unsupported", f"grain {grain}")
    return F.date_trunc(grain, F.col(column) if isinstance(column, str) else column).cast("timestamp_ntz")


def aggregate(metric: Simple) -> Column:
    if metric.agg not in AGGREGATES:
        raise MetricError("metric_invalid", f"aggregate {metric.agg}")
    if metric.agg == "count" and metric.expr in (None, "", "*"):
        return F.count(F.lit(1))
    if not metric.expr:
        raise MetricError("metric_not_executable", "an expression is missing")
    value = F.expr(metric.expr)
    if metric.agg == "percentile":
        if metric.percentile is None or not 0 < metric.percentile < 100:
            raise MetricError("metric_invalid", "percentile must lie between 0 and 100")
        return F.percentile(value, metric.percentile / 100)
    return {"sum": F.sum, "count": F.count, "count_distinct": F.count_distinct, "avg": F.avg, "min": F.min, "max": F.max, "median": F.median}[metric.agg](value)


def _inputs(metric: Ratio | Derived, known: Mapping) -> list[str]:
    if isinstance(metric, Ratio):
        return [x for x in (metric.numerator, metric.denominator) if isinstance(x, str)]
    return [x for x in dict.fromkeys(re.findall(r"[A-Za-z_]\w*", metric.expr)) if x in known]


def compile_metric(
    catalog: Catalog,
    name: str,
    group_by: tuple[str, ...] = (),
    time_from: str | None = None,
    time_to: str | None = None,
    value: str = "value",
    _path: tuple[str, ...] = (),
) -> DataFrame:
    """The metric by the given columns, as (columns..., value).

    A column may have a grain, as in `o_orderdate@month`; it is then named period. time_from and time_to are inclusive bounds on
    the time column. Inputs of ratios and derived metrics are aggregated on their own and joined on all keys, null equal to null,
    so that a key that only one of them has is kept.
    """
    if name in _path:
        raise MetricError("metric_cycle", " > ".join([*_path, name]))
    if len(_path) > 8:
        raise MetricError("metric_invalid", "inputs nest too deeply")
    if name not in catalog.metrics:
        raise MetricError("metric_unresolved", name)
    metric = catalog.metrics[name]
    if isinstance(metric, Simple):
        rows = catalog.tables[metric.table]()
        if metric.filter:
            rows = rows.where(metric.filter)
        if time_from or time_to:
            if not metric.time_column:
                raise MetricError("time_filter_unavailable", name)
            at = F.col(catalog.column(metric.table, metric.time_column))
            rows = rows.where((at >= time_from if time_from else F.lit(True)) & (at <= time_to if time_to else F.lit(True)))
        keys = []
        for key in group_by:
            column, _, grain = key.partition("@")
            physical = catalog.column(metric.table, column)
            keys.append(truncated(physical, grain).alias("period") if grain else F.col(physical).alias(column))
        made = aggregate(metric).alias(value)
        if metric.agg in ("percentile", "median"):
            return at_rank(rows.select(*keys, F.expr(metric.expr).alias("_v")), 0.5 if metric.agg == "median" else metric.percentile / 100, value)
        return rows.groupBy(*keys).agg(made) if keys else rows.agg(made)
    if isinstance(metric, Cumulative):
        grain = [key for key in group_by if "@" in key]
        if len(grain) != 1:
            raise MetricError("unsupported_group_by", "a cumulative metric needs one period")
        return cumulative(compile_metric(catalog, metric.of, group_by, time_from, time_to, value, (*_path, name)), metric, value)
    inputs = _inputs(metric, catalog.metrics)
    keys = ["period" if "@" in key else key for key in group_by]
    parts = [compile_metric(catalog, x, group_by, time_from, time_to, f"_{x}", (*_path, name)) for x in inputs]
    joined = parts[0] if parts else None
    for part in parts[1:]:
        joined = full_join(joined, part, keys)
    if joined is None:
        raise MetricError("metric_not_executable", f"{name} has no input")
    if isinstance(metric, Ratio):
        side = lambda x: F.col(f"_{x}").cast("double") if isinstance(x, str) else F.lit(float(x))
        bottom = side(metric.denominator)
        result = side(metric.numerator) / F.when(bottom != 0, bottom)
    else:
        result = F.expr(re.sub(r"[A-Za-z_]\w*", lambda m: f"`_{m[0]}`" if m[0] in inputs else m[0], metric.expr))
    return joined.select(*keys, result.alias(value))


def at_rank(rows: DataFrame, share: float, value: str = "value") -> DataFrame:
    """(other columns, value): the exact percentile of column _v in each group of the other columns, between two values by their distance.

    Equal values are counted first. Different ones are dealt by range and only those ranges that hold a wanted rank are put in order,
    so no task reads more than its part of the different values. A group without values has null.
    """
    keys = [c for c in rows.columns if c != "_v"]
    counted = rows.select(*keys, F.col("_v").cast("double").alias("_v")).groupBy(*keys, "_v").agg(F.count("_v").alias("_n"))
    ranged = settled(counted.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    parts = settled(ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_n")))
    same = [F.col(c) for c in keys]
    ahead = F.sum("_n").over(W.partitionBy(*same).orderBy("_part")) - F.col("_n")
    rank = F.lit(share) * (F.sum("_n").over(W.partitionBy(*same)) - 1)
    held = parts.select(*same, "_part", "_n", ahead.alias("_ahead"), rank.alias("_rank"))
    held = held.where((F.col("_ahead") <= F.ceil("_rank")) & (F.col("_ahead") + F.col("_n") > F.floor("_rank"))).drop("_n")
    found = ranged.where("_n > 0").alias("r").join(held.alias("h"), (F.col("r._part") == F.col("h._part")) & _all_same("r", "h", keys))
    found = found.select(*(F.col(f"r.{c}").alias(c) for c in keys), "r._part", "_v", "_n", "_ahead", "_rank")
    upto = F.col("_ahead") + F.sum("_n").over(W.partitionBy(*same, "_part").orderBy("_v"))
    found = found.select(*same, "_v", "_rank", upto.alias("_to"), (upto - F.col("_n")).alias("_from"))
    at = lambda place: F.max(F.when((F.col("_from") <= place) & (place < F.col("_to")), F.col("_v")))
    made = [F.max("_rank").alias("_rank"), at(F.floor("_rank")).alias("_a"), at(F.ceil("_rank")).alias("_b")]
    low, high, rank = F.col("_a"), F.col("_b"), F.col("_rank")
    between = F.when((F.floor(rank) == F.ceil(rank)) | (low == high), low).otherwise((F.ceil(rank) - rank) * low + (rank - F.floor(rank)) * high)
    told = (found.groupBy(*keys).agg(*made) if keys else found.agg(*made)).select(*keys, between.alias(value))
    return full_join(parts.select(*keys).distinct(), told, keys) if keys else told


def _all_same(a: str, b: str, keys: list[str]) -> Column:
    same = F.lit(True)
    for key in keys:
        same &= F.col(f"{a}.{key}").eqNullSafe(F.col(f"{b}.{key}"))
    return same


def full_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of both, matched on equal keys, null equal to null; single rows side by side without keys."""
    if not keys:
        return left.join(right, F.lit(True), "full_outer")  # one row each
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    both = left.withColumn("_left", F.lit(True)).join(renamed, on, "full_outer")
    own = [F.when(F.col("_left"), F.col(k)).otherwise(F.col(f"_right_{k}")).alias(k) for k in keys]
    return both.select(*own, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys])


def cumulative(series: DataFrame, metric: Cumulative, value: str = "value") -> DataFrame:
    """Running sums of a series with a column `period`, apart for each combination of its other columns."""
    others = [c for c in series.columns if c not in ("period", value)]
    if metric.window is not None:
        count, unit = metric.window
        count, unit = (3 * count, "month") if unit == "quarter" else (count, unit)
        part = f"PARTITION BY {', '.join(f'`{c}`' for c in others)} " if others else ""
        total = F.expr(f"sum(`{value}`) OVER ({part}ORDER BY period RANGE BETWEEN INTERVAL '{int(count)}' {unit} PRECEDING AND CURRENT ROW)")
    elif metric.to_date:
        spec = W.partitionBy(*others, F.date_trunc(metric.to_date, "period")).orderBy("period").rowsBetween(W.unboundedPreceding, 0)
        total = F.sum(value).over(spec)
    else:
        raise MetricError("metric_invalid", "a window or a grain is missing")
    return series.select(*others, "period", total.alias(value))


def compared(series: DataFrame, months: int, value: str = "value") -> DataFrame:
    """Each period beside the one so many months before: value, previous, and the relative change, null where there is none."""
    keys = [c for c in series.columns if c != value]
    before = series.select(*[(F.col("period") + F.make_interval(months=F.lit(months))).cast("timestamp_ntz").alias("period") if c == "period" else c for c in keys], F.col(value).alias("previous"))
    joined = series.join(before, keys, "left")
    return joined.select(*keys, value, "previous", ((F.col(value) - F.col("previous")) / F.when(F.col("previous") != 0, F.col("previous"))).alias("change"))
