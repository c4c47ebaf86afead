"""Requests as frozen values; each checks its bounds when made."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from typing import Any

from tidemark.functions.expressions import GRANULARITIES

#: Fixed values of the interface.
AGGREGATIONS = ("sum", "mean", "median", "min", "max", "std", "count")
FILTER_OPS = ("eq", "neq", "gt", "gte", "lt", "lte", "in", "between")


def _within(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}, not {value}")


def _one_of(name: str, value: str, known: tuple[str, ...]) -> None:
    if value not in known:
        raise ValueError(f"{name} must be one of {', '.join(known)}, not {value!r}")


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any

    def __post_init__(self) -> None:
        _one_of("op", self.op, FILTER_OPS)


@dataclass(frozen=True)
class Metric:
    column: str
    aggregation: str
    alias: str | None = None

    def __post_init__(self) -> None:
        _one_of("aggregation", self.aggregation, AGGREGATIONS)

    @property
    def label(self) -> str:
        return self.alias or f"{self.column}_{self.aggregation}"


@dataclass(frozen=True)
class AggregationQuery:
    metrics: list[Metric]
    dimensions: list[str] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    sort_by: str | None = None
    descending: bool = True
    limit: int = 100
    offset: int = 0

    def __post_init__(self) -> None:
        _within("number of metrics", len(self.metrics), 1, 20)
        _within("number of dimensions", len(self.dimensions), 0, 10)
        _within("number of filters", len(self.filters), 0, 20)
        _within("limit", self.limit, 1, 1000)
        _within("offset", self.offset, 0, 50_000)


@dataclass(frozen=True)
class TimeSeriesQuery:
    date_column: str
    metric: Metric
    granularity: str = "month"
    rolling: int | None = None
    cumulative: bool = False
    growth: bool = False
    filters: list[Filter] = field(default_factory=list)

    def __post_init__(self) -> None:
        _one_of("granularity", self.granularity, GRANULARITIES)
        if self.rolling is not None:
            _within("rolling", self.rolling, 2, 365)


@dataclass(frozen=True)
class BreakdownQuery:
    dimension: str
    metric: Metric | None = None
    top_n: int = 10
    include_other: bool = False
    filters: list[Filter] = field(default_factory=list)

    def __post_init__(self) -> None:
        _within("top_n", self.top_n, 1, 100)


@dataclass(frozen=True)
class CrossTabQuery:
    row: str
    column: str
    metric: Metric | None = None
    filters: list[Filter] = field(default_factory=list)


@dataclass(frozen=True)
class AnomalyRequest:
    date_column: str
    metric_column: str
    aggregation: str = "sum"
    cadence: str = "day"
    sensitivity: str = "medium"
    window: int = 7

    def __post_init__(self) -> None:
        _one_of("aggregation", self.aggregation, ("sum", "mean"))
        _one_of("cadence", self.cadence, ("day", "week", "month"))
        _one_of("sensitivity", self.sensitivity, ("low", "medium", "high"))
        _within("window", self.window, 3, 30)


@dataclass(frozen=True)
class ForecastRequest:
    date_column: str
    metric_column: str
    aggregation: str = "sum"
    cadence: str = "day"
    horizon: int = 30
    allow_negative: bool = False

    def __post_init__(self) -> None:
        _one_of("aggregation", self.aggregation, ("sum", "mean"))
        _one_of("cadence", self.cadence, ("day", "week", "month"))
        _within("horizon", self.horizon, 1, 365)


@dataclass(frozen=True)
class RCARequest:
    date_column: str
    metric_column: str
    event_start: date
    event_end: date
    aggregation: str = "sum"
    baseline_start: date | None = None
    baseline_end: date | None = None
    dimensions: list[str] | None = None
    secondary: list[str] | None = None
    max_dimensions: int = 3
    top_k: int = 5

    def __post_init__(self) -> None:
        _one_of("aggregation", self.aggregation, ("sum", "avg", "count"))
        _within("max_dimensions", self.max_dimensions, 1, 3)
        _within("top_k", self.top_k, 1, 20)
        if self.event_start > self.event_end:
            raise ValueError("event_start lies after event_end")
        if self.baseline_start and self.baseline_end and self.baseline_start > self.baseline_end:
            raise ValueError("baseline_start lies after baseline_end")


@dataclass(frozen=True)
class CleaningConfig:
    remove_duplicates: bool = True
    normalize_names: bool = True
    numeric_nulls: str = "median"  # median, mean, zero, none
    categorical_nulls: str = "mode"  # mode, unknown, none
    normalize_categories: bool = True
    convert_types: bool = True
    outliers: str = "report"  # report, cap, none
    check_references: bool = True
