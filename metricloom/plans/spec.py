"""Reports, charts and views as data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.baseline import Baseline
from ..operators.base import Transform
from ..timeaxis import Calendar, Timeframe

KINDS = ("line", "area", "column", "bar", "pie", "scatter", "sparkline", "table")
BASELINE, DIFFERENCE, PERCENT = OUTPUTS = ("baseline", "difference", "percent")
GOOD, WATCH, BAD, NEUTRAL = ("good", "watch", "bad", "neutral")


class StatusRule:
    """What a value means.  Rules of one kind with equal settings must be equal, as frozen dataclasses are."""

    def column(self, value: Column) -> Column:
        """The status of a value that is not missing, as one of the four names."""
        raise NotImplementedError

    def marked(self) -> list[tuple[str, str, float | None, float | None]]:
        """Ranges that a chart shows: label, status, from and to (None: without end)."""
        return []


@dataclass(frozen=True)
class TargetBand(StatusRule):
    """Good from low to high, Watch within the margin outside, else Bad; missing is Neutral."""

    low: float
    high: float
    margin: float = 0.0

    def status(self, value: float | None) -> str:
        if value is None:
            return NEUTRAL
        if self.low <= value <= self.high:
            return GOOD
        return WATCH if self.low - self.margin <= value <= self.high + self.margin else BAD

    def column(self, value):
        near = F.when(value.between(self.low - self.margin, self.high + self.margin), WATCH).otherwise(BAD)
        return F.when(value.between(self.low, self.high), GOOD).otherwise(near)

    def marked(self):
        return [("target", GOOD, self.low, self.high)]


@dataclass(frozen=True)
class Steps(StatusRule):
    """Statuses by limits: below the first limit the first status, from each limit on the next one."""

    limits: tuple[float, ...]
    statuses: tuple[str, ...]

    def __post_init__(self):
        if list(self.limits) != sorted(set(self.limits)) or len(self.statuses) != len(self.limits) + 1 or not set(self.statuses) <= {GOOD, WATCH, BAD, NEUTRAL}:
            raise ValueError("steps are ascending limits and one status more than limits")

    def column(self, value):
        out = F.lit(self.statuses[0])
        for limit, status in zip(self.limits, self.statuses[1:]):
            out = F.when(value >= limit, status).otherwise(out)
        return out

    def marked(self):
        ends = (None, *self.limits, None)
        return [(status, status, low, high) for status, low, high in zip(self.statuses, ends, ends[1:])]


@dataclass(frozen=True)
class View:
    kind: str = "line"
    x: str = "time"
    series_by: str | None = None
    title: str | None = None
    unit: str | None = None
    status: StatusRule | None = None
    stacked: bool = False

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"a chart is one of {', '.join(KINDS)}")


@dataclass(frozen=True)
class Comparison:
    """``baseline`` shows the earlier values on this report's axis, the others the change since."""

    baseline: Baseline
    output: str = BASELINE

    def __post_init__(self):
        if self.output not in OUTPUTS:
            raise ValueError(f"a comparison shows one of {', '.join(OUTPUTS)}")


@dataclass(frozen=True)
class Report:
    """One metric for some entities (None: all of the source's) over a timeframe, through transforms, as a view."""

    metric: str
    timeframe: Timeframe | None = None
    entities: tuple[int, ...] | None = None
    transforms: tuple[Transform, ...] = ()
    view: View = View()
    dimensions: tuple[str, ...] = ()
    minimum_denominator: float | None = None
    comparison: Comparison | None = None
    tenant: str = "default"

    def __post_init__(self):
        if self.entities is not None and not self.entities:
            raise ValueError("a report has at least one entity, or None for all")
        if self.minimum_denominator is not None and not 0 < self.minimum_denominator < float("inf"):
            raise ValueError("a minimum denominator is positive and finite")

    def with_(self, **changes) -> Report:
        return replace(self, **changes)


@dataclass(frozen=True)
class Series:
    report: Report
    name: str | None = None
    secondary: bool = False
    color: str | None = None


@dataclass(frozen=True)
class Chart:
    series: tuple[Series, ...]
    title: str | None = None


@dataclass(frozen=True)
class DashboardContext:
    """What a dashboard is about: tenant, entities, timeframe, and one entity in focus."""

    timeframe: Timeframe
    entities: tuple[int, ...] | None = None
    focus: int | None = None
    tenant: str = "default"
    calendar: Calendar = field(default_factory=Calendar)

    def focused(self, entity: int | None) -> DashboardContext:
        return replace(self, focus=entity)

    @property
    def shown(self) -> tuple[int, ...] | None:
        return self.entities if self.focus is None else (self.focus,)


@dataclass(frozen=True)
class Dashboard:
    title: str
    build: Callable[[DashboardContext], list[Chart]]
