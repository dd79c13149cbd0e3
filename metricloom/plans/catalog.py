"""The metric catalog: stored metrics, and ratios and weighted sums of them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from ..functions.aggregators import MEAN, SUM, Aggregator
from ..timeaxis import INSTANT

ADDITIVE, SEMI_ADDITIVE = "additive", "semi-additive"


@dataclass(frozen=True)
class Ratio:
    """Total of one metric over the total of another, times a scale."""

    numerator: str
    denominator: str
    scale: float = 1.0
    agg: Aggregator = SUM

    @property
    def inputs(self) -> tuple[str, ...]:
        return (self.numerator, self.denominator)


@dataclass(frozen=True)
class Linear:
    """A weighted sum of totals.  With ``need_all`` a missing input gives no value; else it counts as zero."""

    terms: tuple[tuple[str, float], ...]
    need_all: bool = False
    agg: Aggregator = SUM

    @property
    def inputs(self) -> tuple[str, ...]:
        return tuple(m for m, _ in self.terms)


@dataclass(frozen=True)
class Metric:
    id: str
    name: str = ""
    unit: str | None = None
    agg: Aggregator = MEAN
    dimensions: tuple[str, ...] = ()
    grain: str | None = None
    time_kind: str = INSTANT
    formula: Ratio | Linear | None = None
    additivity: str = ADDITIVE

    @property
    def title(self) -> str:
        return self.name or self.id


def sum_of(*metrics: str, need_all: bool = False) -> Linear:
    return Linear(tuple((m, 1.0) for m in metrics), need_all)


def difference_of(minuend: str, subtrahend: str, need_all: bool = False) -> Linear:
    return Linear(((minuend, 1.0), (subtrahend, -1.0)), need_all)


class Catalog:
    def __init__(self, metrics: Iterable[Metric]):
        self.metrics: dict[str, Metric] = {}
        for m in metrics:
            if m.id in self.metrics:
                raise ValueError(f"metric '{m.id}' is defined twice")
            self.metrics[m.id] = m
        for m in self.metrics.values():
            self._check(m)

    def __getitem__(self, metric: str) -> Metric:
        if metric not in self.metrics:
            raise ValueError(f"unknown metric '{metric}'; there are {', '.join(self.metrics)}")
        return self.metrics[metric]

    def _check(self, m: Metric) -> None:
        if m.additivity not in (ADDITIVE, SEMI_ADDITIVE):
            raise ValueError(f"metric '{m.id}' has no such additivity: {m.additivity}")
        if m.formula is None:
            return
        inputs = m.formula.inputs
        if not inputs or len(set(inputs)) < len(inputs):
            raise ValueError(f"metric '{m.id}' needs inputs, each once")
        for name in inputs:
            source = self[name]
            if source.formula is not None:
                raise ValueError(f"metric '{m.id}' is derived from '{name}', which is derived itself")
            if source.time_kind != m.time_kind:
                raise ValueError(f"metric '{m.id}' and its input '{name}' have different kinds of time")
            if lacking := set(m.dimensions) - set(source.dimensions):
                raise ValueError(f"input '{name}' of metric '{m.id}' has no dimension {', '.join(sorted(lacking))}")
