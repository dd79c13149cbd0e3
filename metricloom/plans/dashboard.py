"""Dashboards written as JSON; every error says where it is."""

from __future__ import annotations

import json
import math
from datetime import timedelta

from ..functions.aggregators import Aggregator, try_resolve
from ..functions.baseline import UNITS, Baseline
from ..functions.periods import Period, period_named
from ..operators.base import Transform, WhereIn, WhereNotIn, WhereValue
from ..operators.forecast import SEASON_END, Forecast, HoltWintersModel, Horizon, MeanModel, SeasonalNaiveModel, TrendModel
from ..operators.groups import GroupBy, Total
from ..operators.resample import GAPS, LEAVE, OBSERVED, SPANS, Resample
from ..operators.windows import Cumulative, Ranked, Rolling, ShareOf
from .spec import BASELINE, KINDS, OUTPUTS, Chart, Comparison, Dashboard, DashboardContext, Report, Series, View


class DefinitionError(ValueError):
    def __init__(self, path: str, problem: str):
        super().__init__(f"{path}: {problem}" if path else problem)
        self.path = path


class Node:
    """A JSON object at a path; property names ignore case."""

    def __init__(self, value, path: str):
        if not isinstance(value, dict):
            raise DefinitionError(path, "expected an object")
        self.values, self.path = {k.lower(): v for k, v in value.items()}, path

    def at(self, name: str) -> str:
        return f"{self.path}.{name}" if self.path else name

    def get(self, name: str, kind: type | tuple[type, ...], default=None, needed: bool = False):
        value = self.values.get(name.lower())
        if value is None:
            if needed:
                raise DefinitionError(self.at(name), "is needed")
            return default
        if not isinstance(value, kind) or (isinstance(value, bool) and kind is not bool):
            raise DefinitionError(self.at(name), f"has the wrong type: {value!r}")
        return value

    def one_of(self, name: str, choices, default=None, needed: bool = False) -> str:
        value = self.get(name, str, default, needed)
        if value is not None and value not in choices:
            raise DefinitionError(self.at(name), f"'{value}' is none of {', '.join(choices)}")
        return value

    def texts(self, name: str, needed: bool = False) -> tuple[str, ...] | None:
        values = self.get(name, list, None, needed)
        if values is None:
            return None
        for i, v in enumerate(values):
            if isinstance(v, bool) or not isinstance(v, (str, int)):
                raise DefinitionError(f"{self.at(name)}[{i}]", "expected text")
        return tuple(str(v) for v in values)

    def objects(self, name: str, needed: bool = False) -> list[Node]:
        values = self.get(name, list, [], needed)
        if needed and not values:
            raise DefinitionError(self.at(name), "must not be empty")
        return [Node(v, f"{self.at(name)}[{i}]") for i, v in enumerate(values)]

    def positive(self, name: str, default=None, needed: bool = False, whole: bool = True):
        value = self.get(name, int if whole else (int, float), default, needed)
        if value is not None and not (value > 0 and math.isfinite(value)):
            raise DefinitionError(self.at(name), "must be positive")
        return value

    def aggregator(self) -> Aggregator:
        name = self.get("aggregator", str, needed=True)
        found = try_resolve(name)
        if found is None:
            raise DefinitionError(self.at("aggregator"), f"unknown aggregator '{name}'")
        return found


def _resample(n: Node) -> Transform:
    name = n.get("period", str, needed=True)
    period: Period | None = period_named(name)
    if period is None:
        raise DefinitionError(n.at("period"), f"unknown period '{name}'")
    return Resample(period, n.aggregator(), n.one_of("gap", GAPS, LEAVE), n.one_of("across", SPANS, OBSERVED))


def _where(n: Node) -> Transform:
    dim, inside, outside = n.get("dimension", str, needed=True), n.texts("in"), n.texts("notIn")
    if (inside is None) == (outside is None):
        raise DefinitionError(n.path, "needs exactly one of in and notIn")
    return WhereIn(dim, inside) if inside is not None else WhereNotIn(dim, outside)


def _range(n: Node) -> Transform:
    low, high = n.get("min", (int, float)), n.get("max", (int, float))
    if low is None and high is None:
        raise DefinitionError(n.path, "needs min or max")
    return WhereValue(low, high)


def _share(n: Node) -> Transform:
    by = n.texts("by", needed=True)
    if not by:
        raise DefinitionError(n.at("by"), "must not be empty")
    return ShareOf(by)


def _forecast(n: Node) -> Transform:
    season = n.positive("season")
    name = n.one_of("model", ("mean", "trend", "seasonal-naive", "holt-winters"), needed=True)
    if name == "seasonal-naive" and season is None:
        raise DefinitionError(n.at("season"), "is needed")
    if name in ("mean", "trend") and season is not None:
        raise DefinitionError(n.at("season"), f"means nothing to the model '{name}'")
    model = {"mean": MeanModel, "trend": TrendModel}[name]() if name in ("mean", "trend") else {"seasonal-naive": SeasonalNaiveModel, "holt-winters": HoltWintersModel}[name](season)
    buckets, until = n.positive("n"), n.one_of("until", ("season-end",))
    if (buckets is None) == (until is None):
        raise DefinitionError(n.path, "needs exactly one of n and until")
    percent = n.get("range", (int, float))
    if percent is not None and not 0 < percent < 100:
        raise DefinitionError(n.at("range"), "must lie between 0 and 100")
    return Forecast(model, SEASON_END if until else Horizon(buckets), percent, n.get("runningTotal", bool, False))


TRANSFORMS = {
    "resample": _resample,
    "rolling": lambda n: Rolling(timedelta(days=n.positive("days", needed=True, whole=False)), n.aggregator()),
    "groupBy": lambda n: GroupBy(n.aggregator(), n.texts("by") or ()),
    "total": lambda n: Total(n.aggregator(), n.texts("by") or ()),
    "where": _where,
    "range": _range,
    "share": _share,
    "cumulative": lambda n: Cumulative(n.aggregator()),
    "top": lambda n: Ranked(n.positive("n", needed=True), n.aggregator(), n.texts("by") or (), True),
    "bottom": lambda n: Ranked(n.positive("n", needed=True), n.aggregator(), n.texts("by") or (), False),
    "forecast": _forecast,
}


def _transform(n: Node) -> Transform:
    return TRANSFORMS[n.one_of("kind", tuple(TRANSFORMS), needed=True)](n)


def _view(series: Node) -> View:
    value = series.get("view", dict)
    if value is None:
        return View()
    n = Node(value, series.at("view"))
    return View(n.one_of("kind", KINDS, "line"), n.get("x", str, "time"), n.get("seriesBy", str), n.get("title", str), stacked=n.get("stacked", bool, False))


def _comparison(series: Node) -> Comparison | None:
    value = series.get("compare", dict)
    if value is None:
        return None
    n = Node(value, series.at("compare"))
    return Comparison(Baseline(n.positive("back", 1), n.one_of("unit", UNITS, needed=True)), n.one_of("show", OUTPUTS, BASELINE))


def _series(n: Node):
    metric, name = n.get("metric", str, needed=True), n.get("name", str)
    secondary = n.one_of("axis", ("primary", "secondary"), "primary") == "secondary"
    transforms = tuple(_transform(t) for t in n.objects("transforms"))
    view, compare, dims = _view(n), _comparison(n), n.texts("dimensions") or ()
    least = n.positive("minimumDenominator", whole=False)

    def build(context: DashboardContext) -> Series:
        report = Report(metric, context.timeframe, context.shown, transforms, view, dims, least, compare, context.tenant)
        return Series(report, name, secondary)

    return build


def parse(text: str) -> Dashboard:
    """A dashboard from its JSON definition."""
    try:
        root = Node(json.loads(text), "")
    except json.JSONDecodeError as error:
        raise DefinitionError("", f"not JSON: {error}") from None
    charts = []
    for c in root.objects("charts", needed=True):
        charts.append((c.get("title", str), [_series(s) for s in c.objects("series", needed=True)]))

    def build(context: DashboardContext) -> list[Chart]:
        return [Chart(tuple(s(context) for s in series), title) for title, series in charts]

    return Dashboard(root.get("title", str, ""), build)
