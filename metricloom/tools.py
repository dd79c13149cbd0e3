"""Bounded entry points for hosts and agents: describe the catalog, run a small typed query, map a request."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from .functions.aggregators import MEAN, SUM, try_resolve
from .functions.chart_json import dumps
from .functions.periods import WEEK, period_named
from .operators.base import Transform, WhereIn, WhereValue
from .operators.groups import Total
from .operators.resample import GAPS, LEAVE, Resample
from .operators.windows import Rolling
from .plans.catalog import Metric
from .plans.engine import Engine
from .plans.spec import KINDS, Report, TargetBand, View
from .timeaxis import Timeframe

#: The longest look back, the kinds of charts, and the named recipes of a query.
MOST_DAYS = 400
CHARTS = ("line", "column", "area")
RECIPES = {
    "raw": (),
    "weekly-mean": (Resample(WEEK, MEAN),),
    "weekly-sum": (Resample(WEEK, SUM),),
    "rolling7-mean": (Rolling(dt.timedelta(days=7), MEAN),),
    "rolling28-mean": (Rolling(dt.timedelta(days=28), MEAN),),
}


def described(metric: Metric) -> dict:
    return {"id": metric.id, "name": metric.title, "unit": metric.unit, "grain": metric.grain, "dimensions": list(metric.dimensions)}


def describe(engine: Engine) -> dict:
    """What a query may ask for."""
    return {"metrics": [described(m) for m in engine.catalog.metrics.values()], "transforms": list(RECIPES), "chart_kinds": list(CHARTS)}


def past(days: int, now: dt.datetime | None) -> Timeframe:
    """So many whole days and today, by the UTC clock; from 1 to MOST_DAYS."""
    moment = now or dt.datetime.now(dt.timezone.utc)
    tomorrow = dt.datetime.combine(moment.date() + dt.timedelta(days=1), dt.time())
    return Timeframe(tomorrow - dt.timedelta(days=1 + sorted((1, days, MOST_DAYS))[1]), tomorrow)


def query(engine: Engine, metric: str, entities: list[int], past_days: int = 28, transform: str = "raw", chart: str = "line", now: dt.datetime | None = None) -> str:
    """The chart of a metric over the past days as JSON, a series for each entity; unknown transforms are raw, unknown charts lines."""
    formula = engine.catalog[metric].formula
    entity = engine.source(formula.inputs[0] if formula else metric).entity
    asked = Report(metric, past(past_days, now), tuple(entities), RECIPES.get(transform, RECIPES["raw"]), View(chart if chart in CHARTS else CHARTS[0], series_by=entity))
    return dumps(engine.run(asked))


def request_to_report(request: Mapping, entity: str = "entity", now: dt.datetime | None = None) -> Report:
    """A report from a plain request.

    ``metric`` and ``entities`` say what, ``from`` and ``to``, or ``pastDays``, when.  ``min`` and ``max`` keep
    values between them, ``where`` ({dimension: value or values}) keeps categories.  ``groupBy`` makes a column
    for each value of a dimension; without it ``transform`` (with ``period``, ``aggregator``, ``gap``, ``days``)
    makes a chart over time, with a series for each value of ``seriesBy`` and ``status`` ({low, high, margin}; by
    default half the band's width is the margin).  ``entity`` is the source's name for entities.
    As in ``query`` what is not known falls back: to raw points, the mean, no gap filling, a line.
    """
    agg = try_resolve(request.get("aggregator") or "mean") or MEAN
    gap = request.get("gap") if request.get("gap") in GAPS else LEAVE
    period = period_named(request.get("period") or "week") or WEEK
    kind = request.get("transform")
    transforms: list[Transform] = []
    if request.get("min") is not None or request.get("max") is not None:
        transforms.append(WhereValue(request.get("min"), request.get("max")))
    wanted = request.get("where") or {}
    for dim, values in wanted.items():
        transforms.append(WhereIn(dim, tuple(values) if isinstance(values, (list, tuple)) else (values,)))
    group, series = request.get("groupBy"), request.get("seriesBy")
    if group:
        transforms.append(Total(agg, (group,)))
        view = View("column", x=group)
    else:
        if kind == "resample":
            transforms.append(Resample(period, agg, gap))
        elif kind == "rolling":
            transforms.append(Rolling(dt.timedelta(days=max(1, int(request.get("days") or 7))), agg))
        chart = request.get("chart") if request.get("chart") in KINDS else "line"
        view = View(chart, series_by=series, status=_band(request.get("status")))
    shown = (*wanted, group, None if group else series)
    dims = tuple(d for d in dict.fromkeys(shown) if d and d != entity)
    if request.get("from") is None:
        frame = past(int(request.get("pastDays") or 28), now)
    else:
        frame = Timeframe(dt.datetime.fromisoformat(request["from"]), dt.datetime.fromisoformat(request["to"]))
    return Report(request["metric"], frame, tuple(int(e) for e in request["entities"]), tuple(transforms), view, dims)


def _band(status: Mapping | None) -> TargetBand | None:
    if not status:
        return None
    low, high = float(status["low"]), float(status["high"])
    margin = status.get("margin")
    return TargetBand(low, high, (high - low) / 2 if margin is None else float(margin))
