"""Reports that many ask for, composed of the operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..frame import PointFrame
from ..functions.aggregators import MEAN, SUM, Aggregator
from ..functions.baseline import Baseline
from ..functions.periods import MONTH, Period
from ..operators.base import run
from ..operators.combine import combine
from ..operators.forecast import SEASON_END, Forecast, MeanModel
from ..operators.groups import GroupBy
from ..operators.resample import CARRY, INTERPOLATE, LEAVE, ZERO, Resample
from ..operators.windows import Cumulative, Rolling
from .spec import PERCENT, Comparison, Report


def acute_to_chronic(daily: PointFrame, acute_days: int = 7, chronic_days: int = 28) -> PointFrame:
    """A short rolling mean over a long one, for each key and day."""
    short, long = (run(daily, [Rolling(dt.timedelta(days=n), MEAN)]) for n in (acute_days, chronic_days))
    return combine(short, long, lambda a, b: F.try_divide(a, b), unit="ratio")


def moving_target(points: PointFrame, target: PointFrame) -> PointFrame:
    """Each value as a percentage of a target that has its own value for every key and time."""
    return combine(points, target, lambda v, t: F.try_divide(v * 100, t), unit="%")


def year_on_year(report: Report, period: Period = MONTH, agg: Aggregator = SUM) -> Report:
    """The change of each bucket since a year earlier, in percent."""
    return report.with_(transforms=(Resample(period, agg), GroupBy(agg)), comparison=Comparison(Baseline(1, "year"), PERCENT))


def on_pace(report: Report, percent: float | None = 80) -> Report:
    """The running total by month, projected to the season's end."""
    return report.with_(transforms=(Resample(MONTH, SUM, ZERO), GroupBy(SUM), Forecast(MeanModel(), SEASON_END, percent, running_total=True)))


def running_total(report: Report) -> Report:
    return report.with_(transforms=(Resample(MONTH, SUM, ZERO), GroupBy(SUM), Cumulative(SUM)))


def gap_policies(report: Report, period: Period, agg: Aggregator) -> dict[str, Report]:
    """The same report under each way to treat empty buckets."""
    return {gap: report.with_(transforms=(Resample(period, agg, gap),)) for gap in (LEAVE, ZERO, CARRY, INTERPOLATE)}
