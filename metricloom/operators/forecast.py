"""Forecasts that continue each key's buckets, with prediction ranges.

A key's buckets become one array in time order; the models run on batches of such arrays (NumPy in an Arrow
function), and the projections are exploded again.  A key's series is bounded by its number of buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import AT, ESTIMATED, HIGH, LOW, VALUE, PointFrame
from ..functions.aggregators import SUM
from ..functions.periods import SEASON
from ..functions.statistics import normal_quantile, student_t_quantile
from ..timeaxis import Context
from .base import Transform
from .resample import densified
from .windows import Cumulative

#: The smoothing factors that Holt-Winters tries, and by how much a fit must be better to replace an earlier one.
FACTORS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
BETTER = 1e-12


@dataclass(frozen=True)
class Outlook:
    """Values ahead, and how their errors arise: value h is off by sigma times the sum of weights[h][i] * z_i, plus
    the shared terms of the fit in ``common`` (covariance of the fitted values, in units of sigma squared)."""

    values: np.ndarray
    sigma: float | None = None
    weights: np.ndarray | None = None
    common: np.ndarray | None = None
    freedom: float | None = None

    def half_widths(self, percent: float, total: bool) -> np.ndarray | None:
        """Of each value, or of the running sum up to it."""
        if self.sigma is None:
            return None
        covariance = self.weights @ self.weights.T
        if self.common is not None:
            covariance = covariance + self.common
        if total:
            variance = np.cumsum(np.cumsum(covariance, axis=0), axis=1).diagonal()
        else:
            variance = covariance.diagonal()
        p = 0.5 + percent / 200
        q = normal_quantile(p) if self.freedom is None else student_t_quantile(p, self.freedom)
        return q * self.sigma * np.sqrt(variance)


class Model:
    least_history = 1

    def ahead(self, y: np.ndarray, steps: int) -> Outlook:
        raise NotImplementedError


@dataclass(frozen=True)
class MeanModel(Model):
    """The average of the history."""

    def ahead(self, y, steps):
        values, n = np.full(steps, y.mean()), len(y)
        if n < 2:
            return Outlook(values)
        return Outlook(values, math.sqrt(((y - y.mean()) ** 2).sum() / (n - 1)), np.eye(steps), np.full((steps, steps), 1 / n), n - 1)


@dataclass(frozen=True)
class TrendModel(Model):
    """The least-squares line over bucket indexes."""

    least_history = 3

    def ahead(self, y, steps):
        n = len(y)
        x = np.arange(n) - (n - 1) / 2
        sxx = (x * x).sum()
        slope = (x * y).sum() / sxx
        future = n + np.arange(steps) - (n - 1) / 2
        rest = ((y - y.mean() - slope * x) ** 2).sum()
        return Outlook(y.mean() + slope * future, math.sqrt(rest / (n - 2)), np.eye(steps), 1 / n + np.outer(future, future) / sxx, n - 2)


@dataclass(frozen=True)
class SeasonalNaiveModel(Model):
    """The value one season earlier, again and again."""

    season: int

    @property
    def least_history(self):
        return self.season

    def ahead(self, y, steps):
        m, h = self.season, np.arange(steps)
        values, changes = y[len(y) - m + h % m], y[m:] - y[:-m]
        if not len(changes):
            return Outlook(values)
        weights = ((h[:, None] >= h[None, :]) & ((h[:, None] - h[None, :]) % m == 0)).astype(float)
        return Outlook(values, math.sqrt((changes**2).mean()), weights, None, len(changes))


@dataclass(frozen=True)
class HoltWintersModel(Model):
    """Additive exponential smoothing of level, trend and (with a season) seasonal terms.

    All combinations of factors run side by side as arrays; the first that is better by more than BETTER
    than all before it wins.
    """

    season: int | None = None

    @property
    def least_history(self):
        return 4 if self.season is None else 2 * self.season

    def ahead(self, y, steps):
        m, n = self.season or 0, len(y)
        grids = np.meshgrid(FACTORS, FACTORS, FACTORS if m else (0.0,), indexing="ij")
        alpha, beta, gamma = (g.ravel() for g in grids)
        if m:
            first, second = y[:m].mean(), y[m : 2 * m].mean()
            slope = (second - first) / m
            level = np.full(alpha.shape, first + slope * (m - 1) / 2)
            terms = np.repeat((y[:m] - first - slope * (np.arange(m) - (m - 1) / 2))[:, None], len(alpha), axis=1)
            begin = m
        else:
            slope, begin = y[1] - y[0], 1
            level, terms = np.full(alpha.shape, y[0]), np.zeros((1, len(alpha)))
        trend, loss = np.full(alpha.shape, slope), np.zeros(alpha.shape)
        for t in range(begin, n):
            s = terms[t % m].copy() if m else terms[0]
            loss += (y[t] - level - trend - s) ** 2
            before = level
            level = alpha * (y[t] - s) + (1 - alpha) * (level + trend)
            trend = beta * (level - before) + (1 - beta) * trend
            if m:
                terms[t % m] = gamma * (y[t] - level) + (1 - gamma) * s
        best, least = 0, math.inf
        for i, x in enumerate(loss):
            if x < least - BETTER:
                best, least = i, float(x)
        h = np.arange(1, steps + 1)
        values = level[best] + h * trend[best] + (terms[(n - 1 + h) % m, best] if m else 0)
        if n - begin < 2:
            return Outlook(values)
        a, b, g = alpha[best], beta[best], gamma[best]
        lag = h[:, None] - h[None, :]
        effect = a * (1 + lag * b) + (np.where(lag % m == 0, g * (1 - a), 0) if m else 0)
        return Outlook(values, math.sqrt(least / (n - begin)), np.where(lag > 0, effect, lag == 0).astype(float))


@dataclass(frozen=True)
class Horizon:
    """A number of buckets ahead, or up to the end of the season that holds the latest bucket."""

    buckets: int | None = None

    def end(self, latest: Column, frame: PointFrame, context: Context) -> Column:
        """The last bucket to project."""
        period = frame.axis.grain
        if self.buckets is not None:
            return period.after(latest, self.buckets)
        season = SEASON.on(context.calendar)
        following = season.following(season.bucket(latest, context.calendar))
        return F.array_max(F.filter(period.series(latest, following), lambda b: b < following))


SEASON_END = Horizon()


def bridged(values: list[float | None]) -> np.ndarray:
    """Straight lines over gaps, flat before the first value and after the last."""
    y = np.array([np.nan if v is None else v for v in values], float)
    known = np.flatnonzero(~np.isnan(y))
    return np.interp(np.arange(len(y)), known, y[known]) if len(known) else y[:0]


@dataclass(frozen=True)
class Forecast(Transform):
    """Appends projected buckets, marked as estimates.

    All keys get the same future buckets: those after the latest bucket of any key, up to the horizon.  Each
    key projects from its own last bucket, with gaps bridged for the fit only; keys without a value or with
    fewer buckets than the model needs get none.  ``range`` (percent) adds low and high.  A running total
    turns the history into its cumulative sum and continues that.
    """

    model: Model
    horizon: Horizon
    range: float | None = None
    running_total: bool = False

    def __post_init__(self):
        if self.range is not None and not 0 < self.range < 100:
            raise ValueError("a range is a percentage between 0 and 100")

    def apply(self, frame, context=Context()):
        frame.refuse_ranges("another forecast")
        period = frame.axis.grain
        if period is None:
            raise ValueError("a forecast continues buckets; resample first")
        keys = list(frame.keys)
        rows = frame.df.where(F.col(AT).isNotNull())
        latest = rows.agg(F.max(AT).alias("_latest"))
        dense = densified(rows.select(*keys, AT, VALUE), keys, period)
        series = dense.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(AT, VALUE))).alias("_s"), F.max(AT).alias("_last"))
        series = series.withColumn("_latest", latest.scalar()).withColumn("_end", self.horizon.end(F.col("_latest"), frame, context))
        own = F.slice(period.series(F.col("_last"), F.col("_end")), F.lit(2), F.greatest(F.size(period.series(F.col("_last"), F.col("_end"))) - 1, F.lit(0)))
        series = series.withColumn("_future", own)
        projected = series.withColumn("_p", self._project(F.transform("_s", lambda x: x[VALUE]), F.size("_future")))
        pairs = projected.where("_p is not null").select(*keys, "_latest", F.explode(F.arrays_zip("_future", F.col("_p.value").alias("value"), F.col("_p.low").alias("low"), F.col("_p.high").alias("high"))).alias("_f"))
        future = pairs.select(*keys, "_latest", F.col("_f._future").alias(AT), *[F.col(f"_f.{c}").alias(c) for c in (VALUE, LOW, HIGH)]).where(F.col(AT) > F.col("_latest"))
        future = future.withColumn(ESTIMATED, F.lit(True)).drop("_latest")
        history = Cumulative(SUM).apply(frame, context) if self.running_total else frame.having(rows)
        past = history.df if frame.estimates else history.df.withColumn(ESTIMATED, F.lit(False))
        past = past.withColumns({c: F.lit(None).cast("double") for c in (LOW, HIGH)})
        columns = [*keys, AT, VALUE, ESTIMATED, LOW, HIGH]
        return frame.having(past.select(columns).unionByName(future.select(columns)), estimates=True, ranged=self.range is not None)

    def _project(self, values: Column, steps: Column) -> Column:
        model, percent, total = self.model, self.range, self.running_total

        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for histories, counts in batches:
                out = {"value": [], "low": [], "high": []}
                for history, n in zip(histories, counts):
                    y = bridged(list(history))
                    if not len(y) or len(y) < model.least_history:
                        for column in out.values():
                            column.append(None)
                        continue
                    outlook = model.ahead(y, int(n))
                    made = outlook.values
                    if total:
                        made = sum(v for v in history if v is not None and v == v) + np.cumsum(made)
                    half = None if percent is None else outlook.half_widths(percent, total)
                    out["value"].append(made.tolist())
                    out["low"].append([None] * int(n) if half is None else (made - half).tolist())
                    out["high"].append([None] * int(n) if half is None else (made + half).tolist())
                yield pd.DataFrame(out)

        run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
        return F.pandas_udf(run, "value array<double>, low array<double>, high array<double>")(values, steps)
