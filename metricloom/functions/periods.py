"""Periods: how a local time falls into buckets, and which buckets follow each other."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..timeaxis import NTZ, Calendar, Seasons, literal, micros

DAY_SECONDS = 86_400


class Period:
    """``bucket`` maps a local time to its bucket's start; ``after`` steps n buckets on."""

    name: str

    def on(self, calendar: Calendar) -> Period:
        """The period as a calendar has it."""
        return self

    def bucket(self, at: Column, calendar: Calendar) -> Column:
        raise NotImplementedError

    def after(self, at: Column, n: int | Column = 1) -> Column:
        raise NotImplementedError

    def following(self, at: Column) -> Column:
        """Where the bucket that starts at ``at`` ends."""
        return self.after(at)

    def series(self, first: Column, last: Column) -> Column:
        """The array of bucket starts from ``first`` to ``last``, both inclusive; empty if reversed."""
        steps = F.sequence(first, last, self.step())
        return F.when(first <= last, steps).otherwise(F.array().cast("array<timestamp_ntz>"))

    def step(self) -> Column:
        raise NotImplementedError

    def label(self, at: Column) -> Column:
        return F.date_format(at, "yyyy-MM-dd")


@dataclass(frozen=True)
class Span(Period):
    """A number of seconds that divides a day, aligned to local midnight."""

    seconds: int

    def __post_init__(self):
        if self.seconds <= 0 or DAY_SECONDS % self.seconds:
            raise ValueError("a span must divide a day")

    @property
    def name(self) -> str:
        for unit, size in (("h", 3600), ("m", 60), ("s", 1)):
            if self.seconds % size == 0:
                return f"{self.seconds // size}{unit}"
        raise AssertionError

    def bucket(self, at: Column, calendar: Calendar) -> Column:
        return F.timestamp_micros(micros(at) - F.pmod(micros(at), F.lit(self.seconds * 1_000_000))).cast(NTZ)

    def after(self, at, n=1):
        return at + F.make_dt_interval(secs=(F.lit(n) * self.seconds).cast("decimal(18,6)"))

    def step(self):
        return F.expr(f"interval {self.seconds} seconds")

    def label(self, at):
        return F.date_format(at, "yyyy-MM-dd HH:mm")


@dataclass(frozen=True)
class Day(Period):
    name = "day"

    def bucket(self, at, calendar):
        return at.cast("date").cast(NTZ)

    def after(self, at, n=1):
        return at + F.make_dt_interval(days=F.lit(n).cast("int"))

    def step(self):
        return F.expr("interval 1 day")


@dataclass(frozen=True)
class Week(Period):
    name = "week"

    def bucket(self, at, calendar):
        return F.date_sub(at.cast("date"), F.pmod(F.weekday(at) - calendar.week_start, F.lit(7))).cast(NTZ)

    def after(self, at, n=1):
        return at + F.make_dt_interval(days=(F.lit(n) * 7).cast("int"))

    def step(self):
        return F.expr("interval 7 days")


@dataclass(frozen=True)
class Month(Period):
    name = "month"

    def bucket(self, at, calendar):
        return F.trunc(at.cast("date"), "month").cast(NTZ)

    def after(self, at, n=1):
        return at + F.make_ym_interval(months=F.lit(n).cast("int"))

    def step(self):
        return F.expr("interval 1 month")

    def label(self, at):
        return F.date_format(at, "yyyy-MM")


@dataclass(frozen=True)
class Season(Period):
    name = "season"

    def on(self, calendar):
        return ListedSeasons("season", calendar.season.starts[:-1], calendar.season) if isinstance(calendar.season, Seasons) else self

    def bucket(self, at, calendar):
        month, day = calendar.season
        begun = (F.month(at) > month) | ((F.month(at) == month) & (F.dayofmonth(at) >= day))
        return F.make_timestamp_ntz(F.year(at) - F.when(begun, 0).otherwise(1), F.lit(month), F.lit(day), F.lit(0), F.lit(0), F.lit(0))

    def after(self, at, n=1):
        return at + F.make_ym_interval(years=F.lit(n).cast("int"))

    def step(self):
        return F.expr("interval 1 year")

    def label(self, at):
        return F.concat(F.year(at).cast("string"), F.lit("/"), F.lpad(F.pmod(F.year(at) + 1, F.lit(100)).cast("string"), 2, "0"))


@dataclass(frozen=True)
class Boundaries(Period):
    """A custom calendar: buckets between given local starts (terms, fiscal periods); times outside have none."""

    name: str
    starts: tuple[dt.datetime, ...]

    def _array(self) -> Column:
        return F.array(*[literal(s) for s in sorted(self.starts)])

    def bucket(self, at, calendar):
        return F.try_element_at(F.filter(self._array(), lambda s: s <= at), F.lit(-1))

    def after(self, at, n=1):
        return F.try_element_at(F.filter(self._array(), lambda s: s > at), F.lit(n).cast("int"))

    def series(self, first, last):
        return F.filter(self._array(), lambda s: (s >= first) & (s <= last))


@dataclass(frozen=True)
class ListedSeasons(Boundaries):
    """The seasons of a calendar that lists them."""

    seasons: Seasons

    def bucket(self, at, calendar):
        return F.when(at < literal(self.seasons.starts[-1]), super().bucket(at, calendar))

    def following(self, at):
        return F.coalesce(self.after(at), F.when(at.isNotNull(), literal(self.seasons.starts[-1])))

    def label(self, at):
        named = F.lit("")
        for i, start in enumerate(self.starts):
            named = F.when(at >= literal(start), self.seasons.label(i)).otherwise(named)
        return named


DAY, WEEK, MONTH, SEASON, HOUR = Day(), Week(), Month(), Season(), Span(3600)
#: Named periods and the units of spans.
NAMED = {"day": DAY, "week": WEEK, "month": MONTH, "season": SEASON, "hour": HOUR}
UNITS = {"s": 1, "m": 60, "h": 3600}


def period_named(name: str) -> Period | None:
    """``day``, ``week``, ``month``, ``season``, ``hour`` or a span such as ``15m``; None if there is no such period."""
    if name.lower() in NAMED:
        return NAMED[name.lower()]
    match = re.fullmatch(r"(\d+)([smh])", name)
    if not match:
        return None
    try:
        return Span(int(match[1]) * UNITS[match[2]])
    except ValueError:
        return None


def every(span: dt.timedelta) -> Span:
    if span % dt.timedelta(seconds=1):
        raise ValueError("a span is whole seconds")
    return Span(span // dt.timedelta(seconds=1))


