"""Calendars, zones and what a frame's time column means.

Times are TIMESTAMP_NTZ columns: the UTC wall clock for instants, the local wall clock for local times.
The session time zone must be UTC (``pin_session`` sets it), so that casts between the timestamp types
never move a clock.
"""

from __future__ import annotations

import bisect
import datetime as dt
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

INSTANT, LOCAL = "instant", "local"
NTZ = "timestamp_ntz"
MICRO = dt.timedelta(microseconds=1)


def pin_session(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@dataclass(frozen=True)
class TimeAxis:
    """``grain`` is the period of bucketed times, ``zone`` the clock that drew the buckets."""

    kind: str = INSTANT
    grain: object = None
    zone: str | None = None


@dataclass(frozen=True)
class Seasons:
    """Seasons that begin at listed local times and last until the next one begins.

    The last start only ends the season before it; times outside the list are in no season.  Without ``labels``,
    one for each season, a season is labelled by the years of its start and end.
    """

    starts: tuple[dt.datetime, ...]
    labels: tuple[str, ...] | None = None

    def __post_init__(self):
        if len(self.starts) < 2 or any(a >= b for a, b in zip(self.starts, self.starts[1:])):
            raise ValueError("seasons are at least two local times in ascending order")
        if self.labels is not None and len(self.labels) != len(self.starts) - 1:
            raise ValueError("seasons have one label for each start but the last")

    def place(self, local: dt.datetime) -> int:
        """Which season holds a local time."""
        if not self.starts[0] <= local < self.starts[-1]:
            raise ValueError(f"{local} is in no season of the calendar")
        return bisect.bisect_right(self.starts, local) - 1

    def label(self, place: int) -> str:
        if self.labels is not None:
            return self.labels[place]
        begin, end = self.starts[place].year, (self.starts[place + 1] - MICRO).year
        return str(begin) if begin == end else f"{begin}/{end % 100:02d}"


@dataclass(frozen=True)
class Calendar:
    """The report's zone, first weekday (0 = Monday) and seasons: the month and day on which they start each year, or a list."""

    zone: str = "UTC"
    week_start: int = 0
    season: tuple[int, int] | Seasons = (7, 1)

    def __post_init__(self):
        ZoneInfo(self.zone)
        if not 0 <= self.week_start <= 6:
            raise ValueError("week_start is a weekday, 0 (Monday) to 6 (Sunday)")
        if not isinstance(self.season, Seasons):
            dt.date(2023, *self.season)  # not a leap year: a season can't start on 29 February

    def local(self, instant: dt.datetime) -> dt.datetime:
        """The wall clock in the calendar's zone at a UTC time."""
        return instant.replace(tzinfo=dt.timezone.utc).astimezone(ZoneInfo(self.zone)).replace(tzinfo=None)

    def instant(self, local: dt.datetime) -> dt.datetime:
        """The UTC time of a wall clock: the earlier of a repeated hour, a skipped hour shifted forward."""
        return local.replace(tzinfo=ZoneInfo(self.zone), fold=0).astimezone(dt.timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class Timeframe:
    """Half-open: start <= t < end, UTC wall clock (or local, for local data)."""

    start: dt.datetime
    end: dt.datetime

    def __contains__(self, t: dt.datetime) -> bool:
        return self.start <= t < self.end


@dataclass(frozen=True)
class Context:
    calendar: Calendar = Calendar()
    timeframe: Timeframe | None = None


def literal(t: dt.datetime) -> Column:
    return F.lit(t.isoformat(sep=" ")).cast(NTZ)


def to_local(at: Column, zone: str) -> Column:
    """With the session in UTC this is four times faster than convert_timezone, and the same."""
    return at if zone == "UTC" else F.from_utc_timestamp(at.cast("timestamp"), zone).cast(NTZ)


def to_utc(at: Column, zone: str) -> Column:
    """Earlier of a repeated hour, skipped hours shifted forward: what Spark's conversion does."""
    return at if zone == "UTC" else F.to_utc_timestamp(at.cast("timestamp"), zone).cast(NTZ)


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


@dataclass(frozen=True)
class Transition:
    """A change of a zone's offset: the wall clock goes from ``before`` to ``after`` at the UTC time ``utc``."""

    utc: dt.datetime
    before: dt.timedelta
    after: dt.timedelta


def transitions(zone: str, timeframe: Timeframe) -> list[Transition]:
    """Offset changes within the timeframe and two days around it, found by halving days that differ."""
    info = ZoneInfo(zone)
    offset = lambda t: t.replace(tzinfo=dt.timezone.utc).astimezone(info).utcoffset()
    at, last, found = timeframe.start - dt.timedelta(days=2), timeframe.end + dt.timedelta(days=2), []
    while at < last:
        after = at + dt.timedelta(days=1)
        if offset(at) != offset(after):
            lo, hi = at, after
            while hi - lo > dt.timedelta(seconds=1):
                middle = lo + dt.timedelta(seconds=(hi - lo) // dt.timedelta(seconds=1) // 2)
                lo, hi = (middle, hi) if offset(middle) == offset(at) else (lo, middle)
            found.append(Transition(hi, offset(at), offset(hi)))
        at = after
    return found


def ambiguous(at: Column, changes: list[Transition]) -> Column:
    """Wall clocks that occur twice."""
    out = F.lit(False)
    for c in changes:
        if c.after < c.before:
            out = out | ((at >= literal(c.utc + c.after)) & (at < literal(c.utc + c.before)))
    return out


def skipped(at: Column, changes: list[Transition]) -> Column:
    """Wall clocks that never occur."""
    out = F.lit(False)
    for c in changes:
        if c.after > c.before:
            out = out | ((at >= literal(c.utc + c.before)) & (at < literal(c.utc + c.after)))
    return out


def to_utc_later(at: Column, zone: str, changes: list[Transition]) -> Column:
    """As ``to_utc``, but a repeated hour is its later occurrence."""
    out = to_utc(at, zone)
    for c in changes:
        if c.after < c.before:
            twice = (at >= literal(c.utc + c.after)) & (at < literal(c.utc + c.before))
            out = F.when(twice, at - F.lit(c.after)).otherwise(out)
    return out
