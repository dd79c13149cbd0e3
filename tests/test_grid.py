"""Resampling over zones, periods, aggregators and gaps, against the interpreter."""

import datetime as dt
import random

import pytest
from interpreter import resample as expected

from metricloom.frame import AT, VALUE, points
from metricloom.functions.aggregators import NAMES, resolve
from metricloom.functions.periods import period_named
from metricloom.operators.resample import GAPS, Resample
from metricloom.timeaxis import Calendar, Context

#: Whole, half and quarter hours off, clock changes by an hour, by half an hour, and none.
ZONES = ("Asia/Kathmandu", "America/St_Johns", "Australia/Lord_Howe", "Africa/Cairo", "UTC")
AGGS = (*NAMES, "p12.5")


def made_points():
    """Four entities over the clock changes of March and April 2024: bursts of readings minutes apart, then hours to days of nothing, by a seeded draw."""
    draw, out = random.Random(20240331), []
    for entity in (11, 12, 13, 14):
        t = dt.datetime(2024, 3, 1) + dt.timedelta(minutes=draw.randrange(2000))
        while t < dt.datetime(2024, 5, 5):
            for _ in range(draw.randint(1, 4)):
                out.append((entity, t, None if draw.random() < 0.15 else draw.randint(-400, 900) / 8))
                t += dt.timedelta(minutes=draw.randint(3, 50))
            t += dt.timedelta(hours=draw.choice((2, 5, 9, 20, 31, 100)))
    return out


POINTS = made_points()


@pytest.fixture(scope="module")
def frame(spark):
    f = points(spark, POINTS, {"entity": "bigint"}, "entity")
    return f.having(f.df.cache())


def got(frame):
    return sorted((r["entity"], r[AT], r[VALUE]) for r in frame.df.collect())


def same(a, b):
    a, b = sorted(a), sorted(b)
    assert [x[:2] for x in a] == [x[:2] for x in b]
    for x, y in zip(a, b):
        assert x[2] == pytest.approx(y[2], rel=1e-9, abs=1e-9), (x, y)


@pytest.mark.parametrize("agg", AGGS)
@pytest.mark.parametrize("zone", ZONES)
def test_aggregators_by_zone(frame, zone, agg):
    for period, gap in (("day", "leave-missing"), ("week", "zero-fill")):
        out = Resample(period_named(period), resolve(agg), gap).apply(frame, Context(Calendar(zone)))
        same(got(out), expected(POINTS, period, agg, gap, zone))


@pytest.mark.parametrize("period", ("15m", "hour", "6h", "day", "week", "month", "season"))
def test_periods_by_zone(frame, period):
    for zone in ZONES[:4]:
        out = Resample(period_named(period), resolve("sum")).apply(frame, Context(Calendar(zone)))
        same(got(out), expected(POINTS, period, "sum", "leave-missing", zone))


@pytest.mark.parametrize("gap", GAPS)
@pytest.mark.parametrize("period", ("6h", "day", "week", "month"))
def test_gaps(frame, period, gap):
    for agg in ("mean", "last"):
        out = Resample(period_named(period), resolve(agg), gap).apply(frame, Context(Calendar("America/St_Johns")))
        same(got(out), expected(POINTS, period, agg, gap, "America/St_Johns"))


@pytest.mark.parametrize("week_start", (6, 5, 2))
def test_week_starts(frame, week_start):
    out = Resample(period_named("week"), resolve("mean")).apply(frame, Context(Calendar("Australia/Lord_Howe", week_start)))
    same(got(out), expected(POINTS, "week", "mean", "leave-missing", "Australia/Lord_Howe", week_start=week_start))
