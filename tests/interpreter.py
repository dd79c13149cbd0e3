"""A small interpreter of the algebra in plain Python, to hold the Spark operators against.

Points are (key, local or UTC time, value or None).
"""

import datetime as dt
import statistics
from zoneinfo import ZoneInfo

UTC = dt.timezone.utc


def aggregate(name, values):
    """Values in time order, none missing; None if there is no answer."""
    if not values:
        return None
    if name.startswith("p"):
        return quantile(values, float(name[1:]) / 100)
    return {
        "sum": lambda: sum(values), "mean": lambda: sum(values) / len(values), "min": lambda: min(values), "max": lambda: max(values), "count": lambda: float(len(values)),
        "first": lambda: values[0], "last": lambda: values[-1], "median": lambda: statistics.median(values),
        "stddev": lambda: statistics.stdev(values) if len(values) > 1 else None, "variance": lambda: statistics.variance(values) if len(values) > 1 else None,
    }[name]()


def quantile(values, p):
    v, rank = sorted(values), p * (len(values) - 1)
    low = int(rank)
    return v[low] if low + 1 == len(v) else v[low] + (v[low + 1] - v[low]) * (rank - low)


def to_local(t, zone):
    return t.replace(tzinfo=UTC).astimezone(ZoneInfo(zone)).replace(tzinfo=None)


def bucket(period, t, week_start=0, season=(7, 1)):
    day = t.replace(hour=0, minute=0, second=0, microsecond=0)
    if period == "day":
        return day
    if period == "week":
        return day - dt.timedelta(days=(day.weekday() - week_start) % 7)
    if period == "month":
        return day.replace(day=1)
    if period == "season":
        return dt.datetime(t.year - ((t.month, t.day) < season), *season)
    span = dt.timedelta(seconds={"15m": 900, "hour": 3600, "6h": 21600}[period])
    return day + (t - day) // span * span


def following(period, t):
    if period == "month":
        return (t.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
    if period == "season":
        return t.replace(year=t.year + 1)
    return t + {"day": dt.timedelta(days=1), "week": dt.timedelta(days=7), "15m": dt.timedelta(minutes=15), "hour": dt.timedelta(hours=1), "6h": dt.timedelta(hours=6)}[period]


def resample(points, period, agg, gap, zone="UTC", window=None, **calendar):
    """``window``: first and last bucket to fill across."""
    found = {}
    for key, t, v in points:
        found.setdefault(key, {}).setdefault(bucket(period, to_local(t, zone), **calendar), []).append((t, v))
    out = []
    for key, buckets in found.items():
        made = {b: aggregate(agg, [v for _, v in sorted(rows, key=lambda r: r[0]) if v is not None]) for b, rows in buckets.items()}
        if gap == "leave-missing":
            out += [(key, b, v) for b, v in made.items() if v is not None]
            continue
        at, last = min(made), max(made)
        if window:
            at, last = min(at, window[0]), max(last, window[1])
        spine = []
        while at <= last:
            spine.append(at)
            at = following(period, at)
        values = [made.get(b) for b in spine]
        out += [(key, b, v) for b, v in zip(spine, filled(values, gap)) if v is not None]
    return out


def filled(values, gap):
    if gap == "zero-fill":
        return [0.0 if v is None else v for v in values]
    known = [i for i, v in enumerate(values) if v is not None]
    out = []
    for i, v in enumerate(values):
        before, after = [k for k in known if k <= i], [k for k in known if k >= i]
        if v is not None:
            out.append(v)
        elif gap == "carry-forward":
            out.append(values[before[-1]] if before else None)
        elif before and after:
            a, b = before[-1], after[0]
            out.append(values[a] + (values[b] - values[a]) * (i - a) / (b - a))
        else:
            out.append(None)
    return out
