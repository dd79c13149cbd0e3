"""Charts: finished, chart-library-agnostic dictionaries made from frames."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import AT, ESTIMATED, HIGH, LOW, VALUE, PointFrame
from ..timeaxis import INSTANT, Calendar, to_local

#: Points that a report may bring to the driver; a report with more raises an error.
MOST_MARKS = 1_000_000


@dataclass(frozen=True)
class Theme:
    """The colours of series, in turn, and of status; marks without a status have their series' colour."""

    palette: tuple[str, ...] = ("blue", "orange", "green", "red", "purple", "teal", "pink", "gray")
    good: str = "green"
    watch: str = "amber"
    bad: str = "red"

    def series(self, i: int) -> str:
        return self.palette[i % len(self.palette)]

    def mark(self, status: str, series: str) -> str:
        return series if status == "neutral" else getattr(self, status)


THEME = Theme()


def label_column(frame: PointFrame, calendar: Calendar) -> Column:
    """The label of a point's time: by its grain, or the date (and time, if there is one) on the calendar's clock."""
    at = F.col(AT)
    if frame.axis.grain is not None:
        return frame.axis.grain.label(at)
    local = to_local(at, calendar.zone) if frame.axis.kind == INSTANT else at
    midnight = F.date_format(local, "HH:mm:ss") == "00:00:00"
    return F.when(midnight, F.date_format(local, "yyyy-MM-dd")).otherwise(F.date_format(local, "yyyy-MM-dd HH:mm"))


def marks_frame(frame: PointFrame, view, calendar: Calendar = Calendar()):
    """The chart's marks as a DataFrame: series, label, epoch milliseconds, value, status, and what a forecast adds."""
    series = F.col(view.series_by).cast("string") if view.series_by else F.lit("")
    timed = view.x == "time"
    label = label_column(frame, calendar) if timed else F.col(view.x).cast("string")
    status = F.lit("neutral")
    if view.status is not None:
        status = F.when(F.col(VALUE).isNotNull(), view.status.column(F.col(VALUE))).otherwise("neutral")
    at = F.unix_millis(F.col(AT).cast("timestamp")) if timed else F.lit(None).cast("bigint")
    extra = [F.col(c) for c in frame.extras]
    return frame.df.select(series.alias("series"), label.alias("label"), at.alias("at_millis"), F.col(VALUE), status.alias("status"), *extra, *[F.col(k).alias(f"_{k}") for k in frame.keys])


def stacked_extent(marks) -> tuple[Column, Column]:
    """For use in an aggregate over marks grouped by position: what stacks up and down from zero."""
    up = F.sum(F.when(F.col(VALUE) >= 0, F.col(VALUE)))
    down = F.sum(F.when(F.col(VALUE) < 0, F.col(VALUE)))
    return up, down


def project(
    frame: PointFrame, view, calendar: Calendar, name: str, labels: Callable[[str, str], str] | None = None,
    theme: Theme = THEME, most: int = MOST_MARKS,
) -> dict:
    """Collects a frame (the only collect of a report) and makes its chart; ``labels`` names a dimension's values.

    A frame of more than ``most`` points raises ValueError: the driver never holds more.
    """
    named = labels or (lambda dim, value: value)
    timed = view.x == "time"
    order = ["at_millis", *[f"_{k}" for k in frame.keys]]
    rows = [r.asDict() for r in marks_frame(frame, view, calendar).limit(most + 1).orderBy(*order).collect()]
    if len(rows) > most:
        raise ValueError(f"a chart has at most {most:,} points; bucket, group or filter the report")
    found: dict[str, list[dict]] = {}
    for r in rows:
        mark = {"label": r["label"] if timed else named(view.x, r["label"]), "at": r["at_millis"], "value": r[VALUE], "status": r["status"]}
        mark |= {"estimated": r.get(ESTIMATED) or None, "low": r.get(LOW), "high": r.get(HIGH)}
        found.setdefault(r["series"], []).append(mark)
    series = [{"name": named(view.series_by, s) if s else name, "key": s, "axis": "primary"} | colored(m, theme.series(i), theme) for i, (s, m) in enumerate(found.items())]
    axes = [{"kind": "temporal" if timed else "category", "title": None if timed else view.x}, value_axis(series, view.stacked, view.unit)]
    return {"kind": view.kind, "title": view.title, "series": series, "axes": axes, "legend": {"visible": len(series) > 1}, "annotations": annotations(view), "stacked": view.stacked or None}


def colored(marks: list[dict], color: str, theme: Theme) -> dict:
    return {"color": color, "marks": [m | {"color": theme.mark(m["status"], color)} for m in marks]}


def annotations(view) -> list[dict]:
    ranges = [] if view.status is None else view.status.marked()
    return [{"kind": "band", "label": label, "status": status, "from": low, "to": high} for label, status, low, high in ranges]


def value_axis(series: list[dict], stacked: bool, unit: str | None) -> dict:
    marks = [m for s in series for m in s["marks"]]
    if stacked:
        up: dict = {}
        down: dict = {}
        for m in marks:
            if m["value"] is not None:
                place = m["at"] if m["at"] is not None else m["label"]
                side = up if m["value"] >= 0 else down
                side[place] = side.get(place, 0.0) + m["value"]
        low, high = (min([0.0, *down.values()]), max([0.0, *up.values()])) if up or down else (None, None)
    else:
        values = [x for m in marks for x in (m["value"], m["low"], m["high"]) if x is not None and not math.isnan(x)]
        low, high = (min(values), max(values)) if values else (None, None)
    return {"kind": "linear", "unit": unit, "min": low, "max": high}


def compose(parts: list[tuple], title: str | None, theme: Theme = THEME) -> dict:
    """Several reports' charts as one.  They share the x axis; series are named, coloured in turn, and may use a second value axis."""
    if len({view["axes"][0]["kind"] for _, view, _ in parts}) > 1:
        raise ValueError("the series of a chart must share the x axis: all over time or all over a dimension")
    out, axes = [], [dict(parts[0][1]["axes"][0])]
    for series, view, name in parts:
        base = series.name or name
        several = len(view["series"]) > 1 or (view["series"] and view["series"][0]["key"])
        for s in view["series"]:
            shown = f"{base} · {s['name']}" if several else base
            own = colored(s["marks"], series.color or theme.series(len(out)), theme)
            out.append(s | own | {"name": shown, "axis": "secondary" if series.secondary else "primary", "kind": view["kind"]})
    for which in ("primary", "secondary"):
        used = [(s, v) for s, v, _ in parts if s.secondary == (which == "secondary")]
        if used:
            stacked = any(v["stacked"] for _, v in used)
            axes.append(value_axis([x for _, v in used for x in v["series"]], stacked, used[0][1]["axes"][1]["unit"]) | {"axis": which})
    first = parts[0][1]
    return {"kind": first["kind"], "title": title, "series": out, "axes": axes, "legend": {"visible": len(out) > 1}, "annotations": [a for _, v, _ in parts for a in v["annotations"]], "stacked": first["stacked"]}


def formatted(value: float | None, unit: str | None = None) -> str:
    """At most three decimals, and the unit."""
    if value is None:
        return "–"
    text = f"{value:.3f}".rstrip("0").rstrip(".")
    text = "0" if text in ("-0", "") else text
    return text if not unit else f"{text}{unit}" if unit == "%" else f"{text} {unit}"


def epoch_millis(t: dt.datetime) -> int:
    return int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
