"""Joins of frames on key and time: combinations, ratios, weighted sums and comparisons."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import AT, ESTIMATED, SEQUENCE, VALUE, PointFrame
from ..functions.baseline import CalendarShift
from ..timeaxis import LOCAL, NTZ, Calendar, TimeAxis, to_local, to_utc


def shared_axis(left: PointFrame, right: PointFrame) -> TimeAxis:
    if left.axis.kind != right.axis.kind:
        raise ValueError("instants can't be combined with local times")
    if left.axis.zone and right.axis.zone and left.axis.zone != right.axis.zone:
        raise ValueError(f"times of {left.axis.zone} can't be combined with times of {right.axis.zone}")
    return left.axis if left.axis.zone or left.axis.grain else right.axis


def _same(a: str, b: str, columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _last_present(frame: PointFrame, by: list[str]) -> DataFrame:
    """One present row for each key: of several, the last in row order, and of those the greatest."""
    place = F.struct(*frame.order(), VALUE, *([ESTIMATED] if frame.estimates else []))
    made = [F.max_by(c, place).alias(c) for c in (VALUE, *([ESTIMATED] if frame.estimates else []))]
    return frame.df.where(F.col(VALUE).isNotNull()).groupBy(*by).agg(*made)


def _matched(left: PointFrame, right: PointFrame, by: list[str], value: Callable[[Column, Column], Column], how: str = "inner") -> DataFrame:
    """Left rows with the value made of both sides; ``estimated`` if either is."""
    r = _last_present(right, by)
    joined = left.df.where(F.col(VALUE).isNotNull()).alias("l").join(r.alias("r"), _same("l", "r", by), how)
    estimated = F.lit(False)
    if left.estimates:
        estimated = estimated | F.col(f"l.{ESTIMATED}")
    if right.estimates:
        estimated = estimated | F.coalesce(F.col(f"r.{ESTIMATED}"), F.lit(False))
    keys = [F.col(f"l.{k}") for k in (*left.keys, *([SEQUENCE] if left.sequenced else []))]
    return joined.select(*keys, F.col(f"l.{AT}"), value(F.col(f"l.{VALUE}"), F.col(f"r.{VALUE}")).alias(VALUE), estimated.alias(ESTIMATED))


def combine(left: PointFrame, right: PointFrame, function: Callable[[Column, Column], Column], match_time: bool = True, unit: str | None = None) -> PointFrame:
    """function(left, right) wherever both have a value for the same key (and time).

    Of right rows with the same key the last counts; without ``match_time`` that is over all time, and the
    result is timeless.  NaN is missing.  Estimates propagate.
    """
    axis = shared_axis(left, right)
    keys = list(left.keys)
    df = _matched(left, right, [*keys, AT] if match_time else keys, lambda a, b: F.nanvl(function(a, b).cast("double"), F.lit(None).cast("double")))
    if not match_time:
        df, axis = df.withColumn(AT, F.lit(None).cast(NTZ)), replace(axis, grain=None)
    return left.having(df, axis=axis, unit=unit or left.unit, estimates=left.estimates or right.estimates, ranged=False)


def difference(current: Column, before: Column) -> Column:
    return current - before


def percent_change(current: Column, before: Column) -> Column:
    return F.when(before != 0, (current - before) / before * 100)


def compare(baseline: PointFrame, current: PointFrame, percent: bool = False) -> PointFrame:
    """Current against the last value of each key in the baseline; timeless."""
    out = combine(current, baseline, percent_change if percent else difference, match_time=False)
    return replace(out, unit="%" if percent else current.unit)


def ratio(inputs: PointFrame, metric_dim: str, numerator: str, denominator: str, scale: float, minimum: float | None, unit: str | None) -> PointFrame:
    """numerator / denominator * scale wherever the denominator has a value other than 0 and not under the minimum.

    Both come in one frame, told apart by ``metric_dim``; a missing numerator is 0.  Unique keys (after any
    aggregation) need one grouping; otherwise every denominator row meets the last numerator of its key.
    """
    inputs.refuse_ranges("a ratio")
    side = lambda m: inputs.having(inputs.df.where(F.col(metric_dim) == m), hidden=tuple(h for h in inputs.hidden if h != metric_dim))
    den = side(denominator)
    keys = [*den.keys, AT]
    ok = F.col("_d").isNotNull() & (F.col("_d") != 0)
    if minimum is not None:
        ok = ok & (F.col("_d") >= float(minimum))
    if inputs.unique:
        unique = [F.max(F.when(F.col(metric_dim) == m, F.col(VALUE))).alias(c) for m, c in ((numerator, "_n"), (denominator, "_d"))]
        if inputs.estimates:
            unique.append(F.coalesce(F.max(inputs.estimated()), F.lit(False)).alias(ESTIMATED))
        df = inputs.df.groupBy(*keys).agg(*unique).where(ok).withColumn(VALUE, F.coalesce("_n", F.lit(0.0)) / F.col("_d") * scale)
    else:
        num = side(numerator)
        n = _last_present(num, keys).alias("n")
        d = den.df.withColumnRenamed(VALUE, "_d").where(ok).alias("d")
        kept = [F.col(f"d.{k}") for k in (*keys, *([SEQUENCE] if den.sequenced else []))]
        if inputs.estimates:
            kept.append((F.coalesce(F.col(f"d.{ESTIMATED}"), F.lit(False)) | F.coalesce(F.col(f"n.{ESTIMATED}"), F.lit(False))).alias(ESTIMATED))
        df = d.join(n, _same("d", "n", keys), "left").select(*kept, (F.coalesce(F.col(f"n.{VALUE}"), F.lit(0.0)) / F.col("_d") * scale).alias(VALUE))
    return den.having(df, unit=unit)


def linear(inputs: PointFrame, metric_dim: str, terms: dict[str, float], need_all: bool, unit: str | None) -> PointFrame:
    """The weighted sum of the inputs for each key and time; with ``need_all`` only where there are as many values as inputs."""
    inputs.refuse_ranges("a sum of metrics")
    out = inputs.having(inputs.df, hidden=tuple(h for h in inputs.hidden if h != metric_dim))
    weight = F.create_map(*[F.lit(x) for m, c in terms.items() for x in (m, float(c))])[F.col(metric_dim)]
    made = [F.sum(weight * F.col(VALUE)).alias(VALUE), F.count(VALUE).alias("_present")]
    if inputs.estimates:
        made.append(F.coalesce(F.max(inputs.estimated()), F.lit(False)).alias(ESTIMATED))
    df = inputs.df.groupBy(*out.keys, AT).agg(*made).where(F.col("_present") >= (len(terms) if need_all else 1))
    return out.having(df, unit=unit, unique=True)


def shifted(baseline: PointFrame, shift: CalendarShift, calendar: Calendar) -> PointFrame:
    """An earlier frame moved forward onto the report's time axis; ranges stay."""
    at = F.col(AT)
    local = at if baseline.axis.kind == LOCAL else to_local(at, calendar.zone)
    moved = local + F.make_ym_interval(months=F.lit(shift.months)) + F.make_dt_interval(days=F.lit(shift.days))
    return baseline.having(baseline.df.withColumn(AT, moved if baseline.axis.kind == LOCAL else to_utc(moved, calendar.zone)))


def change(current: PointFrame, baseline: PointFrame, percent: bool) -> PointFrame:
    """The change since an aligned baseline for each key and time that both have; a baseline of 0 has no percentage."""
    current.refuse_ranges("a comparison")
    baseline.refuse_ranges("a comparison")
    df = _matched(current, baseline, [*current.keys, AT], percent_change if percent else difference).where(F.col(VALUE).isNotNull())
    return current.having(df, unit="%" if percent else current.unit, estimates=current.estimates or baseline.estimates)
