"""Bucketing points in time, and the gap policies."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import AT, VALUE, PointFrame
from ..functions.aggregators import MEAN, Aggregator
from ..functions.periods import Period
from ..timeaxis import INSTANT, LOCAL, MICRO, Calendar, Context, TimeAxis, literal, to_local
from .base import Transform

#: The names of gap policies and spans in requests and dashboards.
LEAVE, ZERO, CARRY, INTERPOLATE = GAPS = ("leave-missing", "zero-fill", "carry-forward", "interpolate")
OBSERVED, TIMEFRAME = SPANS = ("observed", "timeframe")


@dataclass(frozen=True)
class Resample(Transform):
    """One point for each key and bucket.

    Instants fall into buckets by the wall clock of the calendar's zone, local times as they are; timeless
    points are left out.  With a gap policy other than leaving gaps, every bucket from a key's first to its
    last (``across`` the observed buckets, or at least the timeframe's) gets a point if the policy has a
    value for it.
    """

    period: Period
    agg: Aggregator = MEAN
    gap: str = LEAVE
    across: str = OBSERVED
    aggregates = True

    def __post_init__(self):
        if self.gap not in GAPS or self.across not in SPANS:
            raise ValueError(f"a gap policy is one of {', '.join(GAPS)}, across one of {', '.join(SPANS)}")

    def with_aggregator(self, agg):
        return replace(self, agg=agg)

    def apply(self, frame, context=Context()):
        if frame.estimates:
            raise ValueError("a forecast can't be resampled; resample first, then forecast")
        calendar, keys, period = context.calendar, list(frame.keys), self.period.on(context.calendar)
        zone = calendar.zone if frame.axis.kind == INSTANT else frame.axis.zone
        local = to_local(F.col(AT), calendar.zone) if frame.axis.kind == INSTANT else F.col(AT)
        rows = frame.df.where(F.col(AT).isNotNull()).withColumn("_bucket", period.bucket(local, calendar)).where("_bucket is not null")
        made = rows.groupBy(*keys, "_bucket").agg(self.agg.column(F.col(VALUE), frame.order()).alias(VALUE))
        made = made.select(*keys, F.col("_bucket").alias(AT), F.nanvl(VALUE, F.lit(None).cast("double")).alias(VALUE))
        return self.spread(frame.having(made, axis=TimeAxis(LOCAL, period, zone), unique=True), context)

    def spread(self, buckets: PointFrame, context: Context) -> PointFrame:
        """The gap policy over buckets of this period, one row for each key and bucket."""
        if self.gap == LEAVE:
            return buckets.having(buckets.df.where(F.col(VALUE).isNotNull()))
        window = self._window(context, buckets.axis.zone)
        return buckets.having(filled(buckets.df, list(buckets.keys), buckets.axis.grain, self.gap, window))

    def _window(self, context: Context, zone: str | None) -> tuple[Column, Column] | None:
        frame_of_time = context.timeframe
        if self.across != TIMEFRAME or frame_of_time is None or frame_of_time.start >= frame_of_time.end:
            return None
        calendar = context.calendar
        clock = (lambda t: Calendar(zone).local(t)) if zone else (lambda t: t)
        first, last = clock(frame_of_time.start), clock(frame_of_time.end - MICRO)
        period = self.period.on(calendar)
        return period.bucket(literal(first), calendar), period.bucket(literal(last), calendar)


def densified(buckets: DataFrame, keys: list[str], period: Period, window: tuple[Column, Column] | None = None) -> DataFrame:
    """Adds the buckets between a key's rows (and out to the window's) with missing values.

    Each row brings the gap up to the next row of its key, so one shuffle by key does it.
    """
    w = Window.partitionBy(*keys).orderBy(AT) if keys else Window.partitionBy(F.lit(0)).orderBy(AT)
    following, first = F.lead(AT).over(w), F.lag(AT).over(w).isNull()
    start, stop = F.col(AT), F.coalesce(F.col("_next"), F.col(AT))
    if window is not None:
        start = F.when(F.col("_first"), F.least(AT, window[0])).otherwise(start)
        stop = F.coalesce(F.col("_next"), F.greatest(F.col(AT), window[1]))
    spine = F.filter(period.series(start, stop), lambda b: F.col("_next").isNull() | (b < F.col("_next")))
    rows = buckets.withColumn("_next", following).withColumn("_first", first)
    rows = rows.withColumn("_bucket", F.explode(spine))
    return rows.select(*keys, F.col("_bucket").alias(AT), F.when(F.col("_bucket") == F.col(AT), F.col(VALUE)).alias(VALUE))


def filled(buckets: DataFrame, keys: list[str], period: Period, gap: str, window: tuple[Column, Column] | None = None) -> DataFrame:
    """The buckets of a gap policy that have a value.

    Each row with a value brings what lies up to the next one, so windows see the rows there are, not those that
    are added, and take time in proportion.
    """
    if gap == ZERO:
        return densified(buckets, keys, period, window).withColumn(VALUE, F.coalesce(VALUE, F.lit(0.0)))
    w = Window.partitionBy(*keys).orderBy(AT) if keys else Window.partitionBy(F.lit(0)).orderBy(AT)
    last = F.max(AT).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    known = buckets if gap == INTERPOLATE else buckets.withColumn("_end", last if window is None else F.greatest(last, window[1]))
    known = known.where(F.col(VALUE).isNotNull()).withColumns({"_next": F.lead(AT).over(w), "_to": F.lead(VALUE).over(w)})
    stop = F.coalesce("_next", AT if gap == INTERPOLATE else "_end")
    spine = F.filter(period.series(F.col(AT), stop), lambda b: F.col("_next").isNull() | (b < F.col("_next")))
    rows = known.withColumn("_spine", spine).select(*keys, VALUE, "_to", F.size("_spine").alias("_n"), F.posexplode("_spine").alias("_i", AT))
    value = F.col(VALUE)
    if gap == INTERPOLATE:
        value = F.when(F.col("_i") > 0, value + (F.col("_to") - value) * F.try_divide(F.col("_i"), F.col("_n"))).otherwise(value)
    return rows.select(*keys, AT, value.alias(VALUE))
