"""Rolling and cumulative aggregates, rankings and shares."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..frame import AT, ESTIMATED, VALUE, PointFrame
from ..functions.aggregators import MEAN, SUM, Aggregator
from ..timeaxis import Context, micros
from .base import Transform


def per_key(keys) -> WindowSpec:
    return Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))


@dataclass(frozen=True)
class Rolling(Transform):
    """For every point, the aggregate of its key's values in (t - window, t]: a duration, not calendar days.

    Bucketed points have unique times and use a range frame.  Points of a key that may share a time see those
    of their time up to themselves in row order only.  For those, counts, sums and means are made of window
    totals, and only the other aggregates collect each window's values.
    """

    window: dt.timedelta
    agg: Aggregator = MEAN
    aggregates = True

    def __post_init__(self):
        if self.window <= dt.timedelta(0):
            raise ValueError("a rolling window is a positive duration")

    def with_aggregator(self, agg):
        return replace(self, agg=agg)

    def apply(self, frame, context=Context()):
        frame.refuse_ranges("a rolling aggregate")
        reach = self.window // dt.timedelta(microseconds=1) - 1
        rows = frame.df.where(F.col(AT).isNotNull()).withColumn("_t", micros(F.col(AT)))
        w = per_key(frame.keys).orderBy("_t").rangeBetween(-reach, Window.currentRow)
        if frame.unique:
            made = rows.withColumn("_value", self.agg.over(F.col(VALUE), w))
            if frame.estimates:
                made = made.withColumn(ESTIMATED, F.max(frame.estimated()).over(w))
            return frame.having(made.drop(VALUE).withColumnRenamed("_value", VALUE))
        numbered = rows.withColumn("_n", F.row_number().over(per_key(frame.keys).orderBy("_t", *frame.ranks()[1:])))
        if self.agg.name in ("sum", "mean", "count") and type(self.agg) is Aggregator:
            return frame.having(self._of_totals(numbered, frame, w))
        seen = F.array_sort(F.collect_list(F.struct("_t", "_n", VALUE, *([ESTIMATED] if frame.estimates else []))).over(w))
        upto = F.filter("_seen", lambda x: (x["_t"] < F.col("_t")) | (x["_n"] <= F.col("_n")))
        values = F.transform(upto, lambda x: x[VALUE])
        made = numbered.withColumn("_seen", seen).withColumn(VALUE, self.agg.of_array(values))
        if frame.estimates:
            made = made.withColumn(ESTIMATED, F.exists(upto, lambda x: x[ESTIMATED] & x[VALUE].isNotNull()))
        return frame.having(made)

    def _of_totals(self, numbered: DataFrame, frame: PointFrame, window: WindowSpec) -> DataFrame:
        """The totals of the whole window, less those of later points at the same time.

        Counts of a window are differences of running counts, so they cost no more for long windows.
        """
        start = -(self.window // dt.timedelta(microseconds=1))
        upto = per_key(frame.keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = per_key(frame.keys).orderBy("_t").rangeBetween(Window.unboundedPreceding, start)
        later = per_key([*frame.keys, "_t"]).orderBy("_n").rowsBetween(1, Window.unboundedFollowing)
        many = lambda what: F.count(what).over(upto) - F.count(what).over(before)
        made = numbered.withColumn("_count", many(F.col(VALUE)).cast("double"))
        value = F.col("_count")
        if self.agg.name != "count":
            made = made.withColumn("_total", F.sum(VALUE).over(window) - F.coalesce(F.sum(VALUE).over(later), F.lit(0.0)))
            value = F.col("_total") if self.agg.name == "sum" else F.try_divide(F.col("_total"), F.col("_count"))
        if frame.estimates:
            made = made.withColumn("_guessed", many(F.when(frame.estimated(), 1)) > 0).drop(ESTIMATED).withColumnRenamed("_guessed", ESTIMATED)
        return made.withColumn(VALUE, F.when(F.col("_count") > 0, value))


@dataclass(frozen=True)
class Cumulative(Transform):
    """For every point, the aggregate of its key's values up to it; missing until the first value."""

    agg: Aggregator = SUM
    aggregates = True

    def with_aggregator(self, agg):
        return replace(self, agg=agg)

    def apply(self, frame, context=Context()):
        frame.refuse_ranges("a cumulative aggregate")
        w = per_key(frame.keys).orderBy(*frame.ranks()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        made = frame.df.where(F.col(AT).isNotNull()).withColumn("_value", self.agg.over(F.col(VALUE), w))
        if frame.estimates:
            made = made.withColumn(ESTIMATED, F.coalesce(F.max(frame.estimated()).over(w), F.lit(False)))
        return frame.having(made.drop(VALUE).withColumnRenamed("_value", VALUE))


@dataclass(frozen=True)
class Ranked(Transform):
    """All points of the ``n`` best keys by score (in each group of ``per``): largest first, or smallest.

    A key's score is ``rank_by`` over its values in time order; keys without one are dropped, ties go to
    the lower key.
    """

    n: int
    rank_by: Aggregator = SUM
    per: tuple[str, ...] = ()
    largest: bool = True
    value_filter = True

    def __post_init__(self):
        if self.n < 1:
            raise ValueError("a ranking keeps at least one key")

    @property
    def dimensions(self):
        return self.per

    def apply(self, frame, context=Context()):
        keys = list(frame.keys)
        scores = frame.df.groupBy(*keys).agg(self.rank_by.column(F.col(VALUE), frame.order()).alias("_score")).where("_score is not null")
        score = F.desc("_score") if self.largest else F.asc("_score")
        nth = F.row_number().over(per_key([*frame.hidden, *self.per]).orderBy(score, *keys))
        best = scores.withColumn("_nth", nth).where(F.col("_nth") <= self.n)
        best = best.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        return frame.having(frame.df.join(best, same, "left_semi") if keys else frame.df)


def Top(n: int, rank_by: Aggregator = SUM, per: tuple[str, ...] = ()) -> Ranked:  # noqa: N802
    return Ranked(n, rank_by, per, True)


def Bottom(n: int, rank_by: Aggregator = SUM, per: tuple[str, ...] = ()) -> Ranked:  # noqa: N802
    return Ranked(n, rank_by, per, False)


@dataclass(frozen=True)
class ShareOf(Transform):
    """Each value as a percentage of the values at its time whose keys differ only in ``across``.

    Missing points stay missing and count for nothing; a whole of zero has no shares.
    """

    across: tuple[str, ...]
    shares = True

    @property
    def dimensions(self):
        return self.across

    def apply(self, frame, context=Context()):
        frame.refuse_ranges("a share")
        whole = per_key([*[k for k in frame.keys if k not in self.across], AT])
        total = F.sum(VALUE).over(whole)
        value: Column = F.when(total != 0, F.col(VALUE) * 100 / total)
        made = frame.df.withColumn("_value", value)
        if frame.estimates:
            made = made.withColumn(ESTIMATED, F.coalesce(F.max(frame.estimated()).over(whole), F.lit(False)))
        return frame.having(made.drop(VALUE).withColumnRenamed("_value", VALUE), unit="%")
