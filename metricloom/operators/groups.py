"""Grouping points by key, and running transforms in each group."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import AT, ESTIMATED, SEQUENCE, VALUE, PointFrame
from ..functions.aggregators import SUM, Aggregator
from ..timeaxis import NTZ, Context
from .base import PointColumns, Transform


def grouped(frame: PointFrame, by: list[str], agg: Aggregator, estimates: bool) -> list[Column]:
    made = [F.nanvl(agg.column(F.col(VALUE), frame.order()), F.lit(None).cast("double")).alias(VALUE)]
    if estimates:
        made.append(F.coalesce(F.max(frame.estimated()), F.lit(False)).alias(ESTIMATED))
    return made


@dataclass(frozen=True)
class GroupBy(Transform):
    """One point for each value of ``by`` and time; the other dimensions are folded.  A group of missing values is missing.

    first and last go by time, then key.
    """

    agg: Aggregator = SUM
    by: tuple[str, ...] = ()
    timeless = False
    aggregates = True

    @property
    def dimensions(self):
        return self.by

    def with_aggregator(self, agg):
        return replace(self, agg=agg)

    def apply(self, frame, context=Context()):
        frame.refuse_ranges("a grouping")
        by = [*frame.hidden, *self.by]
        keys = by if self.timeless else [*by, AT]
        made = grouped(frame, keys, self.agg, frame.estimates)
        if keys:
            df = frame.df.groupBy(*keys).agg(*made)
        else:  # a total of nothing has no row
            df = frame.df.agg(*made, F.count(F.lit(1)).alias("_rows")).where("_rows > 0")
        if self.timeless:
            df = df.withColumn(AT, F.lit(None).cast(NTZ))
        entity = frame.entity if frame.entity in self.by else None
        return frame.having(df, dims=self.by, entity=entity, axis=replace(frame.axis, grain=None) if self.timeless else frame.axis, unique=True)


@dataclass(frozen=True)
class Total(GroupBy):
    """GroupBy over all time: one timeless point for each value of ``by``."""

    timeless = True
    collapses_time = True


@dataclass(frozen=True)
class Reduce(Transform):
    """One timeless point for each key that a function makes of the points; estimates propagate as in every grouping."""

    key: Callable[[PointColumns], dict[str, Column]]
    agg: Aggregator = SUM
    name: str | None = None
    aggregates = collapses_time = True

    @property
    def identity(self):
        return None if self.name is None else f"Reduce({self.name}, {self.agg.name})"

    def with_aggregator(self, agg):
        return replace(self, agg=agg)

    def apply(self, frame, context=Context()):
        frame.refuse_ranges("a reduction")
        made = self.key(PointColumns(frame))
        keyed = frame.df.select(*[F.col(k).alias(f"_was_{k}") for k in frame.keys], *frame.hidden, *[c.alias(d) for d, c in made.items()], AT, VALUE, *frame.extras)
        order = [F.col(AT), *([F.col(SEQUENCE)] if frame.sequenced else []), *[F.col(f"_was_{k}") for k in frame.keys]]
        value = [self.agg.column(F.col(VALUE), order).alias(VALUE)]
        if frame.estimates:
            value.append(F.coalesce(F.max(frame.estimated()), F.lit(False)).alias(ESTIMATED))
        df = keyed.groupBy(*frame.hidden, *made).agg(*value).withColumn(AT, F.lit(None).cast(NTZ))
        return frame.having(df, dims=tuple(made), entity=None, axis=replace(frame.axis, grain=None), unique=True)


@dataclass(frozen=True)
class PerGroup(Transform):
    """Runs a transform in each group of points that share a key made by a function.

    The group's key becomes part of every key while the inner transform runs, so its windows and groups
    never cross groups; no Python runs on rows.
    """

    key: Callable[[PointColumns], dict[str, Column]]
    inner: Transform
    name: str | None = None

    @property
    def identity(self):
        return None if self.name is None or self.inner.identity is None else f"PerGroup({self.name}, {self.inner.identity})"

    def apply(self, frame, context=Context()):
        made = {f"_group_{i}": c for i, c in enumerate(self.key(PointColumns(frame)).values())}
        inside = frame.having(frame.df.withColumns(made), hidden=(*frame.hidden, *made))
        out = self.inner.apply(inside, context)
        return out.having(out.df, hidden=frame.hidden)
