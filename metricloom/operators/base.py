"""What a transform is, and the key filters and row mappings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import AT, ESTIMATED, HIGH, LOW, VALUE, PointFrame
from ..functions.aggregators import Aggregator
from ..timeaxis import Context


class Transform:
    """PointFrame -> PointFrame.  The flags say what planning must know."""

    key_filter = value_filter = aggregates = collapses_time = shares = False

    @property
    def dimensions(self) -> tuple[str, ...]:
        """Dimensions that the frame must have."""
        return ()

    @property
    def identity(self) -> str | None:
        """A stable text for caching; None if there is none (lambdas without a name)."""
        return repr(self)

    def apply(self, frame: PointFrame, context: Context = Context()) -> PointFrame:
        raise NotImplementedError

    def with_aggregator(self, agg: Aggregator) -> Transform:
        raise TypeError(f"{type(self).__name__} doesn't aggregate")


def run(frame: PointFrame, transforms, context: Context = Context()) -> PointFrame:
    for t in transforms:
        frame = t.apply(frame, context)
    return frame


class PointColumns:
    """What lambdas see of a point: its columns by name."""

    def __init__(self, frame: PointFrame):
        self.frame = frame
        self.at, self.value = F.col(AT), F.col(VALUE)

    def __getitem__(self, dim: str) -> Column:
        if dim not in self.frame.dims:
            raise KeyError(f"the points have no dimension '{dim}'; they have {', '.join(self.frame.dims)}")
        return F.col(dim)


class _Lambda(Transform):
    name: str | None

    @property
    def identity(self):
        return None if self.name is None else f"{type(self).__name__}({self.name})"


@dataclass(frozen=True)
class Filter(_Lambda):
    """Keeps the points for which a function of PointColumns gives true; ranges stay."""

    predicate: Callable[[PointColumns], Column]
    name: str | None = None

    def apply(self, frame, context=Context()):
        return frame.having(frame.df.where(self.predicate(PointColumns(frame))))


@dataclass(frozen=True)
class Map(_Lambda):
    """Replaces the value; key and time stay, ranges are dropped.  NaN becomes missing."""

    function: Callable[[PointColumns], Column]
    name: str | None = None

    def apply(self, frame, context=Context()):
        value = self.function(PointColumns(frame)).cast("double")
        return frame.having(frame.df.withColumn(VALUE, F.nanvl(value, F.lit(None).cast("double"))), ranged=False)


@dataclass(frozen=True)
class Rekey(_Lambda):
    """Replaces the key by named columns; nothing is aggregated, ranges are dropped."""

    function: Callable[[PointColumns], dict[str, Column]]
    name: str | None = None

    def apply(self, frame, context=Context()):
        made = self.function(PointColumns(frame))
        plain = frame.having(frame.df, ranged=False)
        df = plain.df.select(*frame.hidden, *[c.alias(d) for d, c in made.items()], AT, VALUE, *plain.extras)
        return plain.having(df, dims=tuple(made), entity=frame.entity if frame.entity in made else None, unique=False)


@dataclass(frozen=True)
class WhereIn(Transform):
    """Keeps points whose dimension is one of the values, compared as text (ids as decimal numbers)."""

    dim: str
    values: tuple
    key_filter = True

    @property
    def dimensions(self):
        return (self.dim,)

    def apply(self, frame, context=Context()):
        return frame.having(frame.df.where(_matches(frame, self.dim, self.values)))


@dataclass(frozen=True)
class WhereNotIn(Transform):
    """Drops points whose dimension is one of the values; points without the dimension stay."""

    dim: str
    values: tuple
    key_filter = True

    @property
    def dimensions(self):
        return (self.dim,)

    def apply(self, frame, context=Context()):
        if self.dim not in frame.dims:
            return frame
        return frame.having(frame.df.where(~F.coalesce(_matches(frame, self.dim, self.values), F.lit(False))))


def _matches(frame: PointFrame, dim: str, values: tuple) -> Column:
    if dim not in frame.dims:
        return F.lit(False)
    kind = dict(frame.df.dtypes)[dim]
    if kind == "bigint":  # a typed comparison reaches the scan
        ids = [int(v) for v in values if str(v).lstrip("-").isdigit() and str(int(v)) == str(v)]
        return F.col(dim).isin(ids)
    return F.col(dim).cast("string").isin([str(v) for v in values])


@dataclass(frozen=True)
class WhereValue(Transform):
    """Keeps points with min <= value <= max; missing ones go."""

    min: float | None = None
    max: float | None = None
    value_filter = True

    def apply(self, frame, context=Context()):
        keep = F.col(VALUE).isNotNull()
        if self.min is not None:
            keep = keep & (F.col(VALUE) >= float(self.min))
        if self.max is not None:
            keep = keep & (F.col(VALUE) <= float(self.max))
        return frame.having(frame.df.where(keep))


@dataclass(frozen=True)
class Named(Transform):
    """Gives a transform made of lambdas a stable identity."""

    name: str
    inner: Transform

    key_filter = property(lambda self: self.inner.key_filter)
    value_filter = property(lambda self: self.inner.value_filter)
    aggregates = property(lambda self: self.inner.aggregates)
    collapses_time = property(lambda self: self.inner.collapses_time)
    shares = property(lambda self: self.inner.shares)

    def with_aggregator(self, agg):
        return Named(f"{self.name}/{agg.name}", self.inner.with_aggregator(agg))

    @property
    def dimensions(self):
        return self.inner.dimensions

    @property
    def identity(self):
        return self.name

    def apply(self, frame, context=Context()):
        return self.inner.apply(frame, context)


@dataclass(frozen=True)
class Tag(Transform):
    """Adds a category dimension with one value, to tell merged frames apart."""

    dim: str
    value: str

    def apply(self, frame, context=Context()):
        return frame.having(frame.df.withColumn(self.dim, F.lit(self.value)), dims=(*frame.dims, self.dim))


def merge(*frames: PointFrame) -> PointFrame:
    """All points of all frames; dimensions that some lack are absent (NULL) there."""
    first = frames[0]
    if len({f.axis.kind for f in frames}) > 1:
        raise ValueError("instants and local times can't be merged")
    estimates, ranged = any(f.estimates for f in frames), any(f.ranged for f in frames)
    df = None
    for f in frames:
        part = f.df
        if estimates and not f.estimates:
            part = part.withColumn(ESTIMATED, F.lit(False))
        if ranged and not f.ranged:
            part = part.withColumns({c: F.lit(None).cast("double") for c in (LOW, HIGH)})
        df = part if df is None else df.unionByName(part, allowMissingColumns=True)
    sequenced = all(f.sequenced for f in frames)
    dims = tuple(dict.fromkeys(d for f in frames for d in f.dims))
    same_axis = all(f.axis == first.axis for f in frames)
    return first.having(df, dims=dims, estimates=estimates, ranged=ranged, axis=first.axis if same_axis else type(first.axis)(first.axis.kind), unique=False, sequenced=sequenced)
