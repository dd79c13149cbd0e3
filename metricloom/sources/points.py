"""Where points come from: long and wide relations, rows in memory, JDBC tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import AT, SEQUENCE, VALUE, PointFrame, points
from ..operators.resample import Resample
from ..timeaxis import INSTANT, LOCAL, NTZ, Context, TimeAxis, Timeframe, ambiguous, literal, pin_session, skipped, to_local, to_utc, to_utc_later, transitions

#: The hidden dimension that tells the metrics of a batch apart.
METRIC = "_metric"
#: Longer entity lists become a semi join instead of an IN list; both compare the entity as a bigint.
LONGEST_LIST = 1000


@dataclass(frozen=True)
class StoredTime:
    """What a time column holds: UTC, local times without a zone, or the wall clock of a zone.

    A repeated hour is its ``earlier`` or ``later`` occurrence, a skipped one is ``shift``-ed forward; either
    can be ``reject``-ed.
    """

    kind: str = INSTANT
    zone: str | None = None
    repeated: str = "earlier"
    missing: str = "shift"

    def __post_init__(self):
        if self.repeated not in ("earlier", "later", "reject") or self.missing not in ("shift", "reject"):
            raise ValueError("repeated hours are earlier, later or reject; missing ones shift or reject")


UTC, LOCAL_TIME = StoredTime(), StoredTime(LOCAL)


def in_zone(zone: str, repeated: str = "earlier", missing: str = "shift") -> StoredTime:
    return StoredTime(INSTANT, zone, repeated, missing)


def relation(spark: SparkSession, what: DataFrame | str) -> DataFrame:
    """A DataFrame, SQL text, Parquet path or table name."""
    if isinstance(what, DataFrame):
        return what
    head = what.lstrip("( \n").lower()
    if head.startswith(("select ", "select\n", "with ", "values")):
        return spark.sql(what)
    return spark.read.parquet(what) if "/" in what or what.endswith(".parquet") else spark.table(what)


#: What makes a session of a database tell times in UTC.
UTC_SESSIONS = {"jdbc:postgresql:": "SET TIME ZONE 'UTC'", "jdbc:mysql:": "SET time_zone = '+00:00'"}


def jdbc(spark: SparkSession, url: str, table: str, split: tuple[str, object, object, int] | None = None, **options: str) -> DataFrame:
    """A JDBC relation for LongSource or WideSource; Spark pushes their filters down.

    Times without a zone come as they are stored, and sessions tell times in UTC.  ``split`` (column, least and
    greatest value, parts) reads in parallel, one query for each part; without it one task reads the table.
    """
    chosen = {"preferTimestampNTZ": "true", "fetchsize": "10000"}
    chosen |= {"sessionInitStatement": said for prefix, said in UTC_SESSIONS.items() if url.startswith(prefix)}
    if split is not None:
        chosen |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, split)))
    return spark.read.format("jdbc").options(**chosen | {"url": url, "dbtable": table} | options).load()


class Source:
    """``points`` gives the points of metrics for entities (None: all) and a timeframe (None: all time)."""

    entity: str = "entity"
    axis = TimeAxis()

    def points(self, metrics: Sequence[str], entities: Sequence[int] | None, timeframe: Timeframe | None, dims: Sequence[str] | None = None) -> PointFrame:
        raise NotImplementedError

    def rolled(self, metrics, entities, timeframe, dims, resample: Resample, context: Context, by: Sequence[str] | None = None) -> PointFrame:
        """The points bucketed by ``resample``, for each key, or with ``by`` for each value of these dimensions alone."""
        raw = self.points(metrics, entities, timeframe, dims)
        if by is not None:
            raw = raw.having(raw.df, dims=tuple(by), entity=raw.entity if raw.entity in by else None)
        return resample.apply(raw, context)


@dataclass
class _Table(Source):
    spark: SparkSession
    table: DataFrame | str
    entity_column: str
    time_column: str
    dimensions: Mapping[str, str] = field(default_factory=dict)
    stored: StoredTime = UTC
    entity: str = "entity"
    #: SQL expression (bigint) that ranks rows of one entity and time; without it they rank by value.
    order_column: str | None = field(default=None, kw_only=True)

    def __post_init__(self):
        pin_session(self.spark)
        self.df = relation(self.spark, self.table)
        self.axis = TimeAxis(self.stored.kind)

    def _sequence(self) -> list[Column]:
        return [F.expr(self.order_column).cast("bigint").alias(SEQUENCE)] if self.order_column else []

    def _entity(self) -> Column:
        """The entity as a bigint; a column that is one stays bare, so that filters on it reach the scan."""
        raw = F.expr(self.entity_column)
        return raw if self.df.select(raw.alias("e")).dtypes[0][1] == "bigint" else raw.cast("bigint")

    def _rows(self, entities: Sequence[int] | None, timeframe: Timeframe | None) -> tuple[DataFrame, Column, Column]:
        """Filtered rows, with the entity and time expressions."""
        df, raw = self.df, F.col(self.time_column).cast(NTZ)
        entity = self._entity()
        if entities is not None and len(entities) <= LONGEST_LIST:
            df = df.where(entity.isin([int(e) for e in entities]))
        elif entities is not None:
            listed = self.spark.createDataFrame([(int(e),) for e in entities], "_entity long").distinct()
            df = df.join(listed, entity == F.col("_entity"), "left_semi")
        if self.stored.zone is None:
            if timeframe is not None:
                df = df.where((raw >= literal(timeframe.start)) & (raw < literal(timeframe.end)))
            return df, entity, raw
        zone = self.stored.zone
        if timeframe is None:
            if self.stored.repeated != "earlier" or self.stored.missing != "shift":
                raise ValueError("resolving hours other than earlier and shifted needs a timeframe")
            return df, entity, to_utc(raw, zone)
        df = df.where((raw >= to_local(literal(timeframe.start), zone) - F.expr("interval 1 day")) & (raw < to_local(literal(timeframe.end), zone) + F.expr("interval 1 day")))
        changes = transitions(zone, timeframe)
        for rule, test, said in ((self.stored.repeated, ambiguous, "occur twice"), (self.stored.missing, skipped, "never occur")):
            if rule == "reject" and df.where(test(raw, changes)).limit(1).count():
                raise ValueError(f"{self.time_column} holds wall clocks of {zone} that {said}")
        at = to_utc_later(raw, zone, changes) if self.stored.repeated == "later" else to_utc(raw, zone)
        return df.where((at >= literal(timeframe.start)) & (at < literal(timeframe.end))), entity, at

    def _dims(self, dims: Sequence[str] | None) -> dict[str, Column]:
        """Dimension columns as text; NULL is the empty category."""
        known = self.dimensions if dims is None else {d: self.dimensions[d] for d in dims}
        return {d: F.coalesce(F.expr(e).cast("string"), F.lit("")) for d, e in known.items()}


def _value(column: Column) -> Column:
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))


@dataclass
class LongSource(_Table):
    """A row for each point: entity, metric, value, time and dimensions (name -> SQL expression)."""

    metric_column: str = "metric"
    value_column: str = "value"

    def points(self, metrics, entities=None, timeframe=None, dims=None):
        df, entity, at = self._rows(entities, timeframe)
        metric = F.expr(self.metric_column)
        df = df.where(metric.isin(list(metrics)))
        named = {**self._dims(dims)}
        out = df.select(metric.cast("string").alias(METRIC), entity.alias(self.entity), *[c.alias(d) for d, c in named.items()], at.alias(AT), _value(F.expr(self.value_column)).alias(VALUE), *self._sequence())
        return PointFrame(out, (self.entity, *named), self.entity, self.axis, hidden=(METRIC,), sequenced=self.order_column is not None)


@dataclass
class WideSource(_Table):
    """A row for each entity and time, a column (SQL expression) for each metric."""

    metrics: Mapping[str, str] = field(default_factory=dict)

    def points(self, metrics, entities=None, timeframe=None, dims=None):
        df, entity, at = self._rows(entities, timeframe)
        named = self._dims(dims)
        df = df.select(entity.alias(self.entity), *[c.alias(d) for d, c in named.items()], at.alias(AT), *[_value(F.expr(self.metrics[m])).alias(f"_v{i}") for i, m in enumerate(metrics)], *self._sequence())
        sequence = [SEQUENCE] if self.order_column else []
        out = self._long(df, metrics, [self.entity, *named, *sequence])
        return PointFrame(out, (self.entity, *named), self.entity, self.axis, hidden=(METRIC,), sequenced=bool(sequence))

    def rolled(self, metrics, entities, timeframe, dims, resample, context, by=None):
        """All metrics of a bucket in one aggregate row, made long afterwards; gaps are filled then."""
        df, entity, at = self._rows(entities, timeframe)
        named, calendar = self._dims(dims), context.calendar
        local = to_local(at, calendar.zone) if self.axis.kind == INSTANT else at
        every = {self.entity: entity, **named}
        named = {k: every[k] for k in (every if by is None else by)}
        keys = list(named)
        df = df.select(*[c.alias(d) for d, c in named.items()], *self._sequence(), at.alias("_at"), resample.period.on(calendar).bucket(local, calendar).alias(AT), *[_value(F.expr(self.metrics[m])).alias(f"_v{i}") for i, m in enumerate(metrics)])
        order = [F.col("_at"), *([F.col(SEQUENCE)] if self.order_column else []), *[F.col(k) for k in sorted(keys)]]
        made = df.where(F.col(AT).isNotNull()).groupBy(*keys, AT).agg(*[resample.agg.column(F.col(f"_v{i}"), order).alias(f"_v{i}") for i in range(len(metrics))])
        axis = TimeAxis(LOCAL, resample.period.on(calendar), calendar.zone if self.axis.kind == INSTANT else None)
        frame = PointFrame(self._long(made, metrics, keys), tuple(named), self.entity if self.entity in named else None, axis, hidden=(METRIC,), unique=True)
        return resample.spread(frame, context)

    @staticmethod
    def _long(df: DataFrame, metrics: Sequence[str], keys: list[str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias(METRIC), F.col(f"_v{i}").alias(VALUE)) for i, m in enumerate(metrics)])
        return df.select(*keys, AT, F.explode(pairs).alias("_p")).select(f"_p.{METRIC}", *keys, AT, f"_p.{VALUE}")


class MemorySource(Source):
    """Points in memory, rows (metric, entity, dims..., at, value); timeless points are in every timeframe."""

    def __init__(self, spark: SparkSession, rows: Iterable[tuple], dims: Sequence[str] = (), kind: str = INSTANT, entity: str = "entity"):
        pin_session(spark)
        self.entity, self.axis, self.fetches = entity, TimeAxis(kind), 0
        kinds = {METRIC: "string", entity: "bigint"} | {d: "string" for d in dims}
        self.frame = points(spark, rows, kinds, entity, self.axis)  # in row order
        self.known = tuple(dims)

    def points(self, metrics, entities=None, timeframe=None, dims=None):
        self.fetches += 1
        df = self.frame.df.where(F.col(METRIC).isin(list(metrics)))
        if entities is not None:
            df = df.where(F.col(self.entity).isin([int(e) for e in entities]))
        if timeframe is not None:
            at = F.col(AT)
            df = df.where(at.isNull() | ((at >= literal(timeframe.start)) & (at < literal(timeframe.end))))
        named = self.known if dims is None else tuple(dims)
        out = PointFrame(df, (self.entity, *named), self.entity, self.axis, hidden=(METRIC,), sequenced=True)
        return out.having(df)


class FunctionSource(Source):
    """Any function (metrics, entities, timeframe) -> DataFrame of metric, entity, dimensions, at and value: a web service, a feed."""

    def __init__(self, spark: SparkSession, function, dims: Sequence[str] = (), kind: str = INSTANT, entity: str = "entity"):
        pin_session(spark)
        self.function, self.known, self.entity, self.axis = function, tuple(dims), entity, TimeAxis(kind)

    def points(self, metrics, entities=None, timeframe=None, dims=None):
        named = self.known if dims is None else tuple(dims)
        df = self.function(tuple(metrics), entities, timeframe).where(F.col("metric").isin(list(metrics)))
        categories = [F.coalesce(F.col(d).cast("string"), F.lit("")).alias(d) for d in named]
        out = df.select(F.col("metric").alias(METRIC), F.col(self.entity).cast("bigint").alias(self.entity), *categories, F.col(AT).cast(NTZ).alias(AT), _value(F.col(VALUE)).alias(VALUE))
        return PointFrame(out, (self.entity, *named), self.entity, self.axis, hidden=(METRIC,))
