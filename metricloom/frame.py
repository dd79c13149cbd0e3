"""PointFrame: a lazy DataFrame of points and what its columns mean."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .timeaxis import NTZ, TimeAxis

AT, VALUE, ESTIMATED, LOW, HIGH = "at", "value", "estimated", "low", "high"
#: Hidden column with the order in which a source gave its rows.
SEQUENCE = "_sequence"


@dataclass(frozen=True)
class PointFrame:
    """Columns: the dimensions, ``at`` (NULL: timeless), ``value`` (NULL: missing); after a forecast also
    ``estimated`` and, if it has a range, ``low`` and ``high``.

    ``unique`` says that no two points share key and time, as after any bucketing or grouping.
    ``sequenced`` says that the hidden column SEQUENCE ranks points of one key and time; without it they rank
    by value, so that results never depend on how rows are partitioned.
    ``hidden`` dimensions belong to every key though no report names them (the metric of a batch).
    """

    df: DataFrame
    dims: tuple[str, ...]
    entity: str | None = None
    axis: TimeAxis = TimeAxis()
    unit: str | None = None
    estimates: bool = False
    ranged: bool = False
    hidden: tuple[str, ...] = ()
    unique: bool = False
    sequenced: bool = False

    @property
    def keys(self) -> tuple[str, ...]:
        """All key columns in key order."""
        return (*self.hidden, *sorted(self.dims))

    @property
    def extras(self) -> tuple[str, ...]:
        return ((ESTIMATED,) if self.estimates else ()) + ((LOW, HIGH) if self.ranged else ()) + ((SEQUENCE,) if self.sequenced else ())

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.keys, AT, VALUE, *self.extras)

    def order(self) -> list[Column]:
        """Row order: time, then the source's order if it is known, then key.  Aggregates rank what is left by value."""
        return [F.col(AT), *([F.col(SEQUENCE)] if self.sequenced else []), *[F.col(k) for k in self.keys]]

    def ranks(self) -> list[Column]:
        """Row order within a key, without ties but among equal values."""
        return [F.col(AT), *([F.col(SEQUENCE)] if self.sequenced else []), F.col(VALUE)]

    def having(self, df: DataFrame, **changes) -> PointFrame:
        out = replace(self, df=df, **changes)
        if out.sequenced and (out.unique or SEQUENCE not in df.columns):
            out = replace(out, sequenced=False)
        return replace(out, df=out.df.select(*out.columns))

    def refuse_ranges(self, what: str) -> None:
        if self.ranged:
            raise ValueError(f"a forecast with a range can't go into {what}")

    def estimated(self) -> Column:
        """Whether a present value is an estimate, for use in aggregates."""
        return F.col(ESTIMATED) & F.col(VALUE).isNotNull()


def points(spark: SparkSession, rows: Iterable[tuple], dims: dict[str, str], entity: str | None = None, axis: TimeAxis = TimeAxis(), unit: str | None = None) -> PointFrame:
    """A frame from rows (dims..., at, value) in their order; ``dims`` maps names to ``bigint`` or ``string``."""
    fields = [T.StructField(d, T.LongType() if k == "bigint" else T.StringType()) for d, k in dims.items()]
    schema = T.StructType([*fields, T.StructField(AT, T.TimestampNTZType()), T.StructField(VALUE, T.DoubleType()), T.StructField(SEQUENCE, T.LongType())])
    df = spark.createDataFrame([(*r[:-1], None if r[-1] is None else float(r[-1]), i) for i, r in enumerate(rows)], schema)
    frame = PointFrame(df, tuple(dims), entity, axis, unit, sequenced=True)
    return frame.having(df.withColumn(VALUE, F.nanvl(VALUE, F.lit(None).cast("double"))).withColumn(AT, F.col(AT).cast(NTZ)))
