"""Resample as a stream: the one streaming form that a report's bucketing has.

An addition: reports themselves are bounded reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregators import Aggregator
from ..functions.periods import Span
from ..timeaxis import pin_session


def resample_stream(events: DataFrame, keys: Sequence[str], time: str, value: str, period: Span, agg: Aggregator, lateness: str = "1 hour") -> DataFrame:
    """keys, at, value for each finished bucket of a span; later rows than ``lateness`` are dropped by the watermark."""
    pin_session(events.sparkSession)
    if agg.name in ("first", "last"):
        raise ValueError("first and last need a row order, which a stream doesn't have")
    timed = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", lateness)
    buckets = timed.groupBy(*keys, F.window("_at", f"{period.seconds} seconds")).agg(agg.column(F.col(value)).alias("value"))
    return buckets.select(*keys, F.col("window.start").cast("timestamp_ntz").alias("at"), "value").where("value is not null")
