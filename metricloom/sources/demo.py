"""Made-up data for trying things out: the beds of a nursery, their daily readings, and what is picked from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import SEMI_ADDITIVE, Catalog, Metric, Ratio, difference_of
from ..timeaxis import literal
from .points import LongSource

_CROP = ("crop",)
CATALOG = Catalog([
    Metric("moisture", "Soil moisture", "%", grain="day"), Metric("water", "Water", "l", grain="day", dimensions=_CROP),
    Metric("picked", "Picked", "kg", dimensions=_CROP), Metric("spoiled", "Spoiled", "kg", dimensions=_CROP),
    Metric("stock", "Plants", dimensions=_CROP, additivity=SEMI_ADDITIVE),
    Metric("yield", "Picked for 1000 l", "kg", formula=Ratio("picked", "water", 1000.0), dimensions=_CROP),
    Metric("sold", "Sold", "kg", formula=difference_of("picked", "spoiled"), dimensions=_CROP),
])


def rows(spark: SparkSession, start: dt.datetime, days: int = 365, beds: int = 24) -> DataFrame:
    """bed, metric, ts, value, crop: the same rows every time, made in parallel.

    Every bed has one crop and is read each morning unless its sensor is out; it is picked every fourth day
    while its crop is in season.
    """
    chance = lambda what: F.pmod(F.xxhash64("bed", "day", F.lit(what)), F.lit(1_000)) / 1_000.0
    grid = spark.range(days * beds).select((F.col("id") % beds).alias("bed"), F.floor(F.col("id") / beds).cast("int").alias("day"))
    grid = grid.withColumn("crop", F.element_at(F.array(*map(F.lit, ("bean", "leek", "chard"))), (F.col("bed") % 3 + 1).cast("int")))
    year = F.sin(F.col("day") * 0.0172)  # -1 to 1 over a year
    in_season, at_work = (F.col("day") + F.col("bed")) % 4 == 0, chance("sensor") > 0.04
    reading = {
        "moisture": F.when(at_work, F.round(55 + 20 * year * chance("rain"), 1)),
        "water": F.when(at_work, F.round(30 - 12 * year + 8 * chance("water"))),
        "stock": F.when(at_work, F.floor(200 - F.col("day") % 90 + 5 * F.col("bed"))),
        "picked": F.when(in_season & (year > -0.5), F.round(2 + 6 * chance("picked"), 2)),
        "spoiled": F.when(in_season & (chance("spoiled") < 0.3), F.round(chance("spoiled"), 2)),
    }
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in reading.items()]))
    ts = literal(start) + F.make_dt_interval(days=F.col("day"), hours=F.lit(7))
    return grid.select("bed", each.alias("r"), ts.alias("ts"), "crop").select("bed", "r.metric", "ts", "r.value", "crop").where("value is not null")


def source(spark: SparkSession, start: dt.datetime = dt.datetime(2025, 1, 1), days: int = 365, beds: int = 24) -> LongSource:
    return LongSource(spark, rows(spark, start, days, beds), "bed", "ts", {"crop": "crop"}, entity="bed")
