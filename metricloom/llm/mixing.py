"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Each source has a weight and a weight schedule over training time 0..1.  Water-filling turns the weights
into a token target for each source; the integral of a source's schedule, scaled to that target, is its
cumulative demand.  Documents of a source form one fixed pseudo-random stream (repeated when the target
exceeds the source); inverting the demand at a document's place in that stream gives its training
position, and documents are range-sorted by position.

Running sums are two-level: slices of the stream order in each source, more of them for larger tables, are
summed first, so no task holds a whole source.  The table of sources, one short row each, is sorted in one
task; that bounds their number to some ten million.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, Scratch, read_table, slice_digits

#: (time, weight) corners of piecewise linear schedules, dealt to sources in turn as the weights are.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.6, 1.0), (1.0, 1.75)))
WEIGHTS = (1, 2, 3)
CAP = 3


def source_key(source: str) -> Column:
    """A name that no null shares."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Adds source_rank, weight and target to a table of source and source_size (one row per source).

    All targets together are the size of all sources.  A target above ``cap`` times its source stops
    there and the excess is shared again by weight.  Ordered by size for each weight, the stopped sources
    come first, so the common level is found with running sums.
    """
    ranked = sizes.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    w = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "source_rank")
    filled = (
        w.withColumn("stopped", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
        .withColumn("level", (F.col("total") - F.col("stopped")) / F.col("open_weight"))
        .withColumn("nth", F.row_number().over(order))
    )
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("nth"))
    level = F.min_by("level", fits).over(Window.partitionBy())
    return filled.select("source", "source_size", "source_rank", "weight", F.least(F.col("most"), level * F.col("weight")).alias("target"))


def position(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time at which the schedule's integral reaches ``share`` of its whole."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])]
    need, out, done, pieces = share * sum(areas), None, 0.0, []
    for ((t0, w0), (t1, w1)), area in zip(zip(schedule, schedule[1:]), areas):
        slope, left = (w1 - w0) / (t1 - t0), need - done
        at = left / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(w0 * w0) + left * (2 * slope), F.lit(0.0))) - w0) / slope
        pieces.append((done + area, at + t0))
        done += area
    for upto, at in reversed(pieces):
        out = at if out is None else F.when(need <= upto, at).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def curriculum_mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, schedules=SCHEDULES, seed: str = "mix-1",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, positions.

    ``copies`` whole passes of the document are taken (0 to ``cap``), ``positions`` holds their training
    times.  Every document is passed floor(target / source size) times, and those at the head of the
    source's stream once more, until the source's target is met to within half a document.  A null text
    has size 0; a null source is a source of its own, last in order; documents of size 0 add nothing and
    follow their place in the stream.  Rows that repeat an id are separate documents.  No randomness but
    the MD5 of seed and id: reruns agree.  Texts of any length count all their words; an empty table gives an
    empty result; other columns play no part, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    base = scratch.write(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
        .withColumn("key", source_key("source"))
        .withColumn("place", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    )
    base = base.withColumn("slice", F.substring("place", 1, slice_digits(base.count())))
    slices = base.groupBy("key", "source", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("key", "slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("offset"))
    per_source = targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, cap).withColumn("key", source_key("source"))
    offsets = offsets.join(per_source.drop("source"), "key")

    stream = Window.partitionBy("key", "slice").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = base.withColumn("upto", F.sum("size").over(stream)).join(offsets, ["key", "slice"])
    start = (F.col("offset") + F.col("upto") - F.col("size")).cast("double")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("middle", start + F.col("size") / 2.0).withColumn("passes", passes)
    placed = placed.withColumn("copies", F.col("passes") + (F.col("middle") < F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))

    def when(k: Column) -> Column:
        share = F.least((k * F.col("source_size") + F.col("middle")) / F.col("target"), F.lit(1.0))
        out = position(share, schedules[-1])
        for i, schedule in enumerate(schedules[:-1]):
            out = F.when(F.pmod(F.col("source_rank") - 1, F.lit(len(schedules))) == i, position(share, schedule)).otherwise(out)
        return out

    passes_taken = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(F.array().cast("array<bigint>"))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        F.transform(passes_taken, when).alias("positions"), "place",
    )


def training_order(mix: DataFrame) -> DataFrame:
    """The curriculum itself: one row per copy taken, range-sorted by training position."""
    copies = mix.select("doc_id", "source", "size", F.posexplode("positions").alias("copy", "position"), "place")
    return copies.orderBy("position", "place", "copy").drop("place")


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the mix, range-sorted by the position of a document's first copy, unused ones last."""
    mix = curriculum_mix(read_table(spark, sf_dir, "documents"))
    first = F.try_element_at("positions", F.lit(1))
    return mix.withColumn("at", first).orderBy(F.col("at").asc_nulls_last(), "place").select(
        "doc_id", "size", "source_size", "target", "taken", F.round("at", 6).alias("first_position")
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS place
  FROM documents),
r AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS source_rank FROM d GROUP BY source),
w AS (SELECT *, ((source_rank - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS most FROM r),
f AS (
  SELECT *, row_number() OVER o AS nth, (sum(source_size) OVER ())::DOUBLE AS total,
    coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM w WINDOW o AS (ORDER BY source_size / weight, source_rank)),
l AS (SELECT *, (total - stopped) / open_weight AS level FROM f),
t AS (
  SELECT source, source_size, source_rank,
    least(most, (SELECT arg_min(level, nth) FROM l WHERE level * weight <= most) * weight) AS target FROM l),
s AS (
  SELECT d.doc_id, d.size, t.*, (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::DOUBLE + d.size / 2.0::DOUBLE AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM s),
c AS (SELECT *, passes + (middle < target - passes * source_size)::BIGINT AS copies, least(middle / nullif(target, 0), 1.0) AS share FROM p)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken,
  CASE WHEN copies > 0 THEN round(least(greatest(CASE (source_rank - 1) % 3
    WHEN 0 THEN (sqrt(greatest(2.25 + share * (2 * -1.0), 0)) - 1.5) / -1.0
    WHEN 1 THEN share
    ELSE CASE WHEN share * 1.0 <= 0.45 THEN (sqrt(0.25 + share * (2 * (0.5 / 0.6))) - 0.5) / (0.5 / 0.6)
              ELSE (sqrt(1.0 + (share - 0.45) * (2 * (0.75 / 0.4))) - 1.0) / (0.75 / 0.4) + 0.6 END END, 0), 1), 6) END AS first_position
FROM c
"""
