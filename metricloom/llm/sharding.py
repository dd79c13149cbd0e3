"""Sharding by minimax contiguous partition.

Documents with equal texts form one atomic group.  Groups stand in a fixed order (their content hash); the
shards are contiguous pieces of that order, and the largest shard is as small as any such cutting allows:
the driver searches the smallest feasible capacity by bisection, checking each by greedy filling.

The driver never holds all groups.  It knows some group starts and, between them, only that there may be
more; a greedy walk then has a pessimistic and an optimistic end, which bound the capacity from both
sides.  Only the stretches where the two differ are looked at again, in up to ``CELLS`` cells a round,
until both agree.  A group above the mean of the shards that are left gets a shard of its own first.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, partitions, read_table, slice_digits, text_or_empty

SHARDS, OVERHEAD = 40, 16
CELLS, WINDOWS = 100_000, 200


class Starts:
    """Group starts on a line of ``total`` bytes, known in part.

    ``look(windows, width)`` gives (least start, greatest start, count) for each cell that holds a start.  Cells
    are ``width`` bytes long, counted from the start of each window lo <= start < hi, and end with it.
    """

    def __init__(self, total: int, look: Callable[[list[tuple[int, int]], int], list[tuple[int, int, int]]]):
        self.total, self.look = total, look
        self.known, self.exact = [0, total], [False, True]

    def below(self, x: int) -> tuple[int, int]:
        """Bounds of the greatest start (or the end) that is at most x."""
        i = bisect.bisect_right(self.known, x) - 1
        return self.known[i], self.known[i] if self.exact[i] else min(x, self.total)

    def above(self, x: int) -> tuple[int, int]:
        """Bounds of the smallest start that is at least x."""
        i = bisect.bisect_left(self.known, x)
        if self.known[i] == x or self.exact[i - 1]:
            return self.known[i], self.known[i]
        return x, self.known[i]

    def refine(self, windows: list[tuple[int, int]]) -> None:
        """Looks again at all inexact gaps that meet the windows (lo <= start <= hi)."""
        gaps = set()
        for lo, hi in windows:
            i = max(bisect.bisect_right(self.known, lo) - 1, 0)
            while i < len(self.known) - 1 and self.known[i] <= hi:
                if not self.exact[i]:
                    gaps.add(i)
                i += 1
        if not gaps:
            return
        spans = [(self.known[i], self.known[i + 1]) for i in sorted(gaps)]
        merged = [spans[0]]
        for lo, hi in spans[1:]:
            if merged[-1][1] == lo:
                merged[-1] = (merged[-1][0], hi)
            else:
                merged.append((lo, hi))
        merged = fewer(merged)
        width = max(1, sum(hi - lo for lo, hi in merged) // CELLS)
        # What is known inside a window is forgotten: a start in the middle of a cell says nothing about the gap after it.
        lows = [lo for lo, _ in merged]
        outside = lambda p: p < lows[0] or p >= merged[bisect.bisect_right(lows, p) - 1][1]
        points = {p: e for p, e in zip(self.known, self.exact) if outside(p)} | {lo: True for lo in lows}
        for least, greatest, count in self.look(merged, width):
            points[least] = count <= 2
            points[greatest] = True
        self.known = sorted(points)
        self.exact = [points[p] for p in self.known]


def fewer(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """At most WINDOWS windows that cover the given ones: the nearest are joined."""
    if len(windows) <= WINDOWS:
        return windows
    widest = sorted(sorted(range(1, len(windows)), key=lambda i: windows[i - 1][1] - windows[i][0])[: WINDOWS - 1])
    return [(windows[a][0], windows[b - 1][1]) for a, b in zip([0, *widest], [*widest, len(windows)])]


def greedy(starts: Starts, capacity: int, shards: int, sure: bool) -> list[int]:
    """Ends of shards filled one after the other, as far as is sure or at best."""
    at, ends = 0, []
    for _ in range(shards):
        at = starts.total if at + capacity >= starts.total else starts.below(at + capacity)[0 if sure else 1]
        ends.append(at)
    return ends


def smallest_capacity(starts: Starts, shards: int) -> int:
    while True:
        found = []
        for sure in (False, True):
            lo, hi = max(1, -(-starts.total // shards)), starts.total
            while lo < hi:
                middle = (lo + hi) // 2
                if greedy(starts, middle, shards, sure)[-1] == starts.total:
                    hi = middle
                else:
                    lo = middle + 1
            found.append(lo)
        if found[0] == found[1]:
            return found[0]
        starts.refine(list(zip(greedy(starts, found[0], shards, True), greedy(starts, found[1], shards, False))))


def cuts(starts: Starts, shards: int) -> list[int]:
    """Starts of shards 1, 2, ... at the smallest capacity; within it, each cut is as near below its even place as it can be."""
    if not starts.total:
        return []
    capacity = smallest_capacity(starts, shards)
    while True:
        unsure, right, floor = [], [0] * shards + [starts.total], starts.total
        for i in range(shards - 1, 0, -1):  # the least cut i from which the shards after it can still hold the rest
            lo, hi = starts.above(max(0, floor - capacity))
            if lo != hi:
                unsure.append((lo, hi))
            right[i] = floor = hi
        out, at = [], 0
        for i in range(1, shards):
            lo, hi = starts.below(min(starts.total * i // shards, at + capacity))
            if lo != hi:
                unsure.append((lo, hi))
            at = max(right[i], lo)
            out.append(at)
        if not unsure:
            return out
        starts.refine(unsure)


def minimax_shards(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot; with ``carry`` also ``row``, all its columns.

    Size is the UTF-8 length of the text plus ``overhead``.  Equal texts (null counts as empty) share a
    shard; slots count up from 0 in each shard.  Rows that repeat an id are documents of their own, null
    ids come last in their group.  With fewer groups than shards some shards stay empty.  Texts may be of any
    length; an empty table gives an empty result; other columns play no part, whatever their names.  The driver
    holds the sums of the slices (at most 16**5) and, in each round, up to CELLS starts.
    """
    spark = docs.sparkSession
    scratch, salts = Scratch(spark, "sharding"), partitions(spark)
    raw = text_or_empty(docs[text_col]).cast("binary")
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(raw) + overhead).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.unhex(F.sha2(raw, 256)).alias("key"),
        *([F.struct(*docs.columns).alias("row")] if carry else []),
    ).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    base = scratch.write(keyed.drop("row"))
    digits = slice_digits(base.count())
    # An atom is the part of a group with one salt: a hot group is many atoms, which stay together on the line.
    atoms = scratch.write(
        base.groupBy("key", "salt").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).withColumn("slice", F.hex(F.substring("key", 1, 4)).substr(1, digits))
    )
    total = atoms.agg(F.sum("bytes")).first()[0] or 0
    own, left = [], total
    for row in atoms.groupBy("key").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "key").limit(shards).collect():
        if len(own) < shards - 1 and row["bytes"] * (shards - len(own)) > left:
            own.append(bytes(row["key"]))
            left -= row["bytes"]
    is_own = F.col("key").isin(own) if own else F.lit(False)

    sums = sorted(atoms.where(~is_own).groupBy("slice").agg(F.sum("bytes"), F.sum("rows")).collect())
    before = np.cumsum([[0, 0]] + [[r[1], r[2]] for r in sums], axis=0).tolist()
    slices = spark.createDataFrame([(r[0], *b) for r, b in zip(sums, before)], "slice string, slice_at long, slice_rows long")
    upto = Window.partitionBy("slice").orderBy("key", "salt")
    earlier = upto.rowsBetween(Window.unboundedPreceding, -1)
    run = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    line = scratch.write(
        atoms.where(~is_own)
        .select("key", "salt", "slice", run("bytes").alias("at"), run("rows").alias("row"), (~F.col("key").eqNullSafe(F.lag("key").over(upto))).alias("opens"))
        .join(F.broadcast(slices), "slice")  # at most 16**5 rows
        .select("key", "salt", "opens", (F.col("at") + F.col("slice_at")).alias("at"), (F.col("row") + F.col("slice_rows")).alias("row"))
    )

    def look(windows: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
        within = [(F.col("at") >= lo) & (F.col("at") < hi) for lo, hi in windows]
        start = F.coalesce(*[F.when(w, F.lit(lo)) for w, (lo, _) in zip(within, windows)])
        inside = line.where("opens").where(reduce(or_, within)).select("at", start.alias("start"))
        cells = inside.groupBy("start", F.floor((F.col("at") - F.col("start")) / width).alias("cell")).agg(F.min("at"), F.max("at"), F.count(F.lit(1)))
        return [tuple(r) for r in cells.select("min(at)", "max(at)", "count(1)").collect()]

    ends = cuts(Starts(left, look), shards - len(own))
    places = line.where("opens").where(F.col("at").isin(ends)).select("at", "row").collect() if ends else []
    first_row = {r["at"]: r["row"] for r in places} | {0: 0}
    inner = [F.col("at") >= e for e in ends]
    nth = sum((c.cast("int") for c in inner), F.lit(0))
    row_base = F.lit(0).cast("long")
    for e in ends:
        row_base = F.when(F.col("at") >= e, F.lit(first_row.get(e, 0))).otherwise(row_base)
    placed = line.select("key", "salt", (nth + len(own)).cast("int").alias("shard"), (F.col("row") - row_base).alias("first_slot"))
    if own:
        number = F.array_position(F.array(*[F.lit(k) for k in own]), F.col("key")) - 1
        within = Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        big = atoms.where(is_own).select("key", "salt", number.cast("int").alias("shard"), F.coalesce(F.sum("rows").over(within), F.lit(0)).alias("first_slot"))
        placed = placed.unionByName(big)
    rows = (keyed if carry else base).withColumn("nth", F.row_number().over(Window.partitionBy("key", "salt").orderBy(F.col("doc_id").asc_nulls_last())))
    return rows.join(placed, ["key", "salt"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("nth") - 1).cast("long").alias("slot"), *(["row"] if carry else [])
    )


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = minimax_shards(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
