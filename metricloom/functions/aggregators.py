"""Aggregators.  All leave out missing (NULL) values, and give NULL where they have no answer."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregator:
    """A named aggregate.  ``percent`` is set for percentiles (linear between closest ranks, exact)."""

    name: str
    percent: float | None = None

    def column(self, value: Column, order: Sequence[Column] = ()) -> Column:
        """Over a group; ``order`` ranks its rows for first and last, the value ranks rows that are equal in it."""
        present = F.count(value)
        if self.percent is not None:
            return F.percentile(value, self.percent / 100)
        if self.name == "count":
            return F.when(present > 0, present.cast("double"))
        if self.name in ("first", "last"):
            place = F.when(value.isNotNull(), F.struct(*order, value))
            return F.min_by(value, place) if self.name == "first" else F.max_by(value, place)
        return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_samp, "variance": F.var_samp}[self.name](value)

    def over(self, value: Column, window: WindowSpec) -> Column:
        """Over an ordered window with a frame."""
        if self.name == "count":
            n = F.count(value).over(window)
            return F.when(n > 0, n.cast("double"))
        if self.name == "first":
            return F.first(value, ignorenulls=True).over(window)
        if self.name == "last":
            return F.last(value, ignorenulls=True).over(window)
        return self.column(value).over(window)

    def of_array(self, values: Column) -> Column:
        """Over an array of values in order, NULLs included."""
        v = F.filter(values, lambda x: x.isNotNull())
        n = F.size(v)
        total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
        mean = F.try_divide(total, n)
        spread = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        if self.percent is not None:
            ordered, rank = F.array_sort(v), (n - 1) * (self.percent / 100)
            low = F.try_element_at(ordered, (F.floor(rank) + 1).cast("int"))
            high = F.try_element_at(ordered, (F.ceil(rank) + 1).cast("int"))
            out = low + (high - low) * (rank - F.floor(rank))
        else:
            out = {
                "sum": lambda: total, "mean": lambda: mean, "count": lambda: n.cast("double"), "min": lambda: F.array_min(v), "max": lambda: F.array_max(v),
                "first": lambda: F.try_element_at(v, F.lit(1)), "last": lambda: F.try_element_at(v, F.lit(-1)),
                "variance": lambda: F.when(n > 1, spread / (n - 1)), "stddev": lambda: F.when(n > 1, F.sqrt(spread / (n - 1))),
            }[self.name]()
        return F.when(n > 0, out)


@dataclass(frozen=True)
class CustomAggregator(Aggregator):
    """An aggregate given as a Python function of a float Series (never empty, in row order).

    Spark sorts each group's values into an array, and the function runs on Arrow batches of such arrays, so
    it fits beside any other aggregate.
    """

    function: Callable[[pd.Series], float] = None

    def column(self, value, order=()):
        rows = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], value.alias("v"))))
        return self.of_array(F.transform(rows, lambda r: r["v"]))

    def over(self, value, window):
        return self.of_array(F.transform(F.collect_list(F.struct(value.alias("v"))).over(window), lambda r: r["v"]))

    def of_array(self, values):
        function = self.function

        def run(rows: pd.Series) -> pd.Series:
            kept = [pd.Series([x for x in row if x is not None], dtype=float) for row in rows]
            return pd.Series([float(function(v)) if len(v) else None for v in kept], dtype="float64")

        return F.pandas_udf(run, "double")(values)


#: Aggregators by name; percentiles are p1, p99.5 and so on.
NAMES = ("sum", "mean", "min", "max", "count", "first", "last", "median", "stddev", "variance")
SUM, MEAN, MIN, MAX, COUNT, FIRST, LAST, MEDIAN, STDDEV, VARIANCE = (Aggregator(n, 50.0 if n == "median" else None) for n in NAMES)
_BY_NAME = {a.name: a for a in (SUM, MEAN, MIN, MAX, COUNT, FIRST, LAST, MEDIAN, STDDEV, VARIANCE)}


def percentile(p: float) -> Aggregator:
    if not 0 < p < 100:
        raise ValueError("a percentile lies between 0 and 100")
    return Aggregator(f"p{p:g}", float(p))


def resolve(name: str | Aggregator) -> Aggregator:
    if isinstance(name, Aggregator):
        return name
    found = try_resolve(name)
    if found is None:
        raise ValueError(f"unknown aggregator '{name}'; there are {', '.join(NAMES)} and p<percent>")
    return found


def try_resolve(name: str) -> Aggregator | None:
    lower = name.lower()
    if lower in _BY_NAME:
        return _BY_NAME[lower]
    match = re.fullmatch(r"p(\d+(?:\.\d+)?)", lower)
    return percentile(float(match[1])) if match and 0 < float(match[1]) < 100 else None
