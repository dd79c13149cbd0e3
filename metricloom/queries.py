"""The registered queries over the driver tables, each with SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import AT, VALUE, PointFrame
from .functions.aggregators import COUNT, FIRST, LAST, MAX, MEAN, MEDIAN, MIN, STDDEV, SUM, VARIANCE, CustomAggregator, percentile
from .functions.baseline import Baseline
from .functions.charts import marks_frame, stacked_extent
from .functions.periods import DAY, HOUR, MONTH, SEASON, WEEK, Boundaries, Span
from .operators.base import Filter, Map, Rekey, Tag, WhereIn, WhereNotIn, WhereValue, merge, run
from .operators.combine import combine, compare
from .operators.forecast import SEASON_END, Forecast, HoltWintersModel, Horizon, MeanModel, SeasonalNaiveModel, TrendModel
from .operators.groups import GroupBy, PerGroup, Reduce, Total
from .operators.resample import CARRY, INTERPOLATE, TIMEFRAME, ZERO, Resample
from .operators.windows import Bottom, Cumulative, Rolling, ShareOf, Top
from .plans.catalog import SEMI_ADDITIVE, Catalog, Linear, Metric, Ratio, difference_of, sum_of
from .plans.dashboard import parse
from .plans.engine import Engine
from .plans.recipes import acute_to_chronic
from .plans.spec import BASELINE, DIFFERENCE, PERCENT, Comparison, DashboardContext, Report, Steps, TargetBand, View
from .sources.points import LOCAL_TIME, METRIC, UTC, LongSource, WideSource, in_zone
from .timeaxis import LOCAL, Calendar, Context, Seasons, Timeframe

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


# Sources, catalogs and engines over the tables


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark, sf, **options) -> LongSource:
    settings = {"entity_column": "user_id", "time_column": "ts", "metric_column": "event_type", "entity": "account"}
    return LongSource(spark, load(spark, sf, "events"), **(settings | options))


def crowd(spark, sf) -> WideSource:
    """All events, dealt to 20 entities."""
    return WideSource(spark, load(spark, sf, "events"), "user_id % 20", "ts", entity="account", metrics={"any": "value"})


def lines(spark, sf) -> WideSource:
    metrics = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    dims = {"flag": "l_returnflag", "status": "l_linestatus"}
    return WideSource(spark, load(spark, sf, "lineitem"), "l_suppkey", "l_shipdate", dims, UTC, "supplier", metrics)


def orders(spark, sf, entity="o_custkey", stored=LOCAL_TIME, time="o_orderdate", dims=None, table=None) -> WideSource:
    dims = {"priority": "o_orderpriority", "status": "o_orderstatus"} if dims is None else dims
    df = load(spark, sf, "orders") if table is None else table
    return WideSource(spark, df, entity, time, dims, stored, "customer", {"total": "o_totalprice", "orders": "1"})


EVENTS = Catalog([
    *[Metric(m, unit="pt") for m in ("purchase", "view", "click", "error", "signup")], Metric("any"),
    Metric("conversion", unit="%", formula=Ratio("purchase", "view", 100.0)),
    Metric("activity", formula=sum_of("purchase", "click")),
    Metric("net", formula=difference_of("purchase", "error")),
    Metric("net-strict", formula=difference_of("purchase", "error", need_all=True)),
    Metric("weighted", formula=Linear((("purchase", 3.0), ("view", 0.5), ("error", -2.0)))),
])
LINES = Catalog([
    *[Metric(m, dimensions=("flag", "status")) for m in ("quantity", "price", "discount", "tax")],
    Metric("unit-price", dimensions=("flag", "status"), formula=Ratio("price", "quantity")),
])
_ORDER_DIMS = ("priority", "status")
ORDERS = Catalog([
    Metric("total", "Total", "USD", dimensions=_ORDER_DIMS, time_kind=LOCAL), Metric("orders", "Orders", dimensions=_ORDER_DIMS, time_kind=LOCAL),
    Metric("average", "Average order", "USD", dimensions=_ORDER_DIMS, time_kind=LOCAL, formula=Ratio("total", "orders")),
])
ORDERS_UTC = Catalog([Metric("total", dimensions=_ORDER_DIMS), Metric("orders", dimensions=_ORDER_DIMS)])


def table(frame: PointFrame, digits: int = 7, timeless: bool = False) -> DataFrame:
    """The driver's form of a frame: keys, bucket, rounded value."""
    keys = [F.col(h).alias("metric") if h == METRIC else F.col(h) for h in frame.keys]
    time = [] if timeless else [F.col(AT).alias("bucket")]
    extra = [F.col("estimated")] if frame.estimates else []
    extra += [F.round(c, digits).alias(c) for c in ("low", "high")] if frame.ranged else []
    return frame.df.select(*keys, *time, (F.round(VALUE, digits) + F.lit(0.0)).alias("value"), *extra)


def day(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def frame_of(a: str, b: str) -> Timeframe:
    return Timeframe(day(a), day(b))


def report(catalog, source, metric, *transforms, calendar=Calendar(), timeless=False, digits=7, **options) -> Query:
    """A query that runs one report."""

    def made(spark, sf):
        return table(Engine(catalog, source(spark, sf), calendar).frame(Report(metric, transforms=tuple(transforms), **options)), digits, timeless)

    return made


def add(name: str, made: Query, sql: str | None = None) -> None:
    query(name, sql)(made)


# Scans

add("scan_long_raw", report(EVENTS, events, "purchase", timeframe=frame_of("2024-01-05", "2024-01-12")),
    "SELECT user_id AS account, ts AS bucket, round(value, 7) AS value FROM events WHERE event_type = 'purchase' AND ts >= '2024-01-05' AND ts < '2024-01-12'")


@query("scan_wide_raw", """
SELECT metric, supplier, bucket, round(value, 7) AS value FROM (
  SELECT l_suppkey AS supplier, l_shipdate AS bucket, l_quantity AS quantity, l_extendedprice AS price FROM lineitem
  WHERE l_suppkey IN (1, 2, 3) AND l_shipdate >= '1996-01-01' AND l_shipdate < '1997-01-01') UNPIVOT (value FOR metric IN (quantity, price))""")
def scan_wide_raw(spark, sf):
    return table(lines(spark, sf).points(("quantity", "price"), (1, 2, 3), frame_of("1996-01-01", "1997-01-01"), ()))


def orders_with_gaps(spark, sf):
    dims = {"priority": "nullif(o_orderpriority, '5-LOW')", "status": "o_orderstatus"}
    return orders(spark, sf, dims=dims)


add("scan_dims_null_category", report(ORDERS, orders_with_gaps, "total", Total(COUNT, ("priority",)), dimensions=("priority",), timeless=True),
    "SELECT coalesce(nullif(o_orderpriority, '5-LOW'), '') AS priority, count(*)::DOUBLE AS value FROM orders GROUP BY 1")
add("scan_entity_list", report(ORDERS, orders, "total", Resample(MONTH, SUM), entities=tuple(range(1, 1300)), digits=2),
    "SELECT o_custkey AS customer, date_trunc('month', o_orderdate)::TIMESTAMP AS bucket, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_custkey BETWEEN 1 AND 1299 GROUP BY 1, 2")

# Resampling by period, calendar and zone

_PURCHASES = "SELECT user_id AS account, {0} AS bucket, round(avg(value), 7) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2"
_SEASON = "CASE WHEN month({0}) >= 7 THEN make_timestamp(year({0}), 7, 1, 0, 0, 0) ELSE make_timestamp(year({0}) - 1, 7, 1, 0, 0, 0) END"
for _name, _period, _sql in (
    ("day", DAY, "date_trunc('day', ts)::TIMESTAMP"), ("week", WEEK, "date_trunc('week', ts)::TIMESTAMP"), ("month", MONTH, "date_trunc('month', ts)::TIMESTAMP"),
    ("15m", Span(900), "time_bucket(INTERVAL '15 minutes', ts)"), ("hour", HOUR, "time_bucket(INTERVAL '1 hour', ts)"),
    ("6h", Span(21600), "time_bucket(INTERVAL '6 hours', ts)"), ("30s", Span(30), "time_bucket(INTERVAL '30 seconds', ts)"),
):
    add(f"resample_{_name}", report(EVENTS, events, "purchase", Resample(_period, MEAN)), _PURCHASES.format(_sql))
add("resample_season", report(ORDERS, orders, "total", Resample(SEASON, SUM), digits=2),
    f"SELECT o_custkey AS customer, {_SEASON.format('o_orderdate')} AS bucket, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2")
add("resample_season_mid_month", report(ORDERS, orders, "orders", Resample(SEASON, SUM), calendar=Calendar(season=(8, 15))), """
SELECT o_custkey AS customer, make_timestamp(year(o_orderdate) - CASE WHEN strftime(o_orderdate, '%m%d') >= '0815' THEN 0 ELSE 1 END, 8, 15, 0, 0, 0) AS bucket,
  count(*)::DOUBLE AS value FROM orders GROUP BY 1, 2""")
_LISTED = Calendar(season=Seasons((day("1995-03-10"), day("1996-02-29"), day("1997-03-14"), day("1997-11-01"), day("1999-02-05"))))
_TERM = """CASE WHEN {0} < '1995-03-10' OR {0} >= '1999-02-05' THEN NULL WHEN {0} < '1996-02-29' THEN TIMESTAMP '1995-03-10'
  WHEN {0} < '1997-03-14' THEN TIMESTAMP '1996-02-29' WHEN {0} < '1997-11-01' THEN TIMESTAMP '1997-03-14' ELSE TIMESTAMP '1997-11-01' END"""
add("resample_season_listed", report(ORDERS, orders, "total", Resample(SEASON, SUM), calendar=_LISTED, digits=2),
    f"SELECT o_custkey AS customer, {_TERM.format('o_orderdate')} AS bucket, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2 HAVING bucket IS NOT NULL")
for _name, _start, _shift in (("sunday", 6, 1), ("saturday", 5, 2), ("wednesday", 2, 5)):
    add(f"resample_week_{_name}", report(EVENTS, events, "purchase", Resample(WEEK, MEAN), calendar=Calendar(week_start=_start)),
        _PURCHASES.format(f"(date_trunc('week', ts + INTERVAL {_shift} DAY) - INTERVAL {_shift} DAY)::TIMESTAMP"))
for _name, _zone in (("london", "Europe/London"), ("newyork", "America/New_York"), ("sydney", "Australia/Sydney"), ("kolkata", "Asia/Kolkata")):
    _local = f"(ts AT TIME ZONE 'UTC' AT TIME ZONE '{_zone}')"
    add(f"resample_week_{_name}", report(EVENTS, events, "purchase", Resample(WEEK, MEAN), calendar=Calendar(_zone)), _PURCHASES.format(f"date_trunc('week', {_local})::TIMESTAMP"))
    add(f"resample_hour_{_name}", report(EVENTS, events, "view", Resample(HOUR, MEAN), calendar=Calendar(_zone)),
        _PURCHASES.format(f"date_trunc('hour', {_local})::TIMESTAMP").replace("'purchase'", "'view'"))
    add(f"resample_month_{_name}", report(ORDERS_UTC, lambda s, d: orders(s, d, stored=UTC), "orders", Resample(MONTH, SUM), calendar=Calendar(_zone)),
        f"SELECT o_custkey AS customer, date_trunc('month', o_orderdate AT TIME ZONE 'UTC' AT TIME ZONE '{_zone}')::TIMESTAMP AS bucket, count(*)::DOUBLE AS value FROM orders GROUP BY 1, 2")
_TERMS = tuple(day(t) for t in ("1995-01-01", "1996-04-10", "1997-09-01", "1999-02-15"))
add("resample_custom_calendar", report(ORDERS, orders, "orders", Resample(Boundaries("term", _TERMS), SUM)), """
SELECT o_custkey AS customer, CASE WHEN o_orderdate >= '1999-02-15' THEN '1999-02-15' WHEN o_orderdate >= '1997-09-01' THEN '1997-09-01'
  WHEN o_orderdate >= '1996-04-10' THEN '1996-04-10' ELSE '1995-01-01' END::TIMESTAMP AS bucket, count(*)::DOUBLE AS value FROM orders GROUP BY 1, 2""")

# Wall clocks of a zone

_YEARS = frame_of("1995-01-01", "2002-01-01")
_WALL = "o_orderdate + to_minutes(CAST((o_orderkey * 7) % 1440 AS INTEGER))"


#: The first Sundays of April and the last of October on which New York changed its clocks at 2:00.
_CHANGES = (
    ("1995-04-02", "1995-10-29"), ("1996-04-07", "1996-10-27"), ("1997-04-06", "1997-10-26"), ("1998-04-05", "1998-10-25"), ("1999-04-04", "1999-10-31"), ("2000-04-02", "2000-10-29"),
    ("2001-04-01", "2001-10-28"),
)


def _from_wall(later: bool) -> str:
    """The UTC time of a New York wall clock: skipped hours count as before the change, repeated ones as before (or after) it."""
    summer = " OR ".join(f"(wall >= '{a} 03:00' AND wall < '{b} {'01:00' if later else '02:00'}')" for a, b in _CHANGES)
    return f"wall + to_hours(CASE WHEN {summer} THEN 4 ELSE 5 END)"


def _wall_orders(stored):
    def source(spark, sf):
        df = load(spark, sf, "orders").withColumn("wall", F.expr("o_orderdate + make_dt_interval(0, 0, cast((o_orderkey * 7) % 1440 as int))"))
        return orders(spark, sf, entity="o_custkey % 10", stored=stored, time="wall", table=df)

    return source


for _name, _stored, _later in (("", in_zone("America/New_York"), False), ("_later", in_zone("America/New_York", "later"), True)):
    add(f"stored_inzone_newyork{_name}", report(ORDERS_UTC, _wall_orders(_stored), "orders", Resample(HOUR, SUM), timeframe=_YEARS),
        f"SELECT o_custkey % 10 AS customer, date_trunc('hour', {_from_wall(_later)})::TIMESTAMP AS bucket, count(*)::DOUBLE AS value FROM (SELECT *, {_WALL} AS wall FROM orders) GROUP BY 1, 2")

# Aggregators

for _agg, _sql in (
    (SUM, "sum(value)"), (MEAN, "avg(value)"), (MIN, "min(value)"), (MAX, "max(value)"), (COUNT, "count(value)::DOUBLE"), (MEDIAN, "quantile_cont(value, 0.5)"),
    (FIRST, "arg_min(value, ts)"), (LAST, "arg_max(value, ts)"), (STDDEV, "stddev_samp(value)"), (VARIANCE, "var_samp(value)"),
    (percentile(90), "quantile_cont(value, 0.9)"), (percentile(99.5), "quantile_cont(value, 0.995)"),
):
    add(f"agg_{_agg.name.replace('.', '_')}", report(EVENTS, crowd, "any", Resample(WEEK, _agg)),
        f"SELECT user_id % 20 AS account, date_trunc('week', ts)::TIMESTAMP AS bucket, round({_sql}, 7) AS value FROM events GROUP BY 1, 2 HAVING {_sql} IS NOT NULL")

# Gap policies

_MONTHS_OF_EACH = """m AS (SELECT o_custkey AS customer, date_trunc('month', o_orderdate)::TIMESTAMP AS bucket, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
s AS (SELECT customer, unnest(generate_series({0}, {1}, INTERVAL 1 MONTH)) AS bucket FROM (SELECT customer, min(bucket) AS a, max(bucket) AS b FROM m GROUP BY 1)),
d AS (SELECT s.customer, s.bucket, v, row_number() OVER (PARTITION BY s.customer ORDER BY s.bucket) AS i FROM s LEFT JOIN m ON m.customer = s.customer AND m.bucket = s.bucket)"""
_OBSERVED = _MONTHS_OF_EACH.format("a", "b")
_MONTHLY = Resample(MONTH, SUM)
add("gap_leave", report(ORDERS, orders, "total", _MONTHLY), f"WITH {_OBSERVED} SELECT customer, bucket, round(v, 7) AS value FROM m")
add("gap_zero", report(ORDERS, orders, "total", Resample(MONTH, SUM, ZERO)), f"WITH {_OBSERVED} SELECT customer, bucket, round(coalesce(v, 0), 7) AS value FROM d")
add("gap_carry", report(ORDERS, orders, "total", Resample(MONTH, SUM, CARRY)),
    f"WITH {_OBSERVED} SELECT customer, bucket, round(last_value(v IGNORE NULLS) OVER (PARTITION BY customer ORDER BY bucket), 7) AS value FROM d")
add("gap_interpolate", report(ORDERS, orders, "total", Resample(MONTH, SUM, INTERPOLATE)), f"""WITH {_OBSERVED},
n AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER p AS i0,
  first_value(v IGNORE NULLS) OVER q AS v1, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER q AS i1 FROM d
  WINDOW p AS (PARTITION BY customer ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY customer ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT customer, bucket, round(CASE WHEN v IS NOT NULL THEN v ELSE v0 + (v1 - v0) * (i - i0) / (i1 - i0) END, 7) AS value FROM n""")
_WIDE_FRAME = frame_of("1994-11-15", "2002-02-01")
add("gap_zero_timeframe", report(ORDERS, orders, "total", Resample(MONTH, SUM, ZERO, TIMEFRAME), timeframe=_WIDE_FRAME),
    f"WITH {_MONTHS_OF_EACH.format('''TIMESTAMP '1994-11-01' ''', '''TIMESTAMP '2002-01-01' ''')} SELECT customer, bucket, round(coalesce(v, 0), 7) AS value FROM d")
add("gap_carry_timeframe", report(ORDERS, orders, "total", Resample(MONTH, SUM, CARRY, TIMEFRAME), timeframe=_WIDE_FRAME),
    f"""WITH {_MONTHS_OF_EACH.format('''TIMESTAMP '1994-11-01' ''', '''TIMESTAMP '2002-01-01' ''')}
SELECT * FROM (SELECT customer, bucket, round(last_value(v IGNORE NULLS) OVER (PARTITION BY customer ORDER BY bucket), 7) AS value FROM d) WHERE value IS NOT NULL""")  # fmt: skip
add("gap_zero_day", report(EVENTS, events, "signup", Resample(DAY, COUNT, ZERO)), """
WITH m AS (SELECT user_id AS account, date_trunc('day', ts)::TIMESTAMP AS bucket, count(value)::DOUBLE AS v FROM events WHERE event_type = 'signup' GROUP BY 1, 2),
s AS (SELECT account, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS bucket FROM (SELECT account, min(bucket) AS a, max(bucket) AS b FROM m GROUP BY 1))
SELECT s.account, s.bucket, coalesce(v, 0) AS value FROM s LEFT JOIN m ON m.account = s.account AND m.bucket = s.bucket""")

# Rolling and cumulative windows

_DAILY = "d AS (SELECT user_id % 20 AS account, date_trunc('day', ts)::TIMESTAMP AS bucket, sum(value) AS v FROM events GROUP BY 1, 2)"
_DAYS = Resample(DAY, SUM)


def _last_days(days: int) -> str:
    return f"(PARTITION BY account ORDER BY bucket RANGE BETWEEN INTERVAL '{days - 1} days 23:59:59.999999' PRECEDING AND CURRENT ROW)"


for _name, _days, _agg, _sql in (
    ("mean_7d", 7, MEAN, "avg(v)"), ("sum_28d", 28, SUM, "sum(v)"), ("count", 5, COUNT, "count(v)::DOUBLE"), ("p90", 7, percentile(90), "quantile_cont(v, 0.9)"),
    ("median", 9, MEDIAN, "quantile_cont(v, 0.5)"), ("last", 3, LAST, "arg_max(v, bucket)"), ("max", 7, MAX, "max(v)"), ("stddev", 7, STDDEV, "stddev_samp(v)"),
):
    add(f"rolling_{_name}", report(EVENTS, crowd, "any", _DAYS, Rolling(dt.timedelta(days=_days), _agg)),
        f"WITH {_DAILY} SELECT account, bucket, round({_sql} OVER {_last_days(_days)}, 7) AS value FROM d".replace("::DOUBLE OVER", " OVER").replace("round(count(v) OVER", "round((count(v) OVER")
        .replace("CURRENT ROW), 7)", "CURRENT ROW))::DOUBLE, 7)" if _name == "count" else "CURRENT ROW), 7)"))
add("rolling_raw_count", report(LINES, lines, "price", Rolling(dt.timedelta(days=30), COUNT)), """
WITH d AS (SELECT l_suppkey AS supplier, l_shipdate AS bucket, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) AS i FROM lineitem)
SELECT supplier, bucket, (i - (SELECT count(*) FROM d e WHERE e.supplier = d.supplier AND e.bucket <= d.bucket - INTERVAL 30 DAY))::DOUBLE AS value FROM d""")


@query("acwr", f"WITH {_DAILY} SELECT account, bucket, round(avg(v) OVER {_last_days(7)} / avg(v) OVER {_last_days(28)}, 7) AS value FROM d")
def acwr(spark, sf):
    return table(acute_to_chronic(Engine(EVENTS, crowd(spark, sf)).frame(Report("any", transforms=(_DAYS,)))))


_BY_PRIORITY = "m AS (SELECT o_orderpriority AS priority, date_trunc('month', o_orderdate)::TIMESTAMP AS bucket, count(*)::DOUBLE AS v FROM orders GROUP BY 1, 2)"
_PRIORITIES = (_MONTHLY, GroupBy(SUM, ("priority",)))
for _agg, _sql in ((SUM, "sum(v)"), (MEAN, "avg(v)"), (MAX, "max(v)"), (MIN, "min(v)"), (percentile(90), "quantile_cont(v, 0.9)"), (FIRST, "arg_min(v, bucket)")):
    add(f"cumulative_{_agg.name}", report(ORDERS, orders, "orders", *_PRIORITIES, Cumulative(_agg), dimensions=("priority",)),
        f"WITH {_BY_PRIORITY} SELECT priority, bucket, round({_sql} OVER (PARTITION BY priority ORDER BY bucket ROWS UNBOUNDED PRECEDING), 7) AS value FROM m")

# Groups, shares and ranks

add("groupby_dim_month", report(LINES, lines, "price", Resample(MONTH, SUM), GroupBy(SUM, ("flag", "status")), dimensions=("flag", "status"), digits=2),
    "SELECT l_returnflag AS flag, l_linestatus AS status, date_trunc('month', l_shipdate)::TIMESTAMP AS bucket, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1, 2, 3")
add("groupby_none_month", report(LINES, lines, "quantity", Resample(MONTH, SUM), GroupBy(MEAN)), """
SELECT bucket, round(avg(v), 7) AS value FROM (SELECT l_suppkey, date_trunc('month', l_shipdate)::TIMESTAMP AS bucket, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
add("groupby_distinct_count", report(LINES, lines, "quantity", Resample(MONTH, SUM), GroupBy(COUNT)),
    "SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS bucket, count(DISTINCT l_suppkey)::DOUBLE AS value FROM lineitem GROUP BY 1")
add("total_dim", report(LINES, lines, "price", Total(SUM, ("flag",)), dimensions=("flag",), timeless=True, digits=2),
    "SELECT l_returnflag AS flag, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1")
add("total_all", report(LINES, lines, "discount", Total(MEAN), timeless=True), "SELECT round(avg(l_discount), 7) AS value FROM lineitem")
add("total_empty", report(LINES, lines, "discount", Total(SUM), entities=(-1,), timeless=True), "SELECT 0.0::DOUBLE AS value WHERE false")
add("reduce_key", report(LINES, lines, "quantity", Reduce(lambda p: {"parity": p["supplier"] % 2, "year": F.year(p.at).cast("string")}, SUM, "parity-year"), timeless=True),
    "SELECT l_suppkey % 2 AS parity, year(l_shipdate)::VARCHAR AS year, round(sum(l_quantity), 7) AS value FROM lineitem GROUP BY 1, 2")
add("pergroup_cumulative", report(ORDERS, orders, "orders", *_PRIORITIES, PerGroup(lambda p: {"year": F.year(p.at)}, Cumulative(SUM), "year"), dimensions=("priority",), digits=2),
    f"WITH {_BY_PRIORITY} SELECT priority, bucket, round(sum(v) OVER (PARTITION BY priority, year(bucket) ORDER BY bucket ROWS UNBOUNDED PRECEDING), 2) AS value FROM m")
add("pergroup_top", report(LINES, lines, "price", Total(SUM, ("flag", "supplier")), PerGroup(lambda p: {"parity": p["supplier"] % 2}, Top(2, SUM, ("flag",)), "parity"), dimensions=("flag",), timeless=True, digits=2), """
SELECT flag, supplier, round(v, 2) AS value FROM (SELECT *, row_number() OVER (PARTITION BY supplier % 2, flag ORDER BY v DESC, supplier) AS i FROM (
  SELECT l_returnflag AS flag, l_suppkey AS supplier, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)) WHERE i <= 2""")
add("share_of_dim", report(LINES, lines, "price", Total(SUM, ("flag", "supplier")), ShareOf(("flag",)), dimensions=("flag",), timeless=True), """
SELECT flag, supplier, round(100 * v / sum(v) OVER (PARTITION BY supplier), 7) AS value FROM (SELECT l_returnflag AS flag, l_suppkey AS supplier, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)""")
add("share_of_month", report(LINES, lines, "price", Resample(MONTH, SUM), GroupBy(SUM, ("flag",)), ShareOf(("flag",)), dimensions=("flag",)), """
SELECT flag, bucket, round(100 * v / sum(v) OVER (PARTITION BY bucket), 7) AS value FROM (
  SELECT l_returnflag AS flag, date_trunc('month', l_shipdate)::TIMESTAMP AS bucket, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)""")
_BY_SUPPLIER = "SELECT l_suppkey AS supplier, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1"
for _name, _rank, _order in (("top5_total", Top(5), "DESC"), ("bottom3_total", Bottom(3), "ASC")):
    add(_name, report(LINES, lines, "price", Total(SUM, ("supplier",)), _rank, timeless=True, digits=2),
        f"SELECT supplier, round(v, 2) AS value FROM ({_BY_SUPPLIER}) ORDER BY v {_order}, supplier LIMIT {_rank.n}")
add("top3_per_dim", report(LINES, lines, "price", Total(SUM, ("flag", "supplier")), Top(3, SUM, ("flag",)), dimensions=("flag",), timeless=True, digits=2), """
SELECT flag, supplier, round(v, 2) AS value FROM (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY v DESC, supplier) AS i FROM (
  SELECT l_returnflag AS flag, l_suppkey AS supplier, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)) WHERE i <= 3""")
add("top5_keep_months", report(LINES, lines, "price", Resample(MONTH, SUM), Top(5), digits=2), f"""
WITH t AS (SELECT supplier FROM ({_BY_SUPPLIER}) ORDER BY v DESC, supplier LIMIT 5)
SELECT l_suppkey AS supplier, date_trunc('month', l_shipdate)::TIMESTAMP AS bucket, round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_suppkey IN (FROM t) GROUP BY 1, 2""")

# Filters and mappings

_FLAGS = "SELECT l_returnflag AS flag, l_suppkey AS supplier, date_trunc('month', l_shipdate)::TIMESTAMP AS bucket, round(sum(l_quantity), 7) AS value FROM lineitem {0} GROUP BY 1, 2, 3 {1}"
_QUANTITY = (LINES, lines, "quantity")
add("where_in", report(*_QUANTITY, WhereIn("flag", ("R", "A")), WhereIn("supplier", ("1", "2", 7)), Resample(MONTH, SUM), dimensions=("flag",)), _FLAGS.format("WHERE l_returnflag IN ('R', 'A') AND l_suppkey IN (1, 2, 7)", ""))
add("where_not_in", report(*_QUANTITY, Resample(MONTH, SUM), WhereNotIn("flag", ("N",)), dimensions=("flag",)), _FLAGS.format("WHERE l_returnflag <> 'N'", ""))
add("where_value", report(*_QUANTITY, Resample(MONTH, SUM), WhereValue(50, 120), dimensions=("flag",)), _FLAGS.format("", "HAVING sum(l_quantity) BETWEEN 50 AND 120"))
add("filter_lambda", report(*_QUANTITY, Filter(lambda p: (p.value > 25) & (p["flag"] != "A"), "big"), Resample(MONTH, SUM), dimensions=("flag",)), _FLAGS.format("WHERE l_quantity > 25 AND l_returnflag <> 'A'", ""))
add("map_lambda", report(*_QUANTITY, Map(lambda p: F.when(p.value > 10, p.value * 2), "double"), Resample(MONTH, SUM), dimensions=("flag",)),
    "SELECT l_returnflag AS flag, l_suppkey AS supplier, date_trunc('month', l_shipdate)::TIMESTAMP AS bucket, round(sum(l_quantity * 2), 7) AS value FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2, 3")
add("rekey_lambda", report(*_QUANTITY, Rekey(lambda p: {"half": F.concat(p["flag"], F.lit("-"), p["status"])}, "half"), Resample(MONTH, SUM), dimensions=("flag", "status")),
    "SELECT l_returnflag || '-' || l_linestatus AS half, date_trunc('month', l_shipdate)::TIMESTAMP AS bucket, round(sum(l_quantity), 7) AS value FROM lineitem GROUP BY 1, 2")

# Derived metrics

_PAIR = """p AS (SELECT user_id AS account, date_trunc('{0}', ts)::TIMESTAMP AS bucket, sum(value) FILTER (event_type = 'purchase') AS n, sum(value) FILTER (event_type = 'view') AS d
  FROM events WHERE event_type IN ('purchase', 'view') GROUP BY 1, 2)"""
_RATIO = "SELECT account, bucket, round(coalesce(n, 0) / d * 100, 7) AS value FROM p WHERE d <> 0"
add("ratio_metric_month", report(EVENTS, events, "conversion", Resample(MONTH, MEAN)), f"WITH {_PAIR.format('month')} {_RATIO}")
add("ratio_missing_numerator_zero", report(EVENTS, events, "conversion", Resample(DAY, SUM)), f"WITH {_PAIR.format('day')} {_RATIO}")
add("ratio_min_denominator", report(EVENTS, events, "conversion", Resample(WEEK, SUM), minimum_denominator=100.0), f"WITH {_PAIR.format('week')} {_RATIO} AND d >= 100")
add("ratio_dims", report(LINES, lines, "unit-price", Resample(MONTH, SUM), GroupBy(SUM, ("flag",)), dimensions=("flag",)),
    "SELECT l_returnflag AS flag, date_trunc('month', l_shipdate)::TIMESTAMP AS bucket, round(sum(l_extendedprice) / sum(l_quantity), 7) AS value FROM lineitem GROUP BY 1, 2")
add("ratio_total_top", report(LINES, lines, "unit-price", Total(SUM, ("supplier",)), Top(5), timeless=True),
    "SELECT l_suppkey AS supplier, round(sum(l_extendedprice) / sum(l_quantity), 7) AS value FROM lineitem GROUP BY 1 ORDER BY sum(l_extendedprice) / sum(l_quantity) DESC, 1 LIMIT 5")
add("ratio_rolling", report(EVENTS, events, "conversion", Resample(DAY, SUM, ZERO), Rolling(dt.timedelta(days=7), MEAN)), """
WITH m AS (SELECT user_id AS account, event_type AS k, date_trunc('day', ts)::TIMESTAMP AS bucket, sum(value) AS v FROM events WHERE event_type IN ('purchase', 'view') GROUP BY 1, 2, 3),
s AS (SELECT account, k, unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 DAY)) AS bucket FROM m GROUP BY 1, 2),
f AS (SELECT s.account, s.k, s.bucket, coalesce(v, 0) AS v FROM s LEFT JOIN m ON m.account = s.account AND m.k = s.k AND m.bucket = s.bucket),
r AS (SELECT account, k, bucket, sum(v) OVER (PARTITION BY account, k ORDER BY bucket RANGE BETWEEN INTERVAL '6 days 23:59:59.999999' PRECEDING AND CURRENT ROW) AS v FROM f)
SELECT d.account, d.bucket, round(coalesce(n.v, 0) / d.v * 100, 7) AS value FROM r d LEFT JOIN r n ON n.account = d.account AND n.bucket = d.bucket AND n.k = 'purchase' WHERE d.k = 'view' AND d.v <> 0""")
add("ratio_cumulative", report(ORDERS, orders, "average", _MONTHLY, GroupBy(SUM, ("priority",)), Cumulative(MEAN), dimensions=("priority",)), """
WITH m AS (SELECT o_orderpriority AS priority, date_trunc('month', o_orderdate)::TIMESTAMP AS bucket, sum(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT priority, bucket, round(sum(v) OVER w / sum(n) OVER w, 7) AS value FROM m WINDOW w AS (PARTITION BY priority ORDER BY bucket ROWS UNBOUNDED PRECEDING)""")
_TERMS_SQL = """SELECT user_id AS account, date_trunc('week', ts)::TIMESTAMP AS bucket, round(sum(CASE event_type {0} END), 7) AS value
FROM events WHERE event_type IN ({1}) GROUP BY 1, 2 {2}"""
_WEEKLY = Resample(WEEK, MEAN)
_NET = ("WHEN 'purchase' THEN value WHEN 'error' THEN -value", "'purchase', 'error'")
add("linear_sum", report(EVENTS, events, "activity", _WEEKLY), _TERMS_SQL.format("WHEN 'purchase' THEN value WHEN 'click' THEN value", "'purchase', 'click'", ""))
add("linear_difference_zero", report(EVENTS, events, "net", _WEEKLY), _TERMS_SQL.format(*_NET, ""))
add("linear_difference_novalue", report(EVENTS, events, "net-strict", _WEEKLY), _TERMS_SQL.format(*_NET, "HAVING count(DISTINCT event_type) = 2"))
add("linear_weighted", report(EVENTS, events, "weighted", _WEEKLY), _TERMS_SQL.format("WHEN 'purchase' THEN 3 * value WHEN 'view' THEN 0.5 * value WHEN 'error' THEN -2 * value", "'purchase', 'view', 'error'", ""))
add("linear_top", report(EVENTS, events, "activity", Total(SUM, ("account",)), Top(10), timeless=True),
    "SELECT user_id AS account, round(sum(value), 7) AS value FROM events WHERE event_type IN ('purchase', 'click') GROUP BY 1 ORDER BY sum(value) DESC, 1 LIMIT 10")
LEVELS = Catalog([Metric("total", dimensions=_ORDER_DIMS, time_kind=LOCAL, additivity=SEMI_ADDITIVE)])
_TENTHS = "o_custkey % 10"


def tenths(spark, sf):
    return orders(spark, sf, entity=_TENTHS)


add("semi_additive_month_last", report(LEVELS, tenths, "total", Resample(MONTH, LAST)), """
WITH s AS (SELECT o_custkey % 10 AS customer, o_orderdate AS t, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT customer, date_trunc('month', t)::TIMESTAMP AS bucket, round(arg_max(v, t), 7) AS value FROM s GROUP BY 1, 2""")
add("semi_additive_by_status", report(LEVELS, tenths, "total", Resample(MONTH, MAX), dimensions=("status",)), """
WITH s AS (SELECT o_custkey % 10 AS customer, o_orderstatus AS status, o_orderdate AS t, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3)
SELECT customer, status, date_trunc('month', t)::TIMESTAMP AS bucket, round(max(v), 7) AS value FROM s GROUP BY 1, 2, 3""")

# Comparisons

_TWO_YEARS = frame_of("1997-01-01", "1999-01-01")


def _compared(unit: str, back: int, output: str, period=MONTH, **options) -> Query:
    return report(ORDERS, tenths, "total", Resample(period, SUM), timeframe=_TWO_YEARS, comparison=Comparison(Baseline(back, unit), output), **options)


def _pair(shift: str, bucket: str) -> str:
    part = f"(SELECT o_custkey % 10 AS customer, {bucket} AS bucket, sum(o_totalprice) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'{{0}} AND o_orderdate < TIMESTAMP '1999-01-01'{{0}} GROUP BY 1, 2)"
    return f"{part.format('')} c JOIN (SELECT customer, bucket + INTERVAL {shift} AS bucket, v AS b FROM {part.format(f' - INTERVAL {shift}')}) p USING (customer, bucket)"


_MONTH_SQL, _WEEK_SQL = "date_trunc('month', o_orderdate)::TIMESTAMP", "date_trunc('week', o_orderdate)::TIMESTAMP"
add("earlier_year_month", _compared("year", 1, BASELINE, digits=2), """
SELECT o_custkey % 10 AS customer, date_trunc('month', o_orderdate)::TIMESTAMP + INTERVAL 12 MONTH AS bucket, round(sum(o_totalprice), 2) AS value
FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1998-01-01' GROUP BY 1, 2""")
add("change_diff_year_month", _compared("year", 1, DIFFERENCE, digits=2), f"SELECT customer, bucket, round(v - b, 2) AS value FROM {_pair('12 MONTH', _MONTH_SQL)}")
add("change_pct_season", _compared("season", 1, PERCENT, SEASON), f"SELECT customer, bucket, round((v - b) / b * 100, 7) AS value FROM {_pair('12 MONTH', _SEASON.format('o_orderdate'))} WHERE b <> 0")
add("change_diff_season_listed",
    report(ORDERS, tenths, "total", Resample(DAY, SUM), calendar=_LISTED, timeframe=frame_of("1997-03-14", "1997-11-01"), comparison=Comparison(Baseline(1, "season"), DIFFERENCE), digits=2), """
WITH t AS (SELECT o_custkey % 10 AS customer, date_trunc('day', o_orderdate)::TIMESTAMP AS bucket, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT c.customer, c.bucket, round(c.v - p.v, 2) AS value FROM t c JOIN t p ON p.customer = c.customer AND p.bucket + INTERVAL 379 DAY = c.bucket
WHERE c.bucket >= '1997-03-14' AND c.bucket < '1997-11-01'""")  # fmt: skip
add("change_week_52", _compared("week", 52, PERCENT, WEEK), f"SELECT customer, bucket, round((v - b) / b * 100, 7) AS value FROM {_pair('364 DAY', _WEEK_SQL)} WHERE b <> 0")
add("change_pct_month", _compared("month", 3, PERCENT), f"SELECT customer, bucket, round((v - b) / b * 100, 7) AS value FROM {_pair('3 MONTH', _MONTH_SQL)} WHERE b <> 0")


def _parts(spark, sf) -> tuple[PointFrame, PointFrame]:
    engine = Engine(ORDERS, tenths(spark, sf))
    return tuple(engine.frame(Report(m, transforms=(_MONTHLY,))) for m in ("total", "orders"))


_MONTHS_SQL = "(SELECT o_custkey % 10 AS customer, date_trunc('month', o_orderdate)::TIMESTAMP AS bucket, sum(o_totalprice) AS v, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2)"


@query("binary_combine_time", f"SELECT customer, bucket, round(v / n, 7) AS value FROM {_MONTHS_SQL}")
def binary_combine_time(spark, sf):
    total, count = _parts(spark, sf)
    return table(combine(total, count, lambda a, b: a / b))


@query("binary_combine_key", f"SELECT c.customer, round(c.v - l.n, 7) AS value FROM {_MONTHS_SQL} c JOIN (SELECT customer, arg_max(n, bucket) AS n FROM {_MONTHS_SQL} GROUP BY 1) l USING (customer)")
def binary_combine_key(spark, sf):
    total, count = _parts(spark, sf)
    return table(combine(total, count, lambda a, b: a - b, match_time=False), timeless=True)


@query("compare_pct", """
WITH y AS (SELECT o_custkey % 10 AS customer, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY 1, 2)
SELECT customer, round((b.v - a.v) / a.v * 100, 7) AS value FROM y a JOIN y b USING (customer) WHERE a.y = 1996 AND b.y = 1997""")
def compare_pct(spark, sf):
    engine = Engine(ORDERS, tenths(spark, sf))
    a, b = (engine.frame(Report("total", frame_of(f"{y}-01-01", f"{y + 1}-01-01"), transforms=(Total(SUM, ("customer",)),))) for y in (1996, 1997))
    return table(compare(a, b, percent=True), timeless=True)


@query("merge_tag_union", """
SELECT 'orders' AS source, o_custkey AS entity, '' AS note, date_trunc('month', o_orderdate)::TIMESTAMP AS bucket, count(*)::DOUBLE AS value FROM orders GROUP BY ALL
UNION ALL SELECT 'lines', l_suppkey, NULL, date_trunc('month', l_shipdate)::TIMESTAMP, count(*)::DOUBLE FROM lineitem GROUP BY ALL""")
def merge_tag_union(spark, sf):
    o = Engine(ORDERS, orders(spark, sf)).frame(Report("total", transforms=(Resample(MONTH, COUNT),)))
    n = Engine(LINES, lines(spark, sf)).frame(Report("price", transforms=(Resample(MONTH, COUNT),)))
    o = run(o, [Rekey(lambda p: {"entity": p["customer"], "note": F.lit("")}, "entity"), Tag("source", "orders")])
    n = run(n, [Rekey(lambda p: {"entity": p["supplier"]}, "entity"), Tag("source", "lines")])
    return table(merge(o, n))


# Forecasts of monthly totals, five series

_FIFTHS = """m AS (SELECT o_custkey % 5 AS customer, date_trunc('month', o_orderdate)::TIMESTAMP AS bucket, sum(o_totalprice) / 1000 AS v FROM orders GROUP BY 1, 2),
s1 AS (SELECT customer, unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 MONTH)) AS bucket FROM m GROUP BY 1),
s2 AS (SELECT s1.customer, s1.bucket, v, row_number() OVER (PARTITION BY s1.customer ORDER BY s1.bucket) - 1 AS i FROM s1 LEFT JOIN m ON m.customer = s1.customer AND m.bucket = s1.bucket),
s3 AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER p AS i0,
  first_value(v IGNORE NULLS) OVER q AS v1, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER q AS i1 FROM s2
  WINDOW p AS (PARTITION BY customer ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY customer ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
a AS (SELECT customer, bucket, coalesce(v, v0 + (v1 - v0) * (i - i0) / (i1 - i0)) AS v, i, count(*) OVER (PARTITION BY customer) AS n FROM s3),
l AS (SELECT max(bucket) AS last FROM m), k AS (SELECT customer, n, datediff('month', max(bucket), any_value(last)) AS g FROM a, l GROUP BY 1, 2),
f AS (SELECT customer, n, g + h AS h, (last + to_months(h::INTEGER))::TIMESTAMP AS bucket FROM k, l, range(1, {0}) r(h))"""
_PAST = "SELECT customer, bucket, round(v, 5) AS value, false AS estimated FROM m UNION ALL "


def _forecast(model, horizon=Horizon(6), **options) -> Query:
    thousand = Map(lambda p: p.value / 1000, "thousand")
    return report(ORDERS, lambda s, d: orders(s, d, entity="o_custkey % 5"), "total", _MONTHLY, thousand, Forecast(model, horizon, **options), digits=5)


_SIX = _FIFTHS.format(7)
add("forecast_mean", _forecast(MeanModel()), f"WITH {_SIX} {_PAST} SELECT customer, f.bucket, round((SELECT avg(v) FROM a WHERE a.customer = f.customer), 5), true FROM f")
add("forecast_trend", _forecast(TrendModel()), f"""WITH {_SIX}, t AS (SELECT customer, regr_slope(v, i) AS s, regr_intercept(v, i) AS c FROM a GROUP BY 1)
{_PAST} SELECT customer, f.bucket, round(c + s * (n - 1 + h), 5), true FROM f JOIN t USING (customer)""")
add("forecast_seasonal_naive", _forecast(SeasonalNaiveModel(4)), f"WITH {_SIX} {_PAST} SELECT f.customer, f.bucket, round(a.v, 5), true FROM f JOIN a ON a.customer = f.customer AND a.i = f.n - 4 + (f.h - 1) % 4")
add("forecast_season_end", _forecast(MeanModel(), SEASON_END), f"""WITH {_FIFTHS.format(12)}
{_PAST} SELECT customer, f.bucket, round((SELECT avg(v) FROM a WHERE a.customer = f.customer), 5), true FROM f, l WHERE f.bucket < {_SEASON.format('last')} + INTERVAL 1 YEAR""")
add("forecast_running_total", _forecast(MeanModel(), running_total=True), f"""WITH {_SIX}
SELECT customer, bucket, round(sum(v) OVER (PARTITION BY customer ORDER BY bucket ROWS UNBOUNDED PRECEDING), 5) AS value, false AS estimated FROM m
UNION ALL SELECT customer, f.bucket, round(((SELECT sum(v) FROM m WHERE m.customer = f.customer) + h * (SELECT avg(v) FROM a WHERE a.customer = f.customer)), 5), true FROM f""")
#: 90 % quantiles of Student's t with 58 to 83 degrees of freedom, and the 95 % quantile of the normal distribution.
_T90 = (
    1.2963188904044247, 1.2960657251220455, 1.295821093515725, 1.2955845712751812, 1.2953557617605722, 1.2951342937829167, 1.2949198195951714, 1.2947120130706615, 1.2945105680482998,
    1.294315196828013, 1.2941256287999505, 1.2939416091940115, 1.2937628979376763, 1.293589268611218, 1.2934205074909793, 1.293256412671481, 1.2930967932600241, 1.2929414686356608,
    1.2927902677678853, 1.292643028587925, 1.2924995974099271, 1.2923598283954183, 1.2922235830591267, 1.2920907298110995, 1.2919611435326686, 1.291834705184281,
)
_Q95 = 1.6448536269514715


def _t90(parameters: int) -> str:
    """The quantile for n observations and so many fitted parameters."""
    return "CASE n " + " ".join(f"WHEN {58 + i + parameters} THEN {t!r}" for i, t in enumerate(_T90)) + " END"


_T80 = _t90(1)
add("forecast_mean_range80", _forecast(MeanModel(), range=80), f"""WITH {_SIX}, s AS (SELECT customer, avg(v) AS mean, stddev_samp(v) AS sd FROM a GROUP BY 1)
SELECT customer, bucket, round(v, 5) AS value, false AS estimated, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM m UNION ALL
SELECT customer, bucket, round(mean, 5), true, round(mean - {_T80} * sd * sqrt(1 + 1.0 / n), 5), round(mean + {_T80} * sd * sqrt(1 + 1.0 / n), 5) FROM f JOIN s USING (customer)""")
_GRID = "q AS (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS x)"
add("forecast_holt", _forecast(HoltWintersModel()), f"""WITH RECURSIVE {_SIX}, {_GRID},
r(customer, al, be, i, lev, tr, sse) AS (
  SELECT y0.customer, p.x::DOUBLE, b.x::DOUBLE, 0::BIGINT, y0.v, y1.v - y0.v, 0.0::DOUBLE FROM a y0 JOIN a y1 ON y1.customer = y0.customer AND y0.i = 0 AND y1.i = 1, q p, q b
  UNION ALL
  SELECT r.customer, al, be, y.i, al * y.v + (1 - al) * (lev + tr), be * (al * y.v + (1 - al) * (lev + tr) - lev) + (1 - be) * tr, sse + (y.v - lev - tr) * (y.v - lev - tr)
  FROM r JOIN a y ON y.customer = r.customer AND y.i = r.i + 1),
w AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.customer ORDER BY sse, al, be) AS nth FROM r JOIN k ON k.customer = r.customer AND r.i = k.n - 1) WHERE nth = 1)
{_PAST} SELECT f.customer, f.bucket, round(lev + h * tr, 5), true FROM f JOIN w USING (customer)""")
add("forecast_holt_winters", _forecast(HoltWintersModel(12), range=90), f"""WITH RECURSIVE {_SIX}, {_GRID},
z AS (SELECT customer, avg(v) FILTER (i < 12) AS m1, (avg(v) FILTER (i BETWEEN 12 AND 23) - avg(v) FILTER (i < 12)) / 12 AS slope FROM a GROUP BY 1),
e AS (SELECT a.customer, any_value(m1) AS m1, any_value(slope) AS slope, list(v - (m1 + slope * (i - 5.5)) ORDER BY i) AS s FROM a JOIN z USING (customer) WHERE i < 12 GROUP BY 1),
r(customer, al, be, ga, i, lev, tr, s, sse) AS (
  SELECT customer, p.x::DOUBLE, b.x::DOUBLE, c.x::DOUBLE, 11::BIGINT, m1 + slope * 5.5, slope, s, 0.0::DOUBLE FROM e, q p, q b, q c
  UNION ALL
  SELECT customer, al, be, ga, i, nl, be * (nl - lev) + (1 - be) * tr, s[1:i % 12] || [ga * (v - nl) + (1 - ga) * o] || s[i % 12 + 2:12], sse + (v - lev - tr - o) * (v - lev - tr - o)
  FROM (SELECT r.customer, al, be, ga, y.i, y.v, lev, tr, s, sse, s[y.i % 12 + 1] AS o, al * (y.v - s[y.i % 12 + 1]) + (1 - al) * (lev + tr) AS nl FROM r JOIN a y ON y.customer = r.customer AND y.i = r.i + 1)),
w AS (SELECT * FROM (SELECT r.*, n, row_number() OVER (PARTITION BY r.customer ORDER BY sse, al, be, ga) AS nth FROM r JOIN k ON k.customer = r.customer AND r.i = k.n - 1) WHERE nth = 1),
p AS (SELECT f.customer, f.bucket, lev + h * tr + s[(w.n - 1 + h) % 12 + 1] AS v, {_Q95!r} * sqrt(sse / (w.n - 12)) * sqrt(1 + coalesce((
  SELECT sum(pow(al * (1 + j * be) + CASE WHEN j % 12 = 0 THEN ga * (1 - al) ELSE 0 END, 2)) FROM range(1, h) t(j)), 0)) AS half FROM f JOIN w USING (customer))
SELECT customer, bucket, round(v, 5) AS value, false AS estimated, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM m UNION ALL
SELECT customer, bucket, round(v, 5), true, round(v - half, 5), round(v + half, 5) FROM p""")
_T80_CHANGES = _t90(12)
add("forecast_seasonal_range", _forecast(SeasonalNaiveModel(12), range=80, running_total=True), f"""WITH {_SIX},
c AS (SELECT x.customer, sqrt(avg(pow(x.v - y.v, 2))) AS sigma FROM a x JOIN a y ON y.customer = x.customer AND y.i = x.i - 12 GROUP BY 1),
t AS (SELECT customer, sum(v) AS total FROM m GROUP BY 1),
p AS (SELECT f.customer, f.bucket, n, total + (SELECT sum(a.v) FROM a, range(1, f.h + 1) r(j) WHERE a.customer = f.customer AND a.i = f.n - 12 + (j - 1) % 12) AS v,
  sigma * sqrt((SELECT sum(pow((f.h - 1 - j) // 12 + 1, 2)) FROM range(0, f.h) r(j))) AS spread FROM f JOIN c USING (customer) JOIN t USING (customer))
SELECT customer, bucket, round(sum(v) OVER (PARTITION BY customer ORDER BY bucket ROWS UNBOUNDED PRECEDING), 5) AS value, false AS estimated, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM m
UNION ALL SELECT customer, bucket, round(v, 5), true, round(v - {_T80_CHANGES} * spread, 5), round(v + {_T80_CHANGES} * spread, 5) FROM p""")

# Views

_BAND = TargetBand(20, 60, 15)
_VIEW = View("line", series_by="account", status=_BAND)
_STATUS = "CASE WHEN v BETWEEN 20 AND 60 THEN 'good' WHEN v BETWEEN 5 AND 75 THEN 'watch' ELSE 'bad' END"
_WEEK_MEANS = "(SELECT user_id % 20 AS account, date_trunc('week', ts)::TIMESTAMP AS bucket, avg(value) AS v FROM events GROUP BY 1, 2)"


def _marks(spark, sf):
    return marks_frame(Engine(EVENTS, crowd(spark, sf)).frame(Report("any", transforms=(_WEEKLY,))), _VIEW)


@query("marks_frame", f"SELECT account::VARCHAR AS series, strftime(bucket, '%Y-%m-%d') AS label, epoch_ms(bucket) AS at_millis, round(v, 7) AS value FROM {_WEEK_MEANS}")
def marks(spark, sf):
    return _marks(spark, sf).select("series", "label", "at_millis", F.round(VALUE, 7).alias("value"))


@query("status_band", f"SELECT {_STATUS} AS status, count(*) AS n FROM {_WEEK_MEANS} GROUP BY 1")
def status_band(spark, sf):
    return _marks(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_STEPS = Steps((30.0, 50.0, 70.0), ("bad", "watch", "good", "watch"))


@query("status_steps", f"SELECT CASE WHEN v < 30 THEN 'bad' WHEN v < 50 THEN 'watch' WHEN v < 70 THEN 'good' ELSE 'watch' END AS status, count(*) AS n FROM {_WEEK_MEANS} GROUP BY 1")
def status_steps(spark, sf):
    frame = Engine(EVENTS, crowd(spark, sf)).frame(Report("any", transforms=(_WEEKLY,)))
    return marks_frame(frame, replace(_VIEW, status=_STEPS)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("stacked_extent", f"SELECT epoch_ms(bucket) AS at_millis, round(sum(v - 50) FILTER (v >= 50), 7) AS up, round(sum(v - 50) FILTER (v < 50), 7) AS down FROM {_WEEK_MEANS} GROUP BY 1")
def extent(spark, sf):
    shifted = _marks(spark, sf).withColumn(VALUE, F.col(VALUE) - 50)
    up, down = stacked_extent(shifted)
    return shifted.groupBy("at_millis").agg(F.round(up, 7).alias("up"), F.round(down, 7).alias("down"))


# Batches, and shapes of a standard monitoring workload


@query("batch_multi_metric_wide", """
SELECT metric, supplier, bucket, round(value, 7) AS value FROM (SELECT l_suppkey AS supplier, date_trunc('month', l_shipdate)::TIMESTAMP AS bucket,
  avg(l_quantity) AS quantity, avg(l_extendedprice) AS price, avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem GROUP BY 1, 2) UNPIVOT (value FOR metric IN (quantity, price, discount, tax))""")
def batch_wide(spark, sf):
    return table(lines(spark, sf).rolled(("quantity", "price", "discount", "tax"), None, None, (), Resample(MONTH, MEAN), Context()))


@query("batch_multi_metric_long", "SELECT event_type AS metric, user_id AS account, date_trunc('week', ts)::TIMESTAMP AS bucket, round(max(value), 7) AS value FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY 1, 2, 3")
def batch_long(spark, sf):
    return table(events(spark, sf).rolled(("view", "click", "error"), None, None, (), Resample(WEEK, MAX), Context()))


add("tsbs_single_groupby", report(EVENTS, crowd, "any", Resample(Span(60), MAX), entities=(3,), timeframe=frame_of("2024-01-10", "2024-01-11")), """
SELECT user_id % 20 AS account, date_trunc('minute', ts)::TIMESTAMP AS bucket, round(max(value), 7) AS value FROM events
WHERE user_id % 20 = 3 AND ts >= '2024-01-10' AND ts < '2024-01-11' GROUP BY 1, 2""")
_ALL4 = ("quantity", "price", "discount", "tax")


@query("tsbs_max_all_8", """
SELECT metric, supplier, bucket, round(value, 7) AS value FROM (SELECT l_suppkey AS supplier, date_trunc('day', l_shipdate)::TIMESTAMP AS bucket,
  max(l_quantity) AS quantity, max(l_extendedprice) AS price, max(l_discount) AS discount, max(l_tax) AS tax FROM lineitem
  WHERE l_suppkey BETWEEN 1 AND 8 AND l_shipdate >= '1997-01-01' AND l_shipdate < '1998-01-01' GROUP BY 1, 2) UNPIVOT (value FOR metric IN (quantity, price, discount, tax))""")
def tsbs_max_all(spark, sf):
    return table(lines(spark, sf).rolled(_ALL4, tuple(range(1, 9)), frame_of("1997-01-01", "1998-01-01"), (), Resample(DAY, MAX), Context()))


@query("tsbs_double_groupby", """
SELECT metric, supplier, bucket, round(value, 7) AS value FROM (SELECT l_suppkey AS supplier, date_trunc('day', l_shipdate)::TIMESTAMP AS bucket,
  avg(l_quantity) AS quantity, avg(l_extendedprice) AS price, avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem
  WHERE l_shipdate >= '1997-01-01' AND l_shipdate < '1998-01-01' GROUP BY 1, 2) UNPIVOT (value FOR metric IN (quantity, price, discount, tax))""")
def tsbs_double(spark, sf):
    return table(lines(spark, sf).rolled(_ALL4, None, frame_of("1997-01-01", "1998-01-01"), (), Resample(DAY, MEAN), Context()))


# A dashboard written as JSON

_RESAMPLED = {"kind": "resample", "period": "month", "aggregator": "sum"}
_SUMMED = {"kind": "groupBy", "aggregator": "sum"}
DASHBOARD = json.dumps({
    "title": "Order desk",
    "charts": [
        {"title": "Weekly orders by priority", "series": [
            {"metric": "orders", "dimensions": ["priority"], "view": {"kind": "area", "seriesBy": "priority", "stacked": True},
             "transforms": [{"kind": "resample", "period": "week", "aggregator": "sum"}, {"kind": "groupBy", "aggregator": "sum", "by": ["priority"]}]}]},
        {"title": "Revenue against half a year before, and the average order", "series": [
            {"metric": "total", "name": "change", "view": {"kind": "column"}, "compare": {"unit": "month", "back": 6, "show": "difference"}, "transforms": [_RESAMPLED, _SUMMED]},
            {"metric": "average", "name": "per order", "axis": "secondary", "transforms": [_RESAMPLED, _SUMMED]}]},
        {"title": "Best customer month so far", "series": [
            {"metric": "total", "transforms": [_RESAMPLED, {"kind": "groupBy", "aggregator": "max"}, {"kind": "cumulative", "aggregator": "max"}]}]},
        {"title": "Quiet customers", "series": [
            {"metric": "orders", "view": {"kind": "bar", "x": "customer"}, "transforms": [{"kind": "total", "aggregator": "count", "by": ["customer"]}, {"kind": "bottom", "n": 4, "aggregator": "sum"}]}]},
        {"title": "What is urgent", "series": [
            {"metric": "orders", "dimensions": ["priority"], "view": {"kind": "pie", "x": "priority"},
             "transforms": [{"kind": "total", "aggregator": "sum", "by": ["priority"]}, {"kind": "share", "by": ["priority"]}]}]},
        {"title": "Half a year ahead", "series": [{"metric": "orders", "transforms": [_RESAMPLED, _SUMMED, {"kind": "forecast", "model": "trend", "n": 6}]}]},
        {"title": "Days with a large order, pending ones apart", "series": [
            {"metric": "total", "dimensions": ["status"], "view": {"kind": "scatter", "seriesBy": "status"},
             "transforms": [{"kind": "where", "dimension": "status", "notIn": ["P"]}, {"kind": "resample", "period": "day", "aggregator": "max"},
                            {"kind": "groupBy", "aggregator": "max", "by": ["status"]}, {"kind": "range", "min": 300000}]}]},
        {"title": "A fortnight's pace", "series": [
            {"metric": "orders", "transforms": [{"kind": "resample", "period": "day", "aggregator": "sum", "gap": "zero-fill"}, _SUMMED, {"kind": "rolling", "days": 14, "aggregator": "mean"}]}]},
    ],
})


@query("dashboard_example_chart", """
WITH o AS (SELECT o_custkey % 10 AS customer, o_orderpriority AS priority, o_orderstatus AS status, o_orderdate AS t, date_trunc('month', o_orderdate)::TIMESTAMP AS m, o_totalprice AS v
  FROM orders WHERE o_orderdate >= '1996-07-01' AND o_orderdate < '1999-01-01'),
n AS (SELECT * FROM o WHERE t >= '1997-01-01'), months AS (SELECT m, sum(v) AS v, count(*) AS k FROM n GROUP BY 1), earlier AS (SELECT m + INTERVAL 6 MONTH AS m, sum(v) AS v FROM o WHERE t < '1998-07-01' GROUP BY 1),
c2 AS (SELECT m, max(v) AS v FROM (SELECT m, customer, sum(v) AS v FROM n GROUP BY 1, 2) GROUP BY 1),
c3 AS (SELECT customer, count(*) AS k, row_number() OVER (ORDER BY count(*), customer) AS i FROM n GROUP BY 1),
c4 AS (SELECT priority, count(*) AS k FROM n GROUP BY 1),
c5 AS (SELECT regr_slope(k, i) AS s, regr_intercept(k, i) AS c, max(i) AS last, max(m) AS m FROM (SELECT k, m, row_number() OVER (ORDER BY m) - 1 AS i FROM months)),
c7 AS (SELECT day, sum(k) AS k FROM (SELECT unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS day, 0 AS k FROM n GROUP BY customer UNION ALL SELECT t, 1 FROM n) GROUP BY 1)
SELECT 0 AS chart, 0 AS series, priority AS shown, date_trunc('week', t)::TIMESTAMP AS bucket, count(*)::DOUBLE AS value FROM n GROUP BY ALL
UNION ALL SELECT 1, 0, '', m, round(x.v - y.v, 2) FROM months x JOIN earlier y USING (m)
UNION ALL SELECT 1, 1, '', m, round(v / k, 2) FROM months
UNION ALL SELECT 2, 0, '', m, round(max(v) OVER (ORDER BY m ROWS UNBOUNDED PRECEDING), 2) FROM c2
UNION ALL SELECT 3, 0, customer::VARCHAR, NULL, k FROM c3 WHERE i <= 4
UNION ALL SELECT 4, 0, priority, NULL, round(100.0 * k / (SELECT count(*) FROM n), 2) FROM c4
UNION ALL SELECT 5, 0, '', m, k FROM months
UNION ALL SELECT 5, 0, '', m + to_months(h::INTEGER), round(c + s * (last + h), 2) FROM c5, range(1, 7) r(h)
UNION ALL SELECT 6, 0, status, t, round(max(v), 2) FROM n WHERE status <> 'P' GROUP BY status, t HAVING max(v) >= 300000
UNION ALL SELECT 7, 0, '', day::TIMESTAMP, round(avg(k) OVER (ORDER BY day RANGE BETWEEN INTERVAL 13 DAYS PRECEDING AND CURRENT ROW), 2) FROM c7""")
def dashboard_chart(spark, sf):
    """All charts' points; ``shown`` is the dimension that tells series or places apart."""
    engine = Engine(ORDERS, tenths(spark, sf))
    out = None
    for i, chart in enumerate(parse(DASHBOARD).build(DashboardContext(_TWO_YEARS))):
        for j, series in enumerate(chart.series):
            frame = engine.frame(series.report)
            dim = series.report.view.series_by or (series.report.view.x if series.report.view.x != "time" else None)
            shown = F.col(dim).cast("string") if dim else F.lit("")
            part = frame.df.select(F.lit(i).alias("chart"), F.lit(j).alias("series"), shown.alias("shown"), F.col(AT).alias("bucket"), (F.round(VALUE, 2) + F.lit(0.0)).alias("value"))
            out = part if out is None else out.unionByName(part)
    return out


# Rows of one time: the order column ranks them, and the value what is equal in that


def ranked_lines(spark, sf) -> WideSource:
    return WideSource(spark, load(spark, sf, "lineitem"), "l_suppkey", "l_shipdate", {}, UTC, "supplier", {"quantity": "l_quantity"}, order_column="l_orderkey * 10 + l_linenumber")


QUANTITIES = Catalog([Metric("quantity")])
_RANKED = "l AS (SELECT l_suppkey AS supplier, date_trunc('month', l_shipdate)::TIMESTAMP AS bucket, l_shipdate AS t, l_orderkey * 10 + l_linenumber AS nth, l_quantity AS v FROM lineitem)"
_FROM_TO = CustomAggregator("from-to", function=lambda v: 1000 * v.iloc[0] + v.iloc[-1])
_FROM_TO_SQL = "1000 * first_value(v) OVER w + last_value(v) OVER w"
add("agg_last_ties", report(QUANTITIES, ranked_lines, "quantity", Resample(MONTH, LAST)), f"""WITH {_RANKED}
SELECT supplier, bucket, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY supplier, bucket ORDER BY t DESC, nth DESC, v DESC) AS i FROM l) WHERE i = 1""")
add("cumulative_ties", report(QUANTITIES, ranked_lines, "quantity", Cumulative(SUM)), f"""WITH {_RANKED}
SELECT supplier, t AS bucket, sum(v) OVER (PARTITION BY supplier ORDER BY t, nth, v ROWS UNBOUNDED PRECEDING) AS value FROM l""")
add("rolling_ties", report(QUANTITIES, ranked_lines, "quantity", Rolling(dt.timedelta(days=30), SUM)), f"""WITH {_RANKED}, n AS (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY t, nth, v) AS i FROM l),
c AS (SELECT *, sum(v) OVER (PARTITION BY supplier ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto, sum(v) OVER (PARTITION BY supplier ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 30 DAYS PRECEDING) AS gone FROM n)
SELECT supplier, t AS bucket, upto - coalesce(gone, 0) AS value FROM c""")
add("agg_custom", report(QUANTITIES, ranked_lines, "quantity", Resample(MONTH, _FROM_TO)), f"""WITH {_RANKED}
SELECT DISTINCT supplier, bucket, {_FROM_TO_SQL} AS value FROM l WINDOW w AS (PARTITION BY supplier, bucket ORDER BY t, nth, v ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
add("total_custom", report(QUANTITIES, ranked_lines, "quantity", Total(_FROM_TO, ("supplier",)), timeless=True), f"""WITH {_RANKED}
SELECT DISTINCT supplier, {_FROM_TO_SQL} AS value FROM l WINDOW w AS (PARTITION BY supplier ORDER BY t, nth, v ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly means of purchases on the London clock."""
    return QUERIES["resample_week_london"](spark, sf)
