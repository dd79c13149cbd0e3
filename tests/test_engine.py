"""Sources, planning, derived metrics, comparisons, caches, charts and dashboards, end to end."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from metricloom import queries as q
from metricloom import tools
from metricloom.frame import AT, VALUE
from metricloom.functions.aggregators import LAST, MEAN, SUM
from metricloom.functions.baseline import Baseline
from metricloom.functions.chart_json import dumps, loads
from metricloom.functions.charts import Theme, formatted
from metricloom.functions.periods import DAY, HOUR, MONTH, WEEK, Span
from metricloom.operators.base import Map, Named, WhereIn, WhereValue
from metricloom.operators.forecast import Forecast, Horizon, MeanModel
from metricloom.operators.groups import GroupBy, Total
from metricloom.operators.resample import TIMEFRAME, ZERO, Resample
from metricloom.operators.windows import Rolling, ShareOf, Top
from metricloom.plans.cache import ChartCache, SliceCache, stable_hash
from metricloom.plans.catalog import SEMI_ADDITIVE, Catalog, Linear, Metric, Ratio
from metricloom.plans.dashboard import DefinitionError, parse
from metricloom.plans.engine import Engine
from metricloom.plans.spec import Chart, Comparison, DashboardContext, Report, Series, StatusRule, Steps, TargetBand, View
from metricloom.sources.points import LONGEST_LIST, LongSource, MemorySource, WideSource, in_zone, jdbc
from metricloom.streaming.tumbling import resample_stream
from metricloom.timeaxis import LOCAL, Calendar, Timeframe, skipped, transitions


def d(text):
    return dt.datetime.fromisoformat(text)


CATALOG = Catalog([
    Metric("hours", dimensions=("area",)), Metric("parcels", "Parcels", "parcels", dimensions=("area",)), Metric("returns", dimensions=("area",)),
    Metric("pace", "Parcels in 10 hours", formula=Ratio("parcels", "hours", 10.0), dimensions=("area",)),
    Metric("handled", formula=Linear((("parcels", 1.0), ("returns", 1.0)))),
    Metric("strict", formula=Linear((("parcels", 1.0), ("returns", -1.0)), need_all=True)),
])


@pytest.fixture(scope="module")
def rounds(spark):
    """Eight rounds, three days apart: courier 1 brings 24 parcels in 8 hours each time, 2 nothing in 6 hours, 4 nine parcels once in 1.5 hours a round."""
    rows = []
    for i in range(8):
        t, area = d("2025-01-06 09:00") + dt.timedelta(days=3 * i), ("East", "West", "West")[i % 3]
        rows += [("hours", 4, area, t, 1.5), ("parcels", 1, area, t, 24.0), ("hours", 2, area, t, 6.0), ("hours", 1, area, t, 8.0)]
        if i == 5:
            rows += [("returns", 2, area, t, 2.0), ("parcels", 4, area, t, 9.0)]
    return MemorySource(spark, rows, ("area",), entity="courier")


def found(frame, *columns):
    columns = columns or (*frame.keys, VALUE)
    return sorted(tuple(r[c] for c in columns) for r in frame.df.collect())


def test_ratio_of_totals_and_minimum_denominator(rounds):
    engine = Engine(CATALOG, rounds)
    report = Report("pace", transforms=(Total(MEAN, ("courier",)),))
    assert found(engine.frame(report)) == [(1, 30.0), (2, 0.0), (4, 7.5)]
    assert found(engine.frame(report.with_(minimum_denominator=48.0))) == [(1, 30.0), (2, 0.0)]
    assert found(engine.frame(report.with_(minimum_denominator=48.5))) == [(1, 30.0)]
    assert found(engine.frame(Report("pace", transforms=(Total(SUM, ("courier",)), Top(2))))) == [(1, 30.0), (4, 7.5)]


def test_ratio_without_aggregation_joins_raw_points(rounds):
    out = Engine(CATALOG, rounds).frame(Report("pace")).df
    assert out.count() == 24 and sorted(r[VALUE] for r in out.where("value > 0").collect()) == [30.0] * 8 + [60.0]


def test_linear_metrics(rounds):
    engine = Engine(CATALOG, rounds)
    assert found(engine.frame(Report("handled", transforms=(Total(MEAN, ("courier",)),)))) == [(1, 192.0), (2, 2.0), (4, 9.0)]
    assert found(engine.frame(Report("strict", transforms=(Total(SUM, ("courier",)),)))) == []


def test_inputs_from_two_sources(spark, rounds):
    apart = {m: rounds for m in ("hours", "returns")} | {"parcels": MemorySource(spark, [("parcels", 2, "East", d("2025-01-07 15:00"), 12.0)], ("area",), entity="courier")}
    assert found(Engine(CATALOG, apart).frame(Report("pace", transforms=(Total(SUM, ("courier",)),)))) == [(1, 0.0), (2, 2.5), (4, 0.0)]


def test_rolling_of_a_ratio_is_rolling_sum_over_rolling_sum(rounds):
    """Three, two, two and one rounds in four weeks; the parcels of courier 4 come in the third."""
    fortnight = Rolling(dt.timedelta(days=14), MEAN)
    out = Engine(CATALOG, rounds).frame(Report("pace", entities=(4,), transforms=(Resample(WEEK, SUM), fortnight)))
    assert [r[VALUE] for r in out.df.orderBy(AT).collect()] == pytest.approx([0, 0, 15, 0])
    filled = Engine(CATALOG, rounds).frame(Report("pace", Timeframe(d("2025-01-06"), d("2025-02-03")), (4,), (Resample(WEEK, SUM, ZERO, TIMEFRAME), fortnight)))
    assert [r[VALUE] for r in filled.df.orderBy(AT).collect()] == pytest.approx([0, 0, 15, 20])


def test_plan_errors(rounds):
    engine = Engine(CATALOG, rounds)
    for report in (
        Report("nothing"), Report("parcels", dimensions=("courier",)), Report("parcels", dimensions=("weather",)), Report("parcels", transforms=(GroupBy(SUM, ("area",)),)),
        Report("parcels", transforms=(WhereIn("area", ("East",)),)), Report("parcels", minimum_denominator=1.0), Report("pace", transforms=(Total(SUM, ("courier",)), ShareOf(("courier",)))),
        Report("pace", transforms=(Resample(WEEK, SUM), WhereValue(1), GroupBy(SUM))), Report("pace", transforms=(Top(1), Total(SUM))),
    ):
        with pytest.raises(ValueError):
            engine.frame(report)
    with pytest.raises(ValueError):
        Report("parcels", entities=())
    weekly = Report("parcels", Timeframe(d("2025-01-01"), d("2025-02-01")), transforms=(Resample(WEEK, SUM),), comparison=Comparison(Baseline(1, "year")))
    with pytest.raises(ValueError):
        engine.frame(weekly)
    assert engine.frame(weekly.with_(comparison=Comparison(Baseline(52, "week")))).df.count() == 0


def test_catalog_errors():
    for metrics in (
        [Metric("a"), Metric("a")], [Metric("r", formula=Ratio("a", "b"))], [Metric("a"), Metric("r", formula=Ratio("a", "a"))], [Metric("a"), Metric("b", time_kind=LOCAL), Metric("r", formula=Ratio("a", "b"))],
        [Metric("a"), Metric("b"), Metric("r", formula=Ratio("a", "b")), Metric("s", formula=Linear((("r", 1.0),)))], [Metric("a"), Metric("b"), Metric("r", formula=Ratio("a", "b"), dimensions=("x",))], [Metric("e", formula=Linear(()))],
    ):
        with pytest.raises(ValueError):
            Catalog(metrics)


def test_levels_are_summed_before_they_are_bucketed(spark):
    rows = [("open", 1, f"f{f}", f"p{p}", d("2025-01-01") + dt.timedelta(days=i), 10.0 * (f + 1) + 3 * p + i % 7) for i in range(61) for f in (0, 1) for p in (0, 1, 2)]
    source = MemorySource(spark, rows, ("family", "priority"))
    levels = Catalog([Metric("open", dimensions=("family", "priority"), additivity=SEMI_ADDITIVE)])
    out = found(Engine(levels, source).frame(Report("open", transforms=(Resample(MONTH, LAST),), dimensions=("family",))), "family", AT, VALUE)
    day = lambda n: (n % 7)
    assert out == [(f"f{f}", d(f"2025-0{m}-01"), 3 * (10.0 * (f + 1) + day(n)) + 9) for f in (0, 1) for m, n in ((1, 30), (2, 58), (3, 60))]


def test_null_dimensions_are_empty_categories(spark):
    df = spark.createDataFrame([(1, "m", 1, d("2025-01-01"), None), (1, "m", 2, d("2025-01-01"), "x"), (1, "m", None, d("2025-01-01"), "x")], "e int, metric string, v int, ts timestamp_ntz, dim string")
    source = LongSource(spark, df, "e", "ts", {"dim": "dim"}, value_column="v")
    engine = Engine(Catalog([Metric("m", dimensions=("dim",))]), source)
    assert found(engine.frame(Report("m", transforms=(WhereIn("dim", ("",)), Total(MEAN, ("dim",))), dimensions=("dim",)))) == [("", 1.0)]
    assert found(engine.frame(Report("m", transforms=(Total(MEAN),)))) == [(1.5,)]


def test_dates_decimals_and_long_entity_lists(spark):
    df = spark.sql("SELECT 7 AS e, 'm' AS metric, cast(1.25 AS decimal(10,2)) AS v, date'2025-01-02' AS day")
    source = LongSource(spark, df, "e", "day", stored=q.LOCAL_TIME, value_column="v")
    engine = Engine(Catalog([Metric("m", time_kind=LOCAL)]), source, Calendar("Pacific/Auckland"))
    many = tuple(range(LONGEST_LIST + 5))
    out = engine.frame(Report("m", Timeframe(d("2025-01-02"), d("2025-01-03")), many, (Resample(DAY, SUM),)))
    assert found(out, AT, VALUE) == [(d("2025-01-02"), 1.25)]
    with pytest.raises(ValueError):
        Engine(Catalog([Metric("m")]), source).frame(Report("m"))


def test_wall_clocks_of_a_zone(spark):
    walls = ("2025-03-30 00:30", "2025-03-30 01:30", "2025-07-01 12:00", "2025-10-26 01:30")
    df = spark.createDataFrame([(1, "m", float(i), d(w)) for i, w in enumerate(walls)], "e long, metric string, value double, ts timestamp_ntz")
    year = Timeframe(d("2025-01-01"), d("2026-01-01"))

    def read(stored, frame=year):
        return [r[AT] for r in LongSource(spark, df, "e", "ts", stored=stored).points(("m",), None, frame).df.orderBy(VALUE).collect()]

    assert read(in_zone("Europe/London")) == [d("2025-03-30 00:30"), d("2025-03-30 01:30"), d("2025-07-01 11:00"), d("2025-10-26 00:30")]
    assert read(in_zone("Europe/London", "later"))[3] == d("2025-10-26 01:30")
    for stored in (in_zone("Europe/London", "reject"), in_zone("Europe/London", "earlier", "reject")):
        with pytest.raises(ValueError):
            read(stored)
    summer = Timeframe(d("2025-06-01"), d("2025-08-01"))
    assert len(read(in_zone("Europe/London", "reject", "reject"), summer)) == 1
    assert len(transitions("Europe/London", year)) == 2
    assert spark.range(1).select(skipped(F.lit("2025-03-30 01:30").cast("timestamp_ntz"), transitions("Europe/London", year))).first()[0]


def test_wide_equals_long(spark, sf):
    wide = Engine(q.LINES, q.lines(spark, sf))
    scanned = Engine(q.LINES, q.lines(spark, sf), slices=SliceCache())  # caching reads raw points, then resamples
    for gap in ("leave-missing", ZERO):
        report = Report("unit-price", entities=(1, 2, 3), transforms=(Resample(MONTH, SUM, gap),))
        a, b = (found(e.frame(report), "supplier", AT, VALUE) for e in (wide, scanned))
        assert [x[:2] for x in a] == [x[:2] for x in b] and [x[2] for x in a] == pytest.approx([x[2] for x in b])


def test_filters_and_columns_reach_the_scan(spark, sf):
    engine = Engine(q.LINES, q.lines(spark, sf))
    report = Report("quantity", Timeframe(d("1996-01-01"), d("1997-01-01")), (1, 2), (Resample(MONTH, SUM), WhereIn("supplier", (1,))))
    plan = engine.frame(report).df._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "GreaterThanOrEqual(l_shipdate" in scan and "l_suppkey" in scan.split("PushedFilters")[1]
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in scan
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_derived_metric_is_one_scan(spark, sf):
    engine = Engine(q.EVENTS, q.events(spark, sf))
    plan = engine.frame(Report("conversion", transforms=(Resample(WEEK, SUM),))).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_caches(rounds, spark):
    slices, charts = SliceCache(), ChartCache()
    engine = Engine(CATALOG, rounds, slices=slices, charts=charts)
    report = Report("parcels", Timeframe(d("2025-01-01"), d("2026-01-01")), (1,), (Resample(WEEK, SUM),), View(series_by="courier"))
    first = engine.run(report)
    assert engine.run(report) is first and slices.loads == 1
    both = engine.run(report.with_(entities=(1, 4)))
    assert slices.loads == 2 and len(both["series"]) == 2
    engine.invalidate(metric="parcels", entity=4)
    assert engine.run(report) is first
    engine.run(report.with_(entities=(1, 4)))
    assert slices.loads == 3
    engine.invalidate(metric="hours")
    assert engine.run(report) is first
    engine.invalidate()
    assert engine.run(report) is not first and slices.loads == 4
    unnamed = report.with_(transforms=(Resample(WEEK, SUM), Map(lambda p: p.value)))
    assert charts.key(unnamed, engine.calendar) is None
    assert charts.key(report.with_(transforms=(Named("x", Map(lambda p: p.value)),)), engine.calendar) is not None
    small = ChartCache(3)
    small.put(("a",), first, ("default", ("parcels",), None))
    assert small.get(("a",)) is None
    assert stable_hash("") == 14695981039346656037 and stable_hash("a") != stable_hash("b")
    slices.clear()


def test_run_many_equals_one_by_one(rounds):
    engine = Engine(CATALOG, rounds)
    frame = Timeframe(d("2025-01-01"), d("2026-01-01"))
    reports = [Report("parcels", frame, None, (Total(SUM, ("courier",)),), View("column", x="courier")), Report("parcels", frame, None, (Resample(WEEK, SUM), GroupBy(SUM))), Report("pace", frame, None, (Total(SUM, ("courier",)),), View("bar", x="courier"))]
    before = rounds.fetches
    together = engine.run_many(reports)
    assert rounds.fetches - before == 2
    assert together == [engine.run(r) for r in reports]


def test_chart_projection(rounds):
    engine = Engine(CATALOG, rounds)
    chart = engine.run(Report("parcels", transforms=(Resample(WEEK, SUM),), view=View("column", series_by="courier", status=TargetBand(40, 50, 10), stacked=True)))
    one = chart["series"][0]
    assert (one["name"], [m["label"] for m in one["marks"]]) == ("1", ["2025-01-06", "2025-01-13", "2025-01-20", "2025-01-27"])
    assert one["marks"][0]["at"] == 1736121600000 and [m["status"] for m in one["marks"]] == ["bad", "good", "good", "bad"]
    assert chart["axes"][1] == {"kind": "linear", "unit": "parcels", "min": 0.0, "max": 72.0}
    again = loads(dumps(chart))
    assert again["series"][0]["marks"][0]["value"] == 72 and "low" not in again["series"][0]["marks"][0] and again["stacked"] is True
    share = engine.run(Report("parcels", transforms=(Total(SUM, ("courier",)), ShareOf(("courier",))), view=View("pie", x="courier")))
    assert share["axes"][1]["unit"] == "%" and [m["label"] for m in share["series"][0]["marks"]] == ["1", "4"]
    assert TargetBand(1, 2).status(None) == "neutral" and formatted(1.5, "%") == "1.5%" and formatted(-0.0001) == "0" and formatted(None) == "–"


def test_forecast_marks_carry_ranges(rounds):
    chart = Engine(CATALOG, rounds).run(Report("parcels", entities=(1,), transforms=(Resample(WEEK, MEAN), Forecast(MeanModel(), Horizon(2), 90))))
    marks = chart["series"][0]["marks"]
    assert [m["estimated"] for m in marks] == [None] * 4 + [True] * 2 and all(m["low"] == m["high"] == 24.0 for m in marks[4:])


def test_composed_charts(rounds):
    engine = Engine(CATALOG, rounds)
    weekly = (Resample(WEEK, SUM), GroupBy(SUM))
    by_courier = Report("parcels", transforms=(Resample(WEEK, SUM),), view=View(series_by="courier"))
    chart = engine.run_chart(Chart((Series(by_courier), Series(Report("pace", transforms=weekly), secondary=True, color="black"), Series(Report("parcels", transforms=weekly), "all")), "Rounds"))
    assert [s["name"] for s in chart["series"]] == ["Parcels · 1", "Parcels · 4", "Parcels in 10 hours", "all"]
    assert [s["axis"] for s in chart["series"]] == ["primary", "primary", "secondary", "primary"] and chart["series"][2]["color"] == "black" and len(chart["axes"]) == 3
    with pytest.raises(ValueError):
        engine.run_chart(Chart((Series(by_courier), Series(Report("parcels", transforms=(Total(SUM, ("courier",)),), view=View(x="courier"))))))


def test_dashboard_runs_and_focuses(spark, sf):
    engine = Engine(q.ORDERS, q.tenths(spark, sf))
    context = DashboardContext(Timeframe(d("1997-01-01"), d("1999-01-01")))
    out = engine.run_dashboard(parse(q.DASHBOARD), context)
    assert out["title"] == "Order desk" and len(out["charts"]) == 8 and all(c["series"] for c in out["charts"])
    assert [s["axis"] for s in out["charts"][1]["series"]] == ["primary", "secondary"] and out["charts"][0]["stacked"] and len(out["charts"][0]["series"]) == 5
    assert sum(bool(m["estimated"]) for m in out["charts"][5]["series"][0]["marks"]) == 6 and len(out["charts"][3]["series"][0]["marks"]) == 4
    assert len(engine.run_dashboard(parse(q.DASHBOARD), context.focused(3))["charts"][3]["series"][0]["marks"]) == 1


@pytest.mark.parametrize(
    ("change", "path"),
    [
        ({"charts": []}, "charts"), ({"charts": [{"series": []}]}, "charts[0].series"), ({"charts": [{"series": [{}]}]}, "charts[0].series[0].metric"),
        ([{"kind": "nothing"}], "transforms[0].kind"), ([{"kind": "resample", "period": "eon", "aggregator": "sum"}], "transforms[0].period"), ([{"kind": "resample", "period": "day", "aggregator": "most"}], "transforms[0].aggregator"),
        ([{"kind": "total", "aggregator": "sum"}, {"kind": "where", "dimension": "x"}], "transforms[1]"), ([{"kind": "range"}], "transforms[0]"), ([{"kind": "share", "by": []}], "transforms[0].by"),
        ([{"kind": "rolling", "days": 0, "aggregator": "sum"}], "transforms[0].days"), ([{"kind": "forecast", "model": "seasonal-naive", "n": 1}], "transforms[0].season"), ([{"kind": "forecast", "model": "mean"}], "transforms[0]"),
        ([{"kind": "forecast", "model": "mean", "n": 1, "range": 100}], "transforms[0].range"), ([{"kind": "top", "n": -1, "aggregator": "sum"}], "transforms[0].n"),
    ],
)
def test_definition_errors_say_where(change, path):
    definition = {"charts": [{"series": [{"metric": "m", "transforms": change}]}]} if isinstance(change, list) else change
    with pytest.raises(DefinitionError) as error:
        parse(json.dumps(definition))
    assert error.value.path.endswith(path)


def test_tools(rounds):
    engine = Engine(CATALOG, rounds)
    assert "pace" in [m["id"] for m in tools.describe(engine)["metrics"]]
    chart = json.loads(tools.query(engine, "parcels", [1], 9999, "weekly-sum", "sparkles", now=d("2025-06-01 12:00")))
    assert chart["kind"] == "line" and len(chart["series"][0]["marks"]) == 4
    report = tools.request_to_report({"metric": "parcels", "entities": [1], "from": "2025-01-01", "to": "2025-02-01", "transform": "resample", "period": "day", "aggregator": "sum", "gap": "odd"})
    assert engine.frame(report).df.count() == 8
    assert tools.request_to_report({"metric": "parcels", "entities": [1], "from": "2025-01-01", "to": "2025-02-01"}).transforms == ()


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, d("2025-01-01") + dt.timedelta(minutes=7 * i), float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "e long, ts timestamp_ntz, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = resample_stream(stream, ["e"], "ts", "v", Span(3600), SUM)
    run = out.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    batch = LongSource(spark, df.withColumn("metric", F.lit("m")).withColumnRenamed("v", "value"), "e", "ts").points(("m",), None, None)
    expected = found(Resample(HOUR, SUM).apply(batch), "entity", AT, VALUE)
    assert sorted((r["e"], r["at"], r["value"]) for r in spark.table("hours").collect()) == expected


def test_wide_source_falls_back_for_custom_aggregates(spark):
    from metricloom.functions.aggregators import CustomAggregator

    df = spark.createDataFrame([(1, d("2025-01-01"), 1.0), (1, d("2025-01-01 05:00"), 4.0), (1, d("2025-01-03"), 2.0)], "e long, ts timestamp_ntz, v double")
    engine = Engine(Catalog([Metric("v")]), WideSource(spark, df, "e", "ts", metrics={"v": "v"}))
    spread = CustomAggregator("spread", function=lambda v: v.max() - v.min())
    assert [r[VALUE] for r in engine.frame(Report("v", transforms=(Resample(DAY, spread, ZERO),))).df.orderBy(AT).collect()] == [3, 0, 0]


def test_a_batch_of_metrics_is_one_scan(spark, sf):
    class Counted(WideSource):
        reads = 0

        def rolled(self, *args):
            Counted.reads += 1
            return super().rolled(*args)

    plain = q.lines(spark, sf)
    engine = Engine(q.LINES, Counted(spark, plain.df, "l_suppkey", "l_shipdate", plain.dimensions, entity="supplier", metrics=plain.metrics))
    monthly = (Resample(MONTH, SUM), GroupBy(SUM))
    reports = [Report(m, transforms=monthly) for m in ("quantity", "price", "tax", "unit-price")]
    together = engine.run_many(reports)
    assert Counted.reads == 1
    alone = [engine.run(r) for r in reports]
    assert Counted.reads == 5
    shown = lambda charts: [[(m["label"], pytest.approx(m["value"])) for m in c["series"][0]["marks"]] for c in charts]
    assert shown(together) == [[(m["label"], m["value"]) for m in c["series"][0]["marks"]] for c in alone]


def test_stores():
    from metricloom.plans.stores import ExpiringStore, LayeredStore, MemoryStore

    now = [0.0]
    near, far = MemoryStore(3), MemoryStore(100)
    store = LayeredStore(near, ExpiringStore(far, 10, lambda: now[0]))
    for i in range(5):
        store.put(i, f"v{i}", 1, {"odd" if i % 2 else "even"})
    assert near.get(0) is None and store.get(0) == "v0" and near.get(0) == "v0"
    store.remove_tagged("even")
    assert store.get(0) is None and store.get(3) == "v3"
    now[0] = 11.0
    near.remove(3)
    assert store.get(3) is None and near.get(99) is None
    near.put("big", 1, 4)
    assert near.get("big") is None and near.weight == len(near.entries)


def test_demo_data_recipes_and_labels(spark):
    from metricloom.plans import recipes
    from metricloom.sources import demo

    engine = Engine(demo.CATALOG, demo.source(spark, days=120, beds=6), labels=lambda dim, value: f"{dim} #{value}")
    chart = engine.run(Report("yield", transforms=(Total(SUM, ("bed",)),), view=View("column", x="bed")))
    assert [m["label"] for m in chart["series"][0]["marks"]] == [f"bed #{i}" for i in range(6)]
    ratio = recipes.acute_to_chronic(engine.frame(Report("water", transforms=(Resample(DAY, SUM, ZERO),))))
    assert ratio.df.where("value < 0 or value > 4").count() == 0 and ratio.df.count() > 650
    year = Timeframe(d("2025-01-01"), d("2026-01-01"))
    pace = engine.frame(recipes.on_pace(Report("picked", year)))
    assert pace.ranged and pace.df.where("estimated").count() > 0
    assert set(recipes.gap_policies(Report("sold", year), WEEK, SUM)) == {"leave-missing", "zero-fill", "carry-forward", "interpolate"}
    assert engine.frame(recipes.running_total(Report("picked", year))).df.count() == 4
    assert engine.frame(recipes.year_on_year(Report("spoiled", year))).df.count() == 0
    load = engine.frame(Report("water", transforms=(Resample(DAY, SUM),)))
    assert recipes.moving_target(load, load).df.where("value = 100").count() == load.df.where("value > 0").count()
    plants = engine.frame(Report("stock", transforms=(Resample(WEEK, LAST),), dimensions=("crop",)))
    assert set(plants.dims) == {"bed", "crop"} and plants.df.count() == 6 * 18


def test_function_sources(spark):
    from metricloom.sources.points import FunctionSource

    def fetch(metrics, entities, timeframe):
        return spark.createDataFrame([(m, e, None, d("2025-01-01"), 2.0) for m in metrics for e in entities], "metric string, entity int, place string, at timestamp_ntz, value double")

    engine = Engine(Catalog([Metric("heat", dimensions=("place",))]), FunctionSource(spark, fetch, ("place",)))
    assert found(engine.frame(Report("heat", entities=(1, 2), transforms=(Total(SUM, ("place",)),), dimensions=("place",)))) == [("", 4.0)]


def test_status_rules_and_themes(rounds):
    weekly = Report("parcels", entities=(1,), transforms=(Resample(WEEK, SUM),))
    plain = Engine(CATALOG, rounds).run(weekly)["series"][0]
    assert {m["color"] for m in plain["marks"]} == {plain["color"]} and {m["status"] for m in plain["marks"]} == {"neutral"}
    values = [m["value"] for m in plain["marks"]]

    class Odd(StatusRule):
        def column(self, value):
            return F.when(value % 2 == 1, "watch").otherwise("neutral")

    theme = Theme(("ink", "rust"), watch="sun")
    engine = Engine(CATALOG, rounds, theme=theme)
    odd = engine.run(weekly.with_(view=View(status=Odd())))
    assert [m["color"] for m in odd["series"][0]["marks"]] == ["sun" if v % 2 else "ink" for v in values] and odd["annotations"] == []
    steps = Steps((45.0, 60.0), ("bad", "good", "watch"))
    chart = engine.run(weekly.with_(view=View(status=steps)))
    assert [m["status"] for m in chart["series"][0]["marks"]] == ["bad" if v < 45 else "good" if v < 60 else "watch" for v in values]
    assert [(a["from"], a["to"]) for a in chart["annotations"]] == [(None, 45.0), (45.0, 60.0), (60.0, None)]
    pair = engine.run_chart(Chart((Series(weekly), Series(weekly, "again"), Series(weekly, color="chalk"))))["series"]
    assert [(s["color"], {m["color"] for m in s["marks"]}) for s in pair] == [(c, {c}) for c in ("ink", "rust", "chalk")]
    for limits, statuses in (((2.0, 1.0), ("bad", "good", "bad")), ((1.0,), ("bad",)), ((1.0,), ("bad", "fine"))):
        with pytest.raises(ValueError):
            Steps(limits, statuses)


def test_a_chart_has_a_bound(rounds):
    report = Report("parcels", entities=(1,), transforms=(Resample(WEEK, SUM),))
    assert len(Engine(CATALOG, rounds, most_marks=4).run(report)["series"][0]["marks"]) == 4
    with pytest.raises(ValueError, match="at most 3 points"):
        Engine(CATALOG, rounds, most_marks=3).run(report)


def test_requests(rounds):
    engine = Engine(CATALOG, rounds)
    entity = rounds.entity
    ask = {"metric": "parcels", "entities": [1, 4], "from": "2025-01-01", "to": "2025-02-01"}
    rows = engine.frame(tools.request_to_report(ask | {"seriesBy": entity}, entity)).df.collect()
    least = sorted(r[VALUE] for r in rows)[len(rows) // 2]
    kept = engine.frame(tools.request_to_report(ask | {"min": least}, entity)).df.collect()
    assert sorted(r[VALUE] for r in kept) == sorted(r[VALUE] for r in rows if r[VALUE] >= least) and len(kept) < len(rows)
    areas = [r[0] for r in engine.frame(Report("parcels", dimensions=("area",))).df.select("area").distinct().orderBy("area").collect()]
    grouped = engine.run(tools.request_to_report(ask | {"groupBy": "area", "aggregator": "sum"}, entity))
    assert grouped["kind"] == "column" and [m["label"] for m in grouped["series"][0]["marks"]] == areas
    one = engine.run(tools.request_to_report(ask | {"groupBy": "area", "aggregator": "sum", "where": {"area": areas[0]}}, entity))
    assert [m["value"] for m in one["series"][0]["marks"]] == [grouped["series"][0]["marks"][0]["value"]]
    whole = engine.run(tools.request_to_report(ask | {"groupBy": entity, "aggregator": "sum"}, entity))
    assert sum(m["value"] for m in whole["series"][0]["marks"]) == sum(r[VALUE] for r in rows)
    report = tools.request_to_report(ask | {"status": {"low": 10, "high": 20}, "seriesBy": entity}, entity)
    assert report.view.status == TargetBand(10.0, 20.0, 5.0) and report.dimensions == () and engine.run(report)["annotations"]
    recent = tools.request_to_report({"metric": "parcels", "entities": [1], "pastDays": 7}, entity, now=d("2025-01-20 12:00"))
    assert recent.timeframe == Timeframe(d("2025-01-13"), d("2025-01-21"))


def test_a_database_is_a_source(spark):
    """Derby comes with Spark; other databases differ in their drivers and in the statement that opens a session."""
    url, driver = "jdbc:derby:memory:depot;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = [(k % 3, d("2025-03-01") + dt.timedelta(hours=5 * k), "weight" if k % 2 else "count", float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "entity long, at timestamp_ntz, metric string, value double")
    df.write.mode("overwrite").option("createTableColumnTypes", "metric VARCHAR(20)").jdbc(url, "points", properties={"driver": driver})
    catalog, frame = Catalog([Metric("weight"), Metric("count")]), Timeframe(d("2025-03-02"), d("2025-03-08"))
    report = Report("weight", frame, (0, 2), (Resample(DAY, SUM),))
    expected = found(Engine(catalog, LongSource(spark, df, "entity", "at")).frame(report), "entity", AT, VALUE)
    for split in (None, ("entity", 0, 3, 3)):
        stored = jdbc(spark, url, "points", split, driver=driver)
        assert dict(stored.dtypes)[[c for c in stored.columns if c.lower() == "at"][0]] == "timestamp_ntz"
        assert stored.rdd.getNumPartitions() == (3 if split else 1)
        made = Engine(catalog, LongSource(spark, stored, "entity", "at")).frame(report)
        assert found(made, "entity", AT, VALUE) == expected and expected
        plan = made.df._jdf.queryExecution().executedPlan().toString()
        pushed = plan[plan.index("PushedFilters") :].split("]")[0].lower()
        assert all(c in pushed for c in ("entity", "metric", "at"))


def test_sessions_of_databases_tell_utc(spark, monkeypatch):
    from pyspark.sql import DataFrameReader

    seen = []
    monkeypatch.setattr(DataFrameReader, "options", lambda self, **o: seen.append(o) or self)
    monkeypatch.setattr(DataFrameReader, "load", lambda self: None)
    for url in ("jdbc:postgresql://h/d", "jdbc:mysql://h/d", "jdbc:sqlserver://h"):
        jdbc(spark, url, "t", ("id", 1, 9, 4), fetchsize="7")
    assert [o.get("sessionInitStatement") for o in seen] == ["SET TIME ZONE 'UTC'", "SET time_zone = '+00:00'", None]
    assert all((o["partitionColumn"], o["lowerBound"], o["upperBound"], o["numPartitions"], o["fetchsize"]) == ("id", "1", "9", "4", "7") for o in seen)
