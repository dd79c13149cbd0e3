"""Operators on small cases with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from metricloom.frame import AT, ESTIMATED, HIGH, LOW, VALUE, points
from metricloom.functions.aggregators import COUNT, FIRST, LAST, MAX, MEAN, MEDIAN, MIN, STDDEV, SUM, CustomAggregator, percentile, resolve, try_resolve
from metricloom.functions.baseline import Baseline, CalendarShift
from metricloom.functions.periods import DAY, HOUR, MONTH, SEASON, WEEK, Boundaries, Span, every, period_named
from metricloom.functions.statistics import normal_quantile, student_t_quantile
from metricloom.operators.base import Filter, Map, Named, Rekey, Tag, WhereIn, WhereNotIn, WhereValue, merge, run
from metricloom.operators.combine import combine, compare, shared_axis
from metricloom.operators.forecast import SEASON_END, Forecast, HoltWintersModel, Horizon, MeanModel, SeasonalNaiveModel, TrendModel
from metricloom.operators.groups import GroupBy, PerGroup, Reduce, Total
from metricloom.operators.resample import CARRY, INTERPOLATE, LEAVE, TIMEFRAME, ZERO, Resample
from metricloom.operators.windows import Bottom, Cumulative, Rolling, ShareOf, Top
from metricloom.timeaxis import LOCAL, Calendar, Context, Seasons, TimeAxis, Timeframe


def d(text):
    return dt.datetime.fromisoformat(text)


def monthly(spark, series, start=1, year=2025, kind=LOCAL):
    rows = [(k, dt.datetime(year + (start - 1 + i) // 12, (start - 1 + i) % 12 + 1, 1), v) for k, values in series.items() for i, v in enumerate(values)]
    return points(spark, rows, {"player": "bigint"}, "player", TimeAxis(kind, MONTH))


def daily(spark, values, start="2025-01-01"):
    rows = [(1, d(start) + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return points(spark, rows, {"player": "bigint"}, "player", TimeAxis(LOCAL, DAY))


def values(frame, *columns):
    rows = frame.df.orderBy(*frame.keys, AT).collect()
    return [r[VALUE] for r in rows] if not columns else [tuple(r[c] for c in columns) for r in rows]


def test_sparse_weeks(spark):
    f = points(spark, [(1, d("2026-08-03"), 10.0), (1, d("2026-08-17"), 30.0)], {"e": "bigint"}, "e", TimeAxis(LOCAL))
    for gap, expected in ((LEAVE, [10, 30]), (ZERO, [10, 0, 30]), (CARRY, [10, 10, 30]), (INTERPOLATE, [10, 20, 30])):
        assert values(Resample(WEEK, MEAN, gap).apply(f)) == expected


def test_missing_values_are_left_out_and_nan_is_missing(spark):
    f = points(spark, [(1, d("2026-08-03"), 10.0), (1, d("2026-08-04"), None), (1, d("2026-08-05"), 20.0), (1, d("2026-08-06"), float("nan"))], {"e": "bigint"}, "e", TimeAxis(LOCAL))
    assert values(Resample(WEEK, MEAN).apply(f)) == [15.0]
    assert values(Resample(WEEK, COUNT).apply(f)) == [2.0]


def test_fill_across_timeframe(spark):
    f = points(spark, [(1, d("2025-03-05"), 5.0), (1, d("2025-04-05"), 2.0)], {"e": "bigint"}, "e", TimeAxis(LOCAL))
    context = Context(Calendar(), Timeframe(d("2025-01-01"), d("2025-07-01")))
    assert values(Resample(MONTH, SUM, ZERO, TIMEFRAME).apply(f, context)) == [0, 0, 5, 2, 0, 0]
    assert values(Resample(MONTH, SUM, ZERO).apply(f, context)) == [5, 2]
    partial = Context(Calendar(), Timeframe(d("2025-01-15"), d("2025-06-01")))
    assert len(values(Resample(MONTH, SUM, ZERO, TIMEFRAME).apply(f, partial))) == 5
    g = points(spark, [(1, d("2025-03-05"), 5.0), (1, d("2025-05-05"), 9.0)], {"e": "bigint"}, "e", TimeAxis(LOCAL))
    assert values(Resample(MONTH, SUM, CARRY, TIMEFRAME).apply(g, context)) == [5, 5, 9, 9]
    assert values(Resample(MONTH, SUM, INTERPOLATE, TIMEFRAME).apply(g, context)) == [5, 7, 9]
    reversed_frame = Context(Calendar(), Timeframe(d("2025-07-01"), d("2025-01-01")))
    assert values(Resample(MONTH, SUM, ZERO, TIMEFRAME).apply(f, reversed_frame)) == [5, 2]


def test_repeated_hour_is_one_bucket_and_spans_follow_the_local_clock(spark):
    f = points(spark, [(1, d("2025-11-02 05:30"), 1.0), (1, d("2025-11-02 06:30"), 1.0)], {"e": "bigint"}, "e")
    out = Resample(HOUR, COUNT).apply(f, Context(Calendar("America/New_York")))
    assert values(out, AT, VALUE) == [(d("2025-11-02 01:00"), 2.0)]
    g = points(spark, [(1, d("2026-07-01 10:07:30"), 1.0)], {"e": "bigint"}, "e")
    assert values(Resample(Span(300), SUM).apply(g), AT) == [(d("2026-07-01 10:05"),)]
    assert values(Resample(HOUR, SUM).apply(g, Context(Calendar("Asia/Kolkata"))), AT) == [(d("2026-07-01 15:00"),)]


def test_rolling_is_a_half_open_duration(spark):
    assert values(Rolling(dt.timedelta(days=2), SUM).apply(daily(spark, [1.0, 2, 3, 4, 5])))[2] == 5.0
    assert values(Rolling(dt.timedelta(days=1), COUNT).apply(daily(spark, [1.0, None]))) == [1.0, None]


def test_raw_ties_see_rows_up_to_themselves(spark):
    f = points(spark, [(1, d("2025-01-01"), 1.0), (1, d("2025-01-01"), 1.0), (1, d("2025-01-02"), 1.0)], {"e": "bigint"}, "e")
    assert values(Rolling(dt.timedelta(days=2), SUM).apply(f)) == [1.0, 2.0, 3.0]
    for agg in (MEAN, MIN, MAX, FIRST, LAST, MEDIAN, percentile(90)):
        assert values(Rolling(dt.timedelta(days=2), agg).apply(f)) == [1.0, 1.0, 1.0]
    assert values(Rolling(dt.timedelta(days=2), STDDEV).apply(f)) == [None, 0.0, 0.0]


def test_acute_to_chronic(spark):
    f = daily(spark, [100.0] * 28 + [140.0] * 7)
    acute, chronic = (Rolling(dt.timedelta(days=n), MEAN).apply(f) for n in (7, 28))
    out = values(combine(acute, chronic, lambda a, b: a / b))
    assert out[19] == 1.0 and out[34] == pytest.approx(140 / 110)


def test_cumulative(spark):
    f = daily(spark, [2.0, 1, None, 4])
    assert values(Cumulative(SUM).apply(f)) == [2, 3, 3, 7]
    g = daily(spark, [5.0, 3, 9, 1])
    for agg, expected in ((MAX, [5, 5, 9, 9]), (MIN, [5, 3, 3, 1]), (MEAN, [5, 4, 17 / 3, 4.5]), (COUNT, [1, 2, 3, 4]), (MEDIAN, [5, 4, 5, 4]), (FIRST, [5] * 4), (LAST, [5, 3, 9, 1])):
        assert values(Cumulative(agg).apply(g)) == pytest.approx(expected)
    assert values(Cumulative(COUNT).apply(daily(spark, [None, 2.0]))) == [None, 1.0]


def venue_frame(spark):
    rows = [(1, "Home", d("2025-01-01"), 3.0), (1, "Away", d("2025-01-01"), 1.0), (2, "Home", d("2025-01-01"), 2.0), (1, "Home", d("2025-01-08"), 5.0)]
    return points(spark, rows, {"player": "bigint", "venue": "string"}, "player", TimeAxis(LOCAL, WEEK))


def test_shares(spark):
    out = ShareOf(("venue",)).apply(venue_frame(spark))
    found = {(r["player"], r["venue"], r[AT].day): r[VALUE] for r in out.df.collect()}
    assert found == {(1, "Home", 1): 75, (1, "Away", 1): 25, (2, "Home", 1): 100, (1, "Home", 8): 100} and out.unit == "%"
    zero = points(spark, [(1, "Home", None, 0.0), (1, "Away", None, None)], {"player": "bigint", "venue": "string"}, "player")
    assert values(ShareOf(("venue",)).apply(zero)) == [None, None]


def test_groups_totals_and_empty_totals(spark):
    f = venue_frame(spark)
    assert values(GroupBy(SUM).apply(f)) == [6, 5]
    assert values(GroupBy(SUM, ("venue",)).apply(f)) == [1, 5, 5]
    assert values(Total(SUM, ("player",)).apply(f)) == [9, 2]
    empty = Filter(lambda p: F.lit(False)).apply(f)
    assert Total(SUM).apply(empty).df.count() == 0
    missing = points(spark, [(1, d("2025-01-01"), None)], {"e": "bigint"}, "e")
    assert values(GroupBy(COUNT).apply(missing)) == [None]


def test_ranks(spark):
    f = points(spark, [(i, None, v) for i, v in enumerate([5.0, 9, 7, 9, 1], 1)], {"player": "bigint"}, "player")
    keys = lambda t: sorted(r["player"] for r in t.apply(f).df.collect())
    assert keys(Top(2)) == [2, 4] and keys(Bottom(2)) == [1, 5] and keys(Top(1)) == [2] and keys(Top(3, STDDEV)) == []


def test_filters_and_mappings(spark):
    f = venue_frame(spark)
    assert WhereIn("player", ("1",)).apply(f).df.count() == 3
    assert WhereIn("player", ("01",)).apply(f).df.count() == 0
    assert WhereNotIn("venue", ("Home",)).apply(f).df.count() == 1
    assert WhereNotIn("nowhere", ("Home",)).apply(f).df.count() == 4
    assert WhereValue(2, 3).apply(f).df.count() == 2
    assert sorted(values(Map(lambda p: p.value * 2).apply(f))) == [2, 4, 6, 10]
    out = Rekey(lambda p: {"where": F.upper(p["venue"])}).apply(f)
    assert out.dims == ("where",) and out.df.count() == 4
    assert Named("twice", Map(lambda p: p.value * 2)).identity == "twice" and Map(lambda p: p.value).identity is None
    assert Named("g", GroupBy(SUM)).aggregates


def test_absent_dimensions_survive_not_in(spark):
    a, b = venue_frame(spark), Rekey(lambda p: {"player": p["player"]}).apply(venue_frame(spark))
    both = merge(Tag("side", "a").apply(a), Tag("side", "b").apply(b))
    assert WhereNotIn("venue", ("Home", "Away")).apply(both).df.count() == 4
    assert WhereIn("venue", ("Home",)).apply(both).df.count() == 3


def test_reduce_and_per_group(spark):
    f = venue_frame(spark)
    assert sorted(values(Reduce(lambda p: {"day": F.dayofmonth(p.at)}, SUM).apply(f))) == [5, 6]
    out = PerGroup(lambda p: {"v": p["venue"]}, Top(1)).apply(Total(SUM, ("player", "venue")).apply(f))
    assert out.dims == ("player", "venue") and sorted(values(out)) == [1, 8]


def test_combine_matches_and_takes_the_last_of_duplicates(spark):
    left = points(spark, [(1, d("2025-01-01"), 10.0), (2, d("2025-01-01"), None)], {"e": "bigint"}, "e")
    right = points(spark, [(1, d("2025-01-01"), 2.0), (1, d("2025-01-02"), 5.0), (2, d("2025-01-01"), 1.0)], {"e": "bigint"}, "e")
    assert values(combine(left, right, lambda a, b: a / b)) == [5.0]
    assert values(combine(left, right, lambda a, b: a / b, match_time=False)) == [2.0]
    assert values(compare(points(spark, [(1, None, 100.0)], {"e": "bigint"}), points(spark, [(1, None, 130.0)], {"e": "bigint"}), percent=True)) == [pytest.approx(30.0)]
    with pytest.raises(ValueError):
        shared_axis(left, points(spark, [], {"e": "bigint"}, "e", TimeAxis(LOCAL)))


def test_forecast_models(spark):
    for model, series, n, expected in (
        (MeanModel(), [2.0, 4, 3], 2, [3, 3]), (TrendModel(), [1.0, 3, 5, 7], 2, [9, 11]), (SeasonalNaiveModel(3), [99.0, 10, 20, 30], 4, [10, 20, 30, 10]),
        (HoltWintersModel(), [2.0, 4, 6, 8, 10], 2, [12, 14]),
    ):
        out = Forecast(model, Horizon(n)).apply(monthly(spark, {1: series}))
        rows = values(out, VALUE, ESTIMATED)
        assert [v for v, e in rows if e] == pytest.approx(expected) and len(rows) == len(series) + n


def test_forecasts_share_future_buckets(spark):
    out = Forecast(MeanModel(), Horizon(2)).apply(monthly(spark, {1: [1.0, 2, 3], 2: [10.0, 20]}))
    assert [(r["player"], r[AT].month, r[VALUE]) for r in out.df.where(ESTIMATED).orderBy("player", AT).collect()] == [(1, 4, 2), (1, 5, 2), (2, 4, 15), (2, 5, 15)]
    naive = Forecast(SeasonalNaiveModel(2), Horizon(1)).apply(monthly(spark, {1: [1.0, 2, 3], 2: [10.0, 20]}))
    assert [r[VALUE] for r in naive.df.where(ESTIMATED).orderBy("player").collect()] == [2, 20]


def test_forecast_to_the_season_end_bridges_gaps(spark):
    out = Forecast(TrendModel(), SEASON_END).apply(points(spark, [(1, d(f"2025-0{m}-01"), v) for m, v in ((1, 1.0), (2, None), (3, 3.0))], {"p": "bigint"}, "p", TimeAxis(LOCAL, MONTH)))
    assert [(r[AT].month, round(r[VALUE], 9)) for r in out.df.where(ESTIMATED).orderBy(AT).collect()] == [(4, 4), (5, 5), (6, 6)]
    short = Forecast(TrendModel(), Horizon(1)).apply(monthly(spark, {1: [1.0, 2]}))
    assert short.df.where(ESTIMATED).count() == 0


def test_ranges_are_textbook_intervals(spark):
    y = [4.0, 7, 5, 9, 6, 8]
    n, mean = 6, sum(y) / 6
    sd = (sum((v - mean) ** 2 for v in y) / (n - 1)) ** 0.5
    out = Forecast(MeanModel(), Horizon(2), 95).apply(monthly(spark, {1: y}))
    low, high = values(Filter(lambda p: F.col(ESTIMATED)).apply(out), LOW, HIGH)[0]
    half = student_t_quantile(0.975, 5) * sd * (1 + 1 / n) ** 0.5
    assert (low, high) == (pytest.approx(mean - half), pytest.approx(mean + half))
    total = Forecast(MeanModel(), Horizon(3), 95, running_total=True).apply(monthly(spark, {1: [2.0, 5, 3, 6]}))
    rows = values(total, VALUE, LOW, HIGH)
    assert [r[0] for r in rows] == [2, 7, 10, 16, 20, 24, 28]
    sd4 = (10 / 3) ** 0.5
    assert (rows[-1][2] - rows[-1][1]) / 2 == pytest.approx(student_t_quantile(0.975, 3) * sd4 * (3 + 9 / 4) ** 0.5)


def test_trend_and_seasonal_ranges(spark):
    y = [4.0, 7, 5, 9, 6, 8]
    x = [i - 2.5 for i in range(6)]
    slope = sum(a * b for a, b in zip(x, y)) / 17.5
    sd = (sum((b - 6.5 - slope * a) ** 2 for a, b in zip(x, y)) / 4) ** 0.5
    (low, high), *_ = values(Filter(lambda p: F.col(ESTIMATED)).apply(Forecast(TrendModel(), Horizon(1), 80).apply(monthly(spark, {1: y}))), LOW, HIGH)
    assert (high - low) / 2 == pytest.approx(student_t_quantile(0.9, 4) * sd * (1 + 1 / 6 + 3.5**2 / 17.5) ** 0.5)
    rows = values(Filter(lambda p: F.col(ESTIMATED)).apply(Forecast(SeasonalNaiveModel(2), Horizon(3), 80).apply(monthly(spark, {1: y}))), LOW, HIGH)
    changes = [y[i] - y[i - 2] for i in range(2, 6)]
    sigma = (sum(c * c for c in changes) / 4) ** 0.5
    assert [(h - l) / 2 / (student_t_quantile(0.9, 4) * sigma) for l, h in rows] == pytest.approx([1, 1, 2**0.5])


def test_forecasts_with_ranges_and_estimates_are_refused(spark):
    out = Forecast(MeanModel(), Horizon(1), 80).apply(monthly(spark, {1: [1.0, 2]}))
    for t in (GroupBy(SUM), Total(SUM), ShareOf(("player",)), Rolling(dt.timedelta(days=40), SUM), Cumulative(SUM), Reduce(lambda p: {}, SUM)):
        with pytest.raises(ValueError):
            t.apply(out)
    with pytest.raises(ValueError):
        Resample(MONTH, SUM).apply(out)
    assert Map(lambda p: p.value).apply(out).ranged is False and WhereValue(0).apply(out).ranged


def test_estimates_propagate(spark):
    out = Forecast(MeanModel(), Horizon(1)).apply(monthly(spark, {1: [1.0, 2], 2: [3.0, 4]}))
    assert values(GroupBy(SUM).apply(out), VALUE, ESTIMATED) == [(4, False), (6, False), (5, True)]
    assert [e for _, e in values(Cumulative(SUM).apply(out), VALUE, ESTIMATED)] == [False, False, True] * 2
    assert [e for _, e in values(Total(SUM, ("player",)).apply(out), VALUE, ESTIMATED)] == [True, True]
    short = Rolling(dt.timedelta(days=40), SUM)
    for frame in (out, GroupBy(SUM, ("player",)).apply(out)):  # by arrays, and by range frames
        assert values(short.apply(frame), VALUE, ESTIMATED) == [(1, False), (3, False), (3.5, True), (3, False), (7, False), (7.5, True)]


def test_rolling_after_a_rekey_counts_duplicates_one_by_one(spark):
    both = Rekey(lambda p: {"all": F.lit("x")}).apply(Resample(DAY, SUM).apply(points(spark, [(k, d("2025-01-01"), 1.0) for k in (1, 2, 3)], {"e": "bigint"}, "e", TimeAxis(LOCAL))))
    assert values(Rolling(dt.timedelta(days=1), SUM).apply(both)) == [1, 2, 3]


def test_quantiles():
    assert normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    for p, n, expected in ((0.975, 5, 2.570582), (0.95, 1, 6.313752), (0.9, 30, 1.310415), (0.995, 100, 2.625891)):
        assert student_t_quantile(p, n) == pytest.approx(expected, abs=1e-5)


def test_names_of_periods_and_aggregators():
    assert period_named("15m") == Span(900) and period_named("1h").name == "1h" and period_named("week") is WEEK
    assert period_named("7h") is None and period_named("fortnight") is None and period_named("0m") is None
    assert every(dt.timedelta(minutes=30)).name == "30m"
    assert resolve("P99.5").percent == 99.5 and try_resolve("p0") is None and try_resolve("p100") is None and try_resolve("Mean") is MEAN
    with pytest.raises(ValueError):
        Span(7)
    with pytest.raises(ValueError):
        Calendar(season=(2, 29))


def test_custom_aggregators_and_calendars(spark):
    spread = CustomAggregator("spread", function=lambda v: v.max() - v.min())
    f = daily(spark, [1.0, 5, None, 2])
    assert values(Resample(MONTH, spread).apply(f)) == [4.0]
    assert values(Cumulative(spread).apply(f)) == [0, 4, 4, 4]
    last = CustomAggregator("latest", function=lambda v: v.iloc[-1])
    rows = [(k % 3, d("2025-01-01") + dt.timedelta(hours=7 * (k // 6)), float(k * 37 % 101)) for k in range(120)]
    raw = points(spark, rows, {"e": "bigint"}, "e", TimeAxis(LOCAL))
    raw = raw.having(raw.df.repartition(7, "value"))
    for make in (lambda a: Resample(DAY, a), lambda a: Total(a), lambda a: Total(a, ("e",)), lambda a: GroupBy(a), lambda a: Cumulative(a), lambda a: Rolling(dt.timedelta(hours=8), a)):
        mine, known = ([tuple(r[c] for c in (*f.keys, AT, VALUE)) for r in f.df.collect()] for f in (make(last).apply(raw), make(LAST).apply(raw)))
        assert sorted(mine, key=repr) == sorted(known, key=repr) and mine


def test_ties_do_not_depend_on_partitions(spark):
    """Four rows at each time, in the source's order, and without one by value."""
    rows = [(1, d("2025-01-01") + dt.timedelta(days=k // 4), float(k * 37 % 11)) for k in range(40)]
    ordered = points(spark, rows, {"e": "bigint"}, "e", TimeAxis(LOCAL))
    bare = ordered.having(ordered.df, sequenced=False)
    totals = [sum(r[2] for r in rows[: i + 1]) for i in range(40)]
    sorted_rows = sorted(rows, key=lambda r: (r[1], r[2]))
    for parts in (1, 3, 9):
        f, g = (x.having(x.df.repartition(parts, "value")) for x in (ordered, bare))
        assert sorted(r[VALUE] for r in Cumulative(SUM).apply(f).df.collect()) == sorted(totals)
        assert values(Resample(DAY, LAST).apply(f)) == [rows[4 * i + 3][2] for i in range(10)] and values(Resample(DAY, FIRST).apply(f)) == [rows[4 * i][2] for i in range(10)]
        assert values(Resample(DAY, LAST).apply(g)) == [sorted_rows[4 * i + 3][2] for i in range(10)]
        rolled = {(r[AT], r["_sequence"]): r[VALUE] for r in Rolling(dt.timedelta(days=2), SUM).apply(f).df.collect()}
        assert all(rolled[(rows[i][1], i)] == sum(r[2] for r in rows[max(0, 4 * (i // 4 - 1)) : i + 1]) for i in range(40))
        means = {(r[AT], r["_sequence"]): r[VALUE] for r in Rolling(dt.timedelta(days=1), MEAN).apply(f).df.collect()}
        assert all(means[(rows[i][1], i)] == pytest.approx(sum(r[2] for r in rows[4 * (i // 4) : i + 1]) / (i % 4 + 1)) for i in range(40))
        firsts = {(r[AT], r["_sequence"]): r[VALUE] for r in Rolling(dt.timedelta(days=1), FIRST).apply(f).df.collect()}
        assert all(firsts[(rows[i][1], i)] == rows[4 * (i // 4)][2] for i in range(40))
        both = combine(f, f, lambda a, b: b)
        assert sorted((r[AT], r[VALUE]) for r in both.df.collect()) == sorted((r[1], rows[4 * (i // 4) + 3][2]) for i, r in enumerate(rows))


def test_custom_calendars(spark):
    f = daily(spark, [1.0, 5, None, 2])
    terms = Boundaries("term", (d("2025-01-02"), d("2025-01-04")))
    assert values(Resample(terms, SUM, ZERO).apply(f), AT, VALUE) == [(d("2025-01-02"), 5), (d("2025-01-04"), 2)]


def test_baselines():
    london = Calendar("Europe/London")
    shift = Baseline(1, "month").resolve(None, london)
    assert shift.back(Timeframe(d("2025-03-31"), d("2025-04-30")), Calendar()) == Timeframe(d("2025-02-28"), d("2025-03-30"))
    assert shift.back(Timeframe(d("2025-04-29 23:00"), d("2025-05-01")), london).start == d("2025-03-30 00:00")
    fits = {(0, 1): "day 15m", (0, 7): "day week 15m", (0, 364): "day week 15m", (1, 0): "month", (12, 0): "month season", (48, 0): "month season", (600, 0): "month season", (1, 7): ""}
    for (months, days), grains in fits.items():
        assert {p.name for p in (DAY, WEEK, MONTH, SEASON, Span(900)) if CalendarShift(months, days).problem(p) is None} == set(grains.split())
    assert CalendarShift(1, 0).problem(None) is None
    with pytest.raises(ValueError):
        Baseline(0, "day")


def test_run_chains(spark):
    out = run(daily(spark, [1.0, 2, 3]), [WhereValue(2), Total(SUM)])
    assert values(out) == [5.0]


LEAGUE = Calendar("Europe/London", season=Seasons((d("2023-08-11"), d("2024-08-16"), d("2025-08-15")), ("first", "second")))


def test_listed_seasons(spark):
    rows = [(1, d("2023-08-10 22:30"), 1.0), (1, d("2023-08-10 23:30"), 2.0), (1, d("2024-08-15 22:59"), 4.0), (1, d("2024-08-15 23:00"), 8.0), (1, d("2025-08-14 22:59"), 16.0), (1, d("2025-08-14 23:00"), 32.0)]
    f = points(spark, rows, {"e": "bigint"}, "e", TimeAxis())
    out = Resample(SEASON, SUM).apply(f, Context(LEAGUE))
    assert values(out, AT, VALUE) == [(d("2023-08-11"), 6), (d("2024-08-16"), 24)]  # rows before and after the list are in no season
    assert [r[0] for r in out.df.select(out.axis.grain.label(F.col(AT))).orderBy(AT).collect()] == ["first", "second"]
    assert Seasons(LEAGUE.season.starts).label(0) == "2023/24" and Seasons((d("2024-01-01"), d("2024-05-01"))).label(0) == "2024"
    for starts in ((d("2024-01-01"),), (d("2024-01-01"), d("2024-01-01"))):
        with pytest.raises(ValueError):
            Seasons(starts)
    months = daily(spark, [float(i) for i in range(40)])
    calendar = Calendar(season=Seasons((d("2024-12-20"), d("2025-02-14"), d("2025-05-01"))))
    grown = Forecast(MeanModel(), SEASON_END).apply(Resample(DAY, SUM).apply(months), Context(calendar))
    assert grown.df.agg(F.max(AT)).first()[0] == d("2025-02-13")
    wide = Resample(SEASON, SUM, ZERO, TIMEFRAME).apply(months, Context(calendar, Timeframe(d("2025-01-01"), d("2025-03-01"))))
    assert values(wide, AT, VALUE) == [(d("2024-12-20"), sum(range(40))), (d("2025-02-14"), 0)]


def test_baselines_of_listed_seasons():
    year = Timeframe(d("2024-08-20"), d("2025-06-01"))
    shift = Baseline(1, "season").resolve(year, LEAGUE)
    assert (shift.months, shift.days) == (0, 371) and shift.problem(SEASON) is None and shift.problem(WEEK) is None and shift.problem(MONTH)
    assert shift.back(year, LEAGUE).start == d("2023-08-15")
    with pytest.raises(ValueError):
        Baseline(2, "season").resolve(year, LEAGUE)
    even = Calendar(season=Seasons((d("2023-08-01"), d("2024-08-01"), d("2025-08-01"))))
    assert Baseline(1, "season").resolve(year, even).months == 12
