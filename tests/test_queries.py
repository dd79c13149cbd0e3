"""Every registered report query against its SQL, at the smallest size."""

import pytest

from metricloom import queries as q
from oracle import duck, rows_of


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert rows_of(q.QUERIES[name](spark, sf)) == duck(sf, q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert q.QUERIES[name](spark, sf).count() > 0


def test_queries_of_whole_tables_take_every_entity(spark, sf):
    """As many entities as the table has, none of them filtered, and SQL without an id filter."""
    orders, events, lines = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "events", "lineitem"))
    every = {r[0] for r in orders.select("o_custkey").distinct().collect()}
    for name in ("gap_leave", "gap_zero", "gap_carry", "gap_interpolate", "gap_zero_timeframe", "gap_carry_timeframe"):
        assert {r[0] for r in q.QUERIES[name](spark, sf).select("customer").distinct().collect()} == every
    signed = {r[0] for r in events.where("event_type = 'signup'").select("user_id").distinct().collect()}
    assert {r[0] for r in q.QUERIES["gap_zero_day"](spark, sf).select("account").distinct().collect()} == signed
    viewed = {r[0] for r in events.where("event_type = 'view'").groupBy("user_id").agg({"value": "sum"}).where("`sum(value)` <> 0").collect()}
    assert {r[0] for r in q.QUERIES["ratio_rolling"](spark, sf).select("account").distinct().collect()} >= viewed
    assert q.QUERIES["rolling_raw_count"](spark, sf).count() == lines.count()
    assert q.QUERIES["merge_tag_union"](spark, sf).agg({"value": "sum"}).first()[0] == orders.count() + lines.count()
    assert [n for n in q.SQL if "BETWEEN 1 AND" in q.SQL[n]] == ["scan_entity_list", "tsbs_max_all_8"]  # lists of entities are what these are about
    assert {r[0] for r in q.QUERIES["dashboard_example_chart"](spark, sf).select("chart").distinct().collect()} == set(range(8))
