"""The operators' queries against their SQL."""

import os

import pytest

from metricloom.llm import queries as q
from oracle import duck, rows_of


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert rows_of(q.QUERIES[name](spark, sf)) == duck(sf, q.SQL[name])


def test_all_ten_are_registered():
    assert {n.split("_")[0] for n in q.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert os.path.isdir("/root/testdata/sf0.001")
