"""Every registered query against its SQL on the smallest data set."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from cellarline.plans.oracle import all_sql
from cellarline.plans.registry import all_queries
from tests.conftest import DATA
from tools.compare import differences

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())


def test_the_entry_registers_them_all():
    assert set(all_queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_agrees_with_sql(spark, duck, name):
    got = all_queries()[name](spark, DATA).toPandas()
    assert differences(got, duck.execute(all_sql()[name]).df()) == []


def test_entry(spark):
    first = entry.entry(spark).limit(3).toPandas()
    assert list(first["ranking"]) == [1, 2, 3]
