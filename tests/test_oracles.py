"""Registered queries against their SQL twins on the smallest data set.

Every area is sampled here; ``tools/check_oracles.py`` runs all of them, as does
``TALLYFOLD_ALL=1``.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, _rows

SLOW = ("l0", "l10", "a18", "a19", "a20", "a23", "a24", "b01", "b02", "m12", "m13", "m14", "w03", "w06", "w15", "t02", "t07", "p11", "j04", "f0", "f13", "b13", "r0")
NAMES = [n for n in entry.oracle_sql() if os.environ.get("TALLYFOLD_ALL") or not n.startswith(SLOW)]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
