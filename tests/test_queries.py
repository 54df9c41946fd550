"""Every registered query with a SQL twin gives the same rows as DuckDB."""

import datetime
import math

import pytest

from conftest import SF_DIR
from fairline.plans import registry

ALL = registry.load_all()
WITH_SQL = [n for n, q in ALL.items() if q.sql]
WITHOUT_SQL = [n for n, q in ALL.items() if not q.sql]


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql(name, spark, duck):
    df = ALL[name].build(spark, SF_DIR)
    columns = sorted(df.columns)
    ours = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    relation = duck.sql(registry.with_tables(ALL[name].sql))
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    theirs = [tuple(plain(r[i]) for i in at) for r in relation.fetchall()]
    assert ordered(ours) == ordered(theirs)


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs_without_sql(name, spark):
    assert ALL[name].build(spark, SF_DIR).count() > 0


def test_queries_name_the_rows_they_cover():
    assert all(q.covers for q in ALL.values())
