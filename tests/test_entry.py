import math
import os

import pytest

import __spark_entry__ as entry
from dhwanika.plans import catalog

NAMES = sorted(catalog.QUERIES)


def cells(rows, columns):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, float):
            return round(v, 6) + 0.0
        return v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    mine = [tuple(r) for r in df.collect()]
    assert name in catalog.SQL
    cursor = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert cells(mine, df.columns) == cells(cursor.fetchall(), columns)


def test_flagship(spark):
    if not os.path.isdir(entry.SMALL):
        pytest.skip("no test tables")
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
