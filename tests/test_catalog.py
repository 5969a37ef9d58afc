"""Every query with an oracle gives the rows of its SQL on the smallest tables."""

import math

import duckdb
import pytest

from cordillera.catalog import ORACLE_SQL, QUERIES
from cordillera.plans.base import TABLES

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return None if math.isnan(x) else round(float(x), 5) + 0.0
    return str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    columns = sorted(ours.columns)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = [tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall()]
    assert sorted(map(repr, (tuple(plain(row[c]) for c in columns) for row in ours.collect()))) == sorted(map(repr, theirs))
