"""Every registered query against its checking SQL on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from floodspark.plans.oracles import ORACLES  # noqa: E402
from floodspark.plans.queries import QUERIES  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "customer events lineitem nation orders part region supplier".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


#: Rounding to hot cells has no SQL form; test_outlines.py holds this query against exact crossing tests.
WITHOUT_SQL = {"condition_breaklines"}


def test_every_query_has_checking_sql():
    assert set(QUERIES) == set(ORACLES) | WITHOUT_SQL and not set(ORACLES) & WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITHOUT_SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    place = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in place) for r in cursor.fetchall()]
    assert got, "a query without rows checks nothing"
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name,old,new", [
    ("points_in_zones", "< z.h", "<= z.h + 1"), ("flow_diagnostics", "> 0.001", "> 0.5"), ("heartbeats", "INTERVAL 900", "INTERVAL 90000"),
    ("align_forcing", "s.ts <= g.ts", "s.ts < g.ts"), ("node_lines", "n, 0) + 1", "n, 0) + 2"), ("mass_balance", "* 3600", "* 3601")])
def test_checking_sql_can_fail(spark, con, name, old, new):
    """A changed constant must show, or the check proves nothing."""
    assert old in ORACLES[name]
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name].replace(old, new))
    place = [[d[0] for d in cursor.description].index(c) for c in sorted(df.columns)]
    want = [tuple(r[i] for i in place) for r in cursor.fetchall()]
    assert plain([tuple(r) for r in df.select(*sorted(df.columns)).collect()]) != plain(want)
