"""Every query that has an oracle says the same as it, over the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

HOME = os.environ.get("TURNMILL_TABLES", "/root/testdata/sf0.001")
TABLES = "corrections documents eval_passages meetings quality_events segments terminology_eval tombstones".split()

pytestmark = pytest.mark.skipif(not os.path.exists(HOME), reason="no tables here")


def plain(frame):
    frame = frame[sorted(frame.columns)]

    def cell(v):
        v = v.item() if hasattr(v, "item") else v
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return int(v) if isinstance(v, float) and v == int(v) else v

    return list(frame.columns), sorted((tuple(map(cell, row)) for row in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{HOME}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, db, name):
    assert plain(entry.queries()[name](spark, HOME).toPandas()) == plain(db.execute(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
