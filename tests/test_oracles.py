"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck(small):
    found = duckdb.connect()
    found.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        found.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, small, name):
    frame = entry.queries()[name](spark, small)
    columns = sorted(frame.columns)
    mine = [tuple(r[c] for c in columns) for r in frame.collect()]
    said = duck.sql(entry.oracle_sql()[name])
    assert sorted(said.columns) == columns
    at = [said.columns.index(c) for c in columns]
    theirs = [tuple(r[i] for i in at) for r in said.fetchall()]
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(mine, key=key) == sorted(theirs, key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_roundtrip_has_every_clip(spark, duck, small):
    clips = entry.queries()["json_roundtrip"](spark, small).where("kind = 'word'").select("clip").distinct().count()
    assert clips == duck.sql("SELECT count(DISTINCT conv_id) FROM conversations").fetchall()[0][0]
