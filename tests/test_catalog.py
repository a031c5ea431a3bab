"""Every query runs; those with SQL give its rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import DATA


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def same(v):
    return round(v, 6) if isinstance(v, float) else v


QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_sql_is_for_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("p6_", "p7_", "p8_"))))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(same(r[c]) for c in columns) for r in df.collect()), key=str)
    if name in ORACLES:
        cursor = sql.execute(ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(same(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def empty_tables(tmp_path_factory):
    import pyarrow.parquet as pq

    root = tmp_path_factory.mktemp("empty")
    for name in ("trap_event", "oid_alias", "raw_packet"):
        rows = pq.read_table(f"{DATA}/{name}.parquet")
        pq.write_table(rows if name == "oid_alias" else rows.slice(0, 0), f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", ["p1_found", "p1_windows", "p2_found", "p3_found", "p4_found", "p4_wide", "p5_found", "relay_outcomes", "relay_packets", "dedup_states", "clears_of_states", "load_ramp"])
def test_empty_tables(spark, empty_tables, name):
    assert QUERIES[name](spark, empty_tables).count() == 0
