"""Every registered query against its oracle on the small tables, and the contract of the entry module."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from lattica.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture
def oracle(small, tmp_path):
    """A connection of its own for each test, with bounds: one statement's failure leaves the others alone."""
    con = duckdb.connect(config={"memory_limit": "4GB", "threads": 4, "temp_directory": str(tmp_path)})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    yield con
    con.close()


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(columns), sorted(tuple(plain(r[k]) for k in order) for r in records)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_oracle(name, spark, small, oracle):
    df = registry.QUERIES[name](spark, small)
    got = rows(df.columns, df.collect())
    found = oracle.execute(registry.ORACLE_SQL[name])
    want = rows([c[0] for c in found.description], found.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_oracle_runs(name, spark, small):
    df = registry.QUERIES[name](spark, small)
    assert len(df.collect()) > 0 and df.columns


def test_entry(spark):
    assert entry_module.entry(spark).count() == 41 * 41


def test_names_agree():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_flagship_filter_reaches_the_scan(spark, small):
    df = spark.read.parquet(f"{small}/lineitem.parquet").withColumnRenamed("l_linenumber", "frame")
    from lattica.operators.transforms import scan_frames

    plan = scan_frames(df.select("frame", "l_quantity"), 2, 5, 1, renumber=False)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(l_linenumber,2)" in plan and "l_comment" not in plan
