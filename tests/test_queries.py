import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from strandloom.plans import queries as plan_queries


@pytest.fixture(scope="session")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([float(r[i]) if isinstance(r[i], float) else r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(plan_queries.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir, con):
    df = plan_queries.QUERIES[name](spark, sf_dir)
    want = con.sql(plan_queries.ORACLE_SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() > 100 and {"m_value", "dna_100", "split"} <= set(df.columns)


def test_registry():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", ["distance_window_join", "nearest_probe", "point_in_intervals", "interval_mean_signal", "genomic_regions", "caliper_edges"])
def test_range_joins_plan_no_nested_loop(name, spark, sf_dir):
    plan = plan_queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
