"""Every trace query against its SQL, and the entry module."""

import math

import duckdb
import pytest

import __spark_entry__
from failscope.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("events", "conversations", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(rows):
    fix = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted(repr(tuple(fix(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tables, name):
    got = registry.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in registry.ORACLES:
        assert got.columns
        return
    wanted = tables.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(wanted.columns)
    assert plain(rows) == plain(wanted.select(*[f'"{c}"' for c in got.columns]).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_one_exchange_for_the_battery(spark):
    """All window signals share the exchange by trace."""
    from failscope.operators import signals
    from failscope.plans.projection import steps_from_events

    plan = signals.run_signals(steps_from_events(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
