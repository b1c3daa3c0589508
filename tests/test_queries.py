"""Every query against its SQL in DuckDB, and the driver's contract."""

import math

import pytest

import __spark_entry__
from rubrica.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(repr(0.0 if isinstance(r[i], float) and r[i] == 0 else r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    have = [tuple(r) for r in df.collect()]
    assert have
    assert _plain(have, df.columns) == _plain(rel.fetchall(), rel.columns)


def test_remediation_ends(spark):
    rows = registry.queries()["remediation_loop"](spark, SF).collect()
    first = {(r.doc_id, r.turn): r.composite for r in registry.queries()["composite_quality"](spark, SF).collect()}
    assert len(rows) == len(first)
    assert sum(r.passed for r in rows) >= sum(x >= 0.75 for x in first.values())
    assert all(not math.isnan(r.composite) for r in rows)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(registry.oracle_sql()) <= set(__spark_entry__.oracle_sql())
