"""Every light registered query against its SQL at the smallest scale; heavy ones have tests of their own."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from siftwatch.plans.queries import QUERIES
from check import TABLES, table

HEAVY = {"clean_threats", "duplicate_report", "duplicate_samples", "dedup_summary", "run_metrics", "greedy_dedup", "triage_pipeline"}


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - HEAVY))
def test_query_matches_sql(spark, sf, db, name):
    df = queries()[name](spark, sf)
    mine = table(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(oracle_sql()[name])
    assert mine == table([d[0] for d in cur.description], cur.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql())


def test_entry_ranks_the_survivors(spark):
    rows = entry(spark).collect()
    assert rows
    assert [r.risk_score for r in rows] == sorted((r.risk_score for r in rows), reverse=True)
    assert all(0 <= r.novelty_score <= 1 and 0 <= r.keyword_score <= 1 for r in rows)
