"""Registered queries against DuckDB on the given tables.

A spread of queries runs by default; ``ALL_QUERIES=1`` runs every one.
"""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = """label_counts final_dataset w7_first_wins g6_usage g2_rtt_baseline j1_labelled_audit g10_exclusions w6_gap_flag
w10_transition_runs g15_slice_metrics k3_covering_sample k6_probe_choice k4_quota_anchors d6_feature_block g22_drift_slices
j13_late_labels l3_alerts v4_future_leak s15_prediction_partitions t1_scored_flows t5_closed_forecasts""".split()


def value(v):
    if isinstance(v, Decimal):
        v = float(v)
    if v is None or isinstance(v, str) or isinstance(v, bool):
        return str(v)
    return repr(float(v) + 0.0)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SOME)
def test_query_matches_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(value(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(tuple(value(row[names.index(c)]) for c in cols) for row in res.fetchall())
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["classe", "motivo_rotulagem", "n"]


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
