"""Every registered query against its SQL, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="the given tables are not here")

# Models and hashes that SQL cannot state; their own tests hold them against brute force.
MODELLED = {"op1_html", "op2_private", "op3_similar", "op4_language", "op7_quality", "op9_toxicity", "op10_pieces", "op11_whitening",
            "op12_fingerprints", "op13_runs", "pipeline"}

# Queries with joins, run once more with all joins shuffled and skewed partitions split.
JOINING = ["rate_alerts_by_policy", "admission_outcome", "gate_rolling", "append_history", "fan_out",
           "fan_out_counts", "undelivered", "assign_offsets", "latency_summary"]
SHUFFLED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.01",
}


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMOKE_DIR}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_query_has_sql_but_the_known():
    assert set(queries()) - set(oracle_sql()) <= MODELLED
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", JOINING)
def test_query_without_broadcasts(spark, sql, name):
    try:
        for key, value in SHUFFLED.items():
            spark.conf.set(key, value)
        test_query(spark, sql, name)
    finally:
        for key in SHUFFLED:
            spark.conf.unset(key)


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query(spark, sql, name):
    found = queries()[name](spark, SMOKE_DIR)
    columns = sorted(found.columns)
    cursor = sql.execute(oracle_sql()[name])
    names = [column[0] for column in cursor.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()]
    rows = [tuple(row[c] for c in columns) for row in found.collect()]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)
