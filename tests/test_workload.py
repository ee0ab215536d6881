"""Queries next to their SQL at the smallest scale."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fileledger.functions.hashes import canonical_uuid
from workload import views
from workload.check import _rows
from workload.oracles import oracle_sql
from workload.queries import queries

SF = "/root/testdata/sf0.001"
# The slow ones are checked by ``python -m workload.check``.
SLOW = {"rules_final", "consolidation_rules", "plan_counts", "status_histogram", "run_summary", "before_after", "skip_reasons"}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"create view {os.path.basename(file).removesuffix('.parquet')} as select * from '{file}'")
    return connection


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())
    assert set(queries()) <= set(entry.queries()) and set(oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - SLOW))
def test_query_equals_sql(spark, db, name):
    frame = queries()[name](spark, SF)
    cursor = db.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert _rows(frame.columns, frame.collect()) == _rows(columns, cursor.fetchall())


@pytest.fixture(scope="module")
def dear(spark, tmp_path_factory):
    """Six versions of one program; half of them cost 990 or more."""
    folder = tmp_path_factory.mktemp("dear")
    prices = [900.0, 989.9, 950.0, 990.0, 2000.0, 1500.0]
    rows = [(k, "red bolt", "Brand#1", "LARGE", k + 1, price) for k, price in enumerate(prices)]
    shape = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def _on_parts(folder, name):
    connection = duckdb.connect()
    connection.execute(f"create view part as select * from '{folder}/part.parquet/*.parquet'")
    cursor = connection.execute(oracle_sql()[name])
    return _rows([d[0] for d in cursor.description], cursor.fetchall())


def test_consolidation_takes_records_of_dear_parts(spark, dear):
    found = queries()["consolidation_rules"](spark, dear)
    rows = found.collect()
    assert _rows(found.columns, rows) == _on_parts(dear, "consolidation_rules")
    assert max(r["covered_observations"] for r in rows) == 6


def test_coverage_counts_records_of_dear_parts(spark, dear):
    found = queries()["rule_coverage"](spark, dear)
    rows = found.collect()
    assert _rows(found.columns, rows) == _on_parts(dear, "rule_coverage")
    broad = [r["covered_observations"] for r in rows if r["path"] == "c:\\program files\\*.exe"]
    assert broad == [6]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_a_report_counts_the_orders_once(spark):
    plan = views.report_rows(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_orderpriority") and plan.count("Aggregate [") == 1


def test_application_ids_are_the_digest_with_hyphens(spark):
    rows = spark.createDataFrame([("1-URGENT",), ("",), (None,)], "v string")
    found = rows.select(views.app_id(F.col("v")).alias("x"), canonical_uuid(F.md5("v")).alias("y")).collect()
    assert all(r["x"] == r["y"] for r in found) and found[2]["x"] is None
    assert "lambda" not in rows.select(views.app_id(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
