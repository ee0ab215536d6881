"""The stages of the pipeline against the operators' decisions, and the SQL counterparts."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fileledger.llm import oracles, queries

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, FOLDER)
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        assert kept.columns == docs.columns
        if name != "mixing":
            assert 0 < kept.count() <= before.count() and kept.exceptAll(before).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, FOLDER)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in kept.collect()}
    assert corpus_pipeline.ORACLE_SQL is None


def test_registered():
    without_sql = {"pipeline", *(f"op{n}" for n in (1, 2, 4, 5, 6, 7, 8, 10, 11))}
    mine = {q for q in entry.queries() if q == "pipeline" or q[:2] == "op" and q[2].isdigit()}
    assert {q.split("_")[0] for q in mine - set(entry.oracle_sql())} == without_sql and len(mine) == 14


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        db.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    mine = queries.queries()[name](spark, FOLDER)
    columns = sorted(mine.columns)
    assert sorted(map(tuple, mine.select(columns).collect())) == sorted(db.execute(f"select {', '.join(columns)} from ({oracles.oracle_sql()[name]})").fetchall())
