"""Saved plan tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_TABLES = ("baseline", "groups", "targets", "events", "meta", "apps")


def read_run_table(spark: SparkSession, root: str, table: str, run_id: str | None = None) -> DataFrame:
    """A plan table over all saved runs, or of one run: its folder is the only one read."""
    rows = spark.read.parquet(f"{root}/{table}")
    return rows if run_id is None else rows.filter(F.col("run_id") == run_id)


def read_run(spark: SparkSession, root: str, run_id: str) -> dict[str, DataFrame]:
    """All tables of one run, for audit."""
    tables = {}
    for table in RUN_TABLES:
        try:
            tables[table] = read_run_table(spark, root, table, run_id)
        except AnalysisException:
            continue
    return tables


def complete_runs(meta: DataFrame) -> DataFrame:
    """Run headers from key/value metadata; runs without a scope are skipped.

    ``meta``: run_id, key, value. A run has a fixed, small set of keys.
    """
    names = ["workflow", "phase", "created", "org", "instance", "user_instance"]
    wide = meta.groupBy("run_id").pivot("key", names).agg(F.first("value"))
    typed = wide.withColumn("created", F.col("created").try_cast("double"))
    return typed.filter(F.col("org").isNotNull()).na.fill("", ["instance", "user_instance"])


def run_scope_violations(meta: DataFrame, organization: str, instance: str = "", user_instance: str = "") -> DataFrame:
    """Runs that belong to another organization or instance, or whose preview never finished."""
    wide = meta.groupBy("run_id").pivot("key", ["org", "instance", "user_instance", "prepared"]).agg(F.first("value"))
    same = (
        F.coalesce(F.col("org") == organization, F.lit(False))
        & (F.coalesce("instance", F.lit("")) == instance)
        & (F.coalesce("user_instance", F.lit("")) == user_instance)
    )
    reason = F.when(~same, "Run belongs to another organization or API instance.").when(
        F.col("prepared").isNull(),
        "Preview did not finish. Create a new preview before execution or reconciliation.",
    )
    return wide.select(reason.alias("reason"), F.col("run_id").alias("key")).filter("reason is not null")
