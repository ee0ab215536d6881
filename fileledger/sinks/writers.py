"""Outputs: CSV exports, JSON audits and partitioned plan tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger.operators.reconcile import with_fingerprint


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; nested values must be flattened before."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_results(targets: DataFrame, path: str) -> None:
    """Record results: application, record, hash, status and detail."""
    write_csv(targets.select("app", "fid", F.col("hash"), "status", "detail"), path)


def write_application_health(report: DataFrame, path: str) -> None:
    """Large-application rows with the live counts known so far."""
    write_csv(report, path)


def write_proposed_rules(reviews: DataFrame, path: str) -> None:
    write_csv(
        reviews.select(
            F.col("path").alias("Path"), F.col("process_path").alias("Process Path"),
            F.col("certificate").alias("Certificate"), F.col("created_by").alias("Created By"),
            F.col("covered_observations").alias("Covered observations"),
            F.col("status").alias("Status"), F.col("reason").alias("Reason"),
        ),
        path,
    )


def write_run_history(history: DataFrame, path: str) -> None:
    created = F.date_format(F.timestamp_seconds("created"), "yyyy-MM-dd HH:mm")
    write_csv(history.withColumn("created", created), path)


def write_audit(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON-lines folder per table of a run."""
    for name, table in tables.items():
        table.write.mode("errorifexists").json(f"{path}/{name}")


def write_report_json(report: DataFrame, path: str) -> None:
    """Normalised report rows as JSON lines."""
    report.write.mode("errorifexists").json(path)


def write_plan(tables: dict[str, DataFrame], root: str, run_id: str) -> None:
    """Plan tables below ``root/<table>/run_id=<run>``; an existing run is never overwritten."""
    for name, table in tables.items():
        table.drop("run_id").write.mode("errorifexists").parquet(f"{root}/{name}/run_id={run_id}")


def write_snapshot(records: DataFrame, path: str) -> None:
    """Record snapshot by organization and application, sorted for hash searches.

    Sorting by hash inside the files gives Parquet tight min/max ranges, so a
    search for one hash skips most row groups. The hash is part of the layout
    key, so one application with most of the records is still written by many tasks.
    """
    (
        records.repartitionByRange("organizationId", "applicationId", "hash_key", "applicationFileId")
        .sortWithinPartitions("organizationId", "applicationId", "hash_key")
        .write.partitionBy("organizationId", "applicationId")
        .mode("errorifexists")
        .parquet(path)
    )


def write_stored_snapshot(records: DataFrame, table: str, path: str, buckets: int) -> None:
    """A record view with its fingerprint as a table in buckets by record.

    Two such tables with as many buckets are compared without an exchange. Buckets go by record
    rather than by hash: one much repeated hash would fill one of them.
    """
    keyed = records if "fingerprint" in records.columns else with_fingerprint(records)
    (
        keyed.repartition(buckets, "app", "fid")
        .write.bucketBy(buckets, "app", "fid")
        .sortBy("app", "fid")
        .option("path", path)
        .mode("errorifexists")
        .saveAsTable(table)
    )
