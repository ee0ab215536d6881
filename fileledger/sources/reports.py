"""Duplicate reports, large-application reports and requested-hash lists."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fileledger import fixed_values as V
from fileledger.functions.hashes import canonical_uuid, hash_text, is_hash, valid_hash
from fileledger.functions.text import none_if_empty, once, trimmed
from fileledger.operators.validate import all_violations, require, require_columns, violations
from fileledger.sources.files import ORDER, read_csv_rows, read_report_rows, trimmed_headers


class Report(NamedTuple):
    """Typed rows, rows that reject the report, and the number of repeated rows."""

    rows: DataFrame
    violations: DataFrame
    repeated: DataFrame


def duplicate_report(rows: DataFrame, organization: str, order: str = ORDER) -> Report:
    """One row per (application, hash); of repeated rows the last one counts."""
    require_columns(
        rows,
        ["organizationid", "applicationid", "hash"],
        "Report must contain OrganizationId, ApplicationId, and Hash columns.",
    )
    name = trimmed(F.col("name")) if "name" in rows.columns else F.lit("")
    count = F.col("count") if "count" in rows.columns else F.lit(None)
    typed = rows.select(
        canonical_uuid(F.col("organizationid")).alias("organization_id"),
        canonical_uuid(F.col("applicationid")).alias("application_id"),
        valid_hash(F.col("hash")).alias("hash"),
        name.alias("name"),
        count.cast("string").alias("count"),
        F.col(order).alias("_order"),
    )
    bad = violations(
        typed,
        F.concat_ws("/", "application_id", "hash"),
        {
            V.MESSAGE_IDENTITY: F.col("organization_id").isNull()
            | F.col("application_id").isNull(),
            "Report contains another organization.": F.col("organization_id") != organization,
            V.MESSAGE_HASH: F.col("hash").isNull(),
        },
    )
    return Report(latest_report_rows(typed, "_order"), bad, repeated_rows(typed))


def latest_report_rows(typed: DataFrame, order: str) -> DataFrame:
    """Last row per (organization, application, hash), pre-aggregated before the exchange.

    Rows are sorted by hash first, which tells most of them apart by its first digits.
    """
    return (
        typed.groupBy("hash", "application_id", "organization_id")
        .agg(F.max(F.struct(F.col(order).alias("at"), "name", "count")).alias("last"))
        .select("organization_id", "application_id", "hash", "last.name", "last.count")
    )


def repeated_rows(typed: DataFrame) -> DataFrame:
    """How many report rows repeat an earlier (application, hash)."""
    keys = typed.groupBy("application_id", "hash").agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("repeated"),
        F.count(F.lit(1)).alias("rows"),
    )


def read_duplicate_report(
    spark: SparkSession, path: str, organization: str, file_format: str | None = None, multi_line: bool | None = None
) -> Report:
    report = duplicate_report(read_report_rows(spark, path, file_format, multi_line), organization)
    require(report.violations)
    return report


def large_report(rows: DataFrame, organization: str) -> Report:
    """Reported hash count per application; repeats must agree."""
    require_columns(
        rows,
        ["organizationid", "applicationid", "countofhashes"],
        "Expected ApplicationId, Name, OrganizationId, and Count of Hashes columns.",
    )
    digits = F.replace(F.col("countofhashes").cast("string"), F.lit(","), F.lit(""))
    typed = rows.select(
        canonical_uuid(F.col("organizationid")).alias("organization_id"),
        canonical_uuid(F.col("applicationid")).alias("application_id"),
        (F.coalesce(F.col("name").cast("string"), F.lit("")) if "name" in rows.columns else F.lit("")).alias("application"),
        F.when(digits.rlike("^[0-9]+$"), digits.try_cast("long")).alias("reported_hashes"),
    )
    bad = violations(
        typed,
        F.col("application_id"),
        {
            V.MESSAGE_IDENTITY: F.col("organization_id").isNull()
            | F.col("application_id").isNull(),
            "Report contains another organization.": F.col("organization_id") != organization,
            "Invalid hash count.": F.col("reported_hashes").isNull(),
        },
    )
    distinct = typed.select("application_id", "application", "reported_hashes").distinct()
    conflicts = (
        distinct.groupBy("application_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(
            F.lit("Conflicting repeated application rows; refresh the report.").alias("reason"),
            F.col("application_id").alias("key"),
        )
    )
    repeated = typed.groupBy("application_id").count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("repeated"),
        F.count(F.lit(1)).alias("rows"),
    )
    return Report(distinct, all_violations(bad, conflicts), repeated)


def read_large_report(
    spark: SparkSession, path: str, organization: str, file_format: str | None = None, multi_line: bool | None = None
) -> Report:
    report = large_report(read_report_rows(spark, path, file_format, multi_line), organization)
    require(report.violations)
    return report


def requested_hashes(rows: DataFrame) -> Report:
    """Requested (application, hash) list with operating system and record kind."""
    require_columns(
        rows,
        ["applicationid", "hash", "ostype"],
        "CSV requires unique ApplicationId, Hash, OsType columns. RecordType is optional.",
    )
    kind = F.upper(trimmed(F.col("recordtype"))) if "recordtype" in rows.columns else F.lit("")
    kind = F.coalesce(none_if_empty(kind), F.lit("HASH"))

    def unaliased(text: Column) -> Column:
        aliased = text
        for alias, name in V.RECORD_TYPE_ALIASES.items():
            aliased = F.when(text == alias, F.lit(name)).otherwise(aliased)
        return aliased

    typed = rows.select(
        canonical_uuid(trimmed(F.col("applicationid"))).alias("app"),
        hash_text(F.col("hash")).alias("hash"),
        trimmed(F.col("ostype")).try_cast("int").alias("os"),
        once(kind, unaliased).alias("kind"),
    )
    bad = violations(
        typed,
        F.concat_ws("/", "app", "hash"),
        {
            "Invalid application UUID or numeric OS type.": F.col("app").isNull() | F.col("os").isNull(),
            "Supported OS types are 1 (Windows) and 2 (macOS).": ~F.col("os").isin(1, 2),
            "Invalid hexadecimal hash or RecordType.": ~F.col("kind").isin("HASH", "SHA256ONLY")
            | ~is_hash(F.col("hash")),
            "SHA256 requires 64 hexadecimal characters.": (F.col("kind") == "SHA256ONLY")
            & (F.length("hash") != 64),
        },
    )
    distinct = typed.distinct()
    conflicts = (
        distinct.groupBy("app", "hash")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.lit("Conflicting duplicate.").alias("reason"), F.concat_ws("/", "app", "hash").alias("key"))
    )
    mixed = (
        distinct.groupBy("app")
        .agg(F.min("os").alias("low"), F.max("os").alias("high"))
        .filter("low <> high")
        .select(F.lit("One application has conflicting OS types.").alias("reason"), F.col("app").alias("key"))
    )
    empty = typed.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit("CSV is empty.").alias("reason"), F.lit("").alias("key")
    )
    return Report(distinct, all_violations(bad, conflicts, mixed, empty), repeated_requests(typed))


def repeated_requests(typed: DataFrame) -> DataFrame:
    per_key = typed.groupBy("app", "hash").count()
    return per_key.agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("repeated"),
        F.count(F.lit(1)).alias("rows"),
    )


def read_requested_hashes(spark: SparkSession, path: str) -> Report:
    report = requested_hashes(trimmed_headers(read_csv_rows(spark, path), keep=(ORDER,)))
    require(report.violations)
    return report
