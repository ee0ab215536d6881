"""Fail-closed validation.

A validator never filters: it returns the violating rows as a table of
``(reason, key)``. ``require`` stops a job when that table is not empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger.functions.hashes import canonical_id, canonical_uuid, valid_id
from fileledger.operators.skew import lookup


class ValidationError(ValueError):
    """Input was rejected as a whole."""


def violations(df: DataFrame, key: Column, checks: dict[str, Column]) -> DataFrame:
    """Rows failing a check, with the first reason that applies; one pass over the input."""
    first = F.coalesce(*[F.when(bad, F.lit(reason)) for reason, bad in checks.items()])
    return df.select(first.alias("reason"), key.cast("string").alias("key")).filter(
        F.col("reason").isNotNull()
    )


def all_violations(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def require(found: DataFrame) -> None:
    """Reject the input when any violation exists, naming the first by reason and key.

    All tasks look at once; a limit would ask one task, then a few more, and so on through a valid input.
    """
    first = found.agg(F.min(F.struct("reason", "key")).alias("first")).collect()[0]["first"]
    if first is not None:
        raise ValidationError(f"{first['reason']} ({first['key']})")


def require_columns(df: DataFrame, names: list[str], message: str) -> None:
    if not set(names) <= set(df.columns):
        raise ValidationError(message)


def repeated_ids(records: DataFrame, keys: list[str]) -> DataFrame:
    """Identifiers that occur more than once; leading zeros make no difference."""
    by = [canonical_id(F.col(k)).alias(k) if k in ("applicationFileId", "fid") else F.col(k) for k in keys]
    return (
        records.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(
            F.lit("Invalid or repeated application-file IDs.").alias("reason"),
            F.concat_ws("/", *keys).alias("key"),
        )
    )


def record_violations(records: DataFrame, applications: DataFrame, organization: str) -> DataFrame:
    """Owner, application, operating system, ID and uniqueness checks of a snapshot.

    ``records.app`` is the application a record was read for; the record's own
    ids may be missing but must not disagree.
    """
    known = applications.select(
        F.col("applicationId").alias("app"), F.lit(True).alias("_app"), F.col("osType").alias("_os")
    )
    joined = lookup(records, known, ["app"], ["applicationFileId"], "left")

    def field(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in records.columns else F.lit(None).cast(kind)

    def disagrees(column: Column, expected: Column) -> Column:
        return column.isNotNull() & (column != "") & ~F.coalesce(canonical_uuid(column) == expected, F.lit(False))

    row_checks = violations(
        joined,
        F.concat_ws("/", "app", "applicationFileId"),
        {
            "Unknown application.": F.col("_app").isNull(),
            "Record organization mismatch.": disagrees(field("organizationId"), F.lit(organization)),
            "Cross-application record received.": disagrees(field("applicationId"), F.col("app")),
            "Record OS mismatch.": (F.coalesce(field("osType", "int"), F.lit(0)) != 0)
            & (field("osType", "int") != F.col("_os")),
            "Invalid numeric file ID.": ~valid_id(F.col("applicationFileId")),
        },
    )
    return row_checks.unionByName(repeated_ids(records, ["app", "applicationFileId"]))


def application_violations(
    applications: DataFrame, organization: str, os_types: tuple[int, ...] = (1, 2)
) -> DataFrame:
    """Applications must be owned, supported, custom and unique."""
    rows = violations(
        applications,
        F.col("applicationId"),
        {
            "Application identity mismatch.": canonical_uuid(F.col("applicationId")).isNull(),
            "Application owner/OS mismatch; only Windows and macOS are supported.": ~(
                F.coalesce(canonical_uuid(F.col("organizationId")) == organization, F.lit(False))
                & F.coalesce(F.col("osType").isin(*os_types), F.lit(False))
            ),
            "Built-in or unknown application type cannot be modified.": F.coalesce(
                F.col("isBuiltIn"), F.lit(True)
            ),
        },
    )
    repeats = (
        applications.groupBy("applicationId")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.lit("Repeated application.").alias("reason"), F.col("applicationId").alias("key"))
    )
    return rows.unionByName(repeats)
