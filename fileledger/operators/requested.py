"""Plans from an explicit list of requested (application, hash) pairs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger import fixed_values as V
from fileledger.functions.hashes import all_hashes
from fileledger.operators.skew import lookup
from fileledger.operators.tables import one_row
from fileledger.session import cut_lineage

_HASH_FIELDS = ("hash", "originalHash", "sha256", "sha256Hash")


class RequestedPlan(NamedTuple):
    targets: DataFrame
    matched: DataFrame
    unmatched: DataFrame
    counts: DataFrame


def hash_only(flag: Column) -> Column:
    """The hash-only flag as a boolean or in its legacy text spellings."""
    return F.coalesce(flag.cast("string").isin("true", "True"), F.lit(False))


def record_hashes(records: DataFrame) -> DataFrame:
    """One row per hash-only record and distinct hash it carries (at most four)."""
    fields = [F.col(c) for c in _HASH_FIELDS if c in records.columns]
    return records.filter(hash_only(F.col("isHashOnly"))).select(
        "app", "fid", F.explode(all_hashes(*fields)).alias("hash")
    )


def requested_hits(records: DataFrame, requested: DataFrame) -> DataFrame:
    """(app, fid, hash) for every requested hash a record carries."""
    return record_hashes(records).join(requested.select("app", "hash"), ["app", "hash"])


def requested_plan(records: DataFrame, requested: DataFrame) -> RequestedPlan:
    """Targets with their smallest matching hash, and the hashes found or not found."""
    # The list is read for the hits, for its applications, twice for the counts and for what was not
    # found; four results follow from the hits. Both are made once.
    requested = cut_lineage(requested)
    hits = cut_lineage(requested_hits(records, requested))
    targets = hits.groupBy("app", "fid").agg(F.min("hash").alias("hash")).withColumns(
        {"status": F.lit(V.PLANNED), "detail": F.lit("")}
    )
    matched = hits.select("app", "hash").distinct()
    unmatched = requested.join(matched, ["app", "hash"], "left_anti")
    scanned = lookup(records, requested.select("app").distinct(), ["app"], ["fid"], "left_semi")
    counts = one_row(
        requested.agg(F.count(F.lit(1)).alias("requested")),
        scanned.agg(F.count(F.lit(1)).alias("scanned")),
        targets.agg(F.count(F.lit(1)).alias("planned")),
        unmatched.agg(F.count(F.lit(1)).alias("unmatched")),
    )
    return RequestedPlan(targets, matched, unmatched, counts)


def requested_applications(requested: DataFrame) -> DataFrame:
    """Operating system and number of requested hashes per application."""
    return requested.groupBy("app").agg(
        F.min("os").alias("os"), F.count(F.lit(1)).alias("requested_hashes")
    )


def application_preview(requested: DataFrame, targets: DataFrame) -> DataFrame:
    """Requested hashes and target records per application."""
    per_target = targets.groupBy("app").agg(F.count(F.lit(1)).alias("target_records"))
    return requested_applications(requested).join(per_target, "app", "left").na.fill(0, ["target_records"])


def recover_targets(
    targets: DataFrame, remaining: DataFrame, applications: DataFrame | None = None, recovery: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(targets with new status, violations) from the records that still exist.

    A target that changed its hash or type since planning blocks recovery.
    """
    fields = [F.col(c) for c in _HASH_FIELDS if c in remaining.columns]
    live = remaining.select(
        "app", "fid", all_hashes(*fields).alias("_hashes"), hash_only(F.col("isHashOnly")).alias("_only")
    )
    joined = targets.join(live, ["app", "fid"], "left")
    present = F.col("_hashes").isNotNull()
    changed = present & ~(F.array_contains("_hashes", F.col("hash")) & F.col("_only"))
    bad = joined.filter(changed & F.lit(recovery)).select(
        F.lit(V.MESSAGE_TARGET_CHANGED).alias("reason"),
        F.concat_ws("/", "app", "fid").alias("key"),
    )
    kept = V.PLANNED if recovery else V.STILL_PRESENT
    status = F.when(present, F.lit(kept)).otherwise(F.lit(V.VERIFIED_ABSENT))
    return joined.withColumn("status", status).drop("_hashes", "_only"), bad


def selective_presence(targets: DataFrame, records: DataFrame) -> DataFrame:
    """Targets still found under their own hash: the check a hash-filtered read makes."""
    present = record_hashes(records).select("app", "hash", "fid").distinct()
    return targets.join(present, ["app", "hash", "fid"], "left_semi")
