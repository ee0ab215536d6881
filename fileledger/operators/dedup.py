"""Duplicate groups, survivors and removal targets.

Records carry ``org``, ``app``, ``fid``, ``hash_key`` and ``plain``; see
``record_view``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger import fixed_values as V
from fileledger.functions.hashes import id_order, numeric_id, plain_hash_record, primary_hash
from fileledger.operators.skew import lookup, null_safe_join, with_position

GROUP_KEYS = ["org", "app", "hash_key"]
# For sorts and joins: rows are told apart by their hash, hardly ever by organization and application.
SORT_KEYS = ["hash_key", "app", "org"]


def record_view(records: DataFrame) -> DataFrame:
    """Add identity, numeric order, primary hash and eligibility to raw records."""
    columns = {c: F.col(c) for c in records.columns}
    main = primary_hash(columns["hash"], columns.get("originalHash", F.lit(None).cast("string")))
    added = {
        "fid": F.col("applicationFileId").cast("string"),
        "id_num": numeric_id(F.col("applicationFileId").cast("string")),
        "hash_key": F.col("_main"),
        "plain": plain_hash_record(columns, F.col("_main")),
    }
    if "app" not in records.columns:
        added["app"] = F.col("applicationId")
    if "org" not in records.columns:
        added["org"] = F.col("organizationId")
    return records.withColumn("_main", main).withColumns(added).drop("_main")


def hash_groups(records: DataFrame) -> DataFrame:
    """One row per (organization, application, hash) with its survivor, if any.

    Count, smallest ID and eligibility all combine before the exchange, so a
    group of any size arrives as one row per task.
    """
    groups = (
        records.filter(F.col("hash_key") != "")
        .groupBy(*SORT_KEYS)
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.bool_and("plain").alias("all_plain"),
            F.min_by("fid", id_order(F.col("fid"))).alias("first_id"),
        )
    )
    return groups.select(*GROUP_KEYS, "members", "all_plain", "first_id").withColumns(_choice())


def _choice():
    eligible = (F.col("members") >= 2) & F.col("all_plain")
    return {
        "survivor": F.when(eligible, F.col("first_id")),
        "reason": F.when(F.coalesce(F.col("members"), F.lit(0)) < 2, F.lit(V.REASON_NO_DUPLICATES))
        .when(~F.col("all_plain"), F.lit(V.REASON_AMBIGUOUS))
        .otherwise(F.lit(V.REASON_SURVIVOR)),
    }


def wanted_groups(
    candidates: DataFrame, groups: DataFrame, scan_apps: DataFrame | None = None
) -> DataFrame:
    """Reported groups, plus every repeated hash of explicitly scanned applications."""
    wanted = candidates.select(*GROUP_KEYS)
    if scan_apps is not None:
        repeated = groups.filter("members > 1").select(*GROUP_KEYS)
        wanted = wanted.unionByName(
            lookup(repeated, scan_apps.select("app").distinct(), ["app"], ["hash_key"], "left_semi").select(*GROUP_KEYS)
        )
    return wanted.distinct()


def match_candidates(wanted: DataFrame, groups: DataFrame) -> DataFrame:
    """Wanted groups against current records; a missing group has no duplicates."""
    current = groups.select(*GROUP_KEYS, "members", "all_plain", "first_id")
    joined = wanted.join(current, GROUP_KEYS, "left")
    return joined.withColumns(_choice()).select(*GROUP_KEYS, "members", "survivor", "reason")


def planned_groups(
    records: DataFrame, candidates: DataFrame, scan_apps: DataFrame | None = None
) -> DataFrame:
    """``match_candidates`` of ``wanted_groups`` and ``hash_groups``, in one exchange.

    Records and reported groups are tagged, united and aggregated by group, so that records are
    read and grouped once, and no group is joined with itself.
    """
    none, found = F.lit(None), F.col("_found")
    rows = records.filter(F.col("hash_key") != "").select(*GROUP_KEYS, "fid", "plain", F.lit(True).alias("_found"))
    rows = rows.unionByName(
        candidates.select(
            *GROUP_KEYS, none.cast("string").alias("fid"), none.cast("boolean").alias("plain"), F.lit(False).alias("_found")
        )
    )
    groups = rows.groupBy(*SORT_KEYS).agg(
        F.nullif(F.count_if(found), F.lit(0)).alias("members"),
        F.bool_and("plain").alias("all_plain"),
        F.min_by("fid", F.when(found, id_order(F.col("fid")))).alias("first_id"),
        F.bool_or(~found).alias("_wanted"),
    )
    wanted = F.col("_wanted")
    if scan_apps is not None:
        scanned = scan_apps.select("app", F.lit(True).alias("_scanned")).distinct()
        groups = lookup(groups, scanned, ["app"], ["hash_key"], "left")
        wanted = wanted | (F.col("_scanned") & (F.col("members") > 1))
    return groups.filter(wanted).withColumns(_choice()).select(*GROUP_KEYS, "members", "survivor", "reason")


def removal_targets(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Every record of an eligible group but its survivor."""
    eligible = groups.filter(F.col("survivor").isNotNull()).select(*GROUP_KEYS, "survivor")
    members = null_safe_join(records, eligible, SORT_KEYS)
    return members.filter(F.col("fid") != F.col("survivor")).drop("survivor").withColumns(
        {"status": F.lit(V.PLANNED), "detail": F.lit("")}
    )


def removal_waves(targets: DataFrame, batch_size: int = V.MAX_WAVE_SIZE) -> DataFrame:
    """Number targets of a group in ID order, of any length, and cut them into bounded waves.

    Only keys and IDs are sorted and numbered; the rows meet their number by key.
    """
    size = min(V.MAX_WAVE_SIZE, batch_size)
    slim = targets.select(*GROUP_KEYS, "fid")
    numbered = with_position(slim, [id_order(F.col("fid"))], "position", keys=GROUP_KEYS)
    if set(targets.columns) != set(slim.columns):
        numbered = null_safe_join(targets, numbered, [*GROUP_KEYS, "fid"])
    return numbered.withColumn("wave", F.floor((F.col("position") - 1) / size).cast("long"))


def group_preview(groups: DataFrame, targets: DataFrame) -> DataFrame:
    """Groups with the number of planned deletions."""
    per_group = targets.groupBy(*GROUP_KEYS).agg(F.count(F.lit(1)).alias("deletions"))
    return groups.join(per_group, GROUP_KEYS, "left").select(
        *GROUP_KEYS, "survivor", "reason", F.coalesce("deletions", F.lit(0)).alias("deletions")
    )


def with_application_fields(targets: DataFrame, applications: DataFrame) -> DataFrame:
    """Target rows completed with the application's own name, system and owner."""
    dimension = applications.select(
        F.col("applicationId").alias("app"),
        F.col("name").alias("applicationName"),
        F.col("osType").alias("application_os"),
    )
    kept = targets.drop("applicationName", "application_os")
    joined = lookup(kept, dimension, ["app"], ["fid"], "left")
    return joined.withColumns(
        {"osType": F.col("application_os"), "organizationId": F.col("org"), "applicationId": F.col("app")}
    ).drop("application_os")
