"""The duplicate plan: from reports and snapshots to groups, targets and a baseline."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger import fixed_values as V
from fileledger.operators import dedup, reconcile
from fileledger.operators.validate import (
    all_violations, application_violations, record_violations, require, violations,
)
from fileledger.functions.hashes import canonical_uuid, valid_hash
from fileledger.operators.skew import lookup
from fileledger.session import cut_lineage


class DuplicatePlan(NamedTuple):
    baseline: DataFrame
    groups: DataFrame
    targets: DataFrame
    applications: DataFrame


def candidate_violations(candidates: DataFrame, organization: str) -> DataFrame:
    return violations(
        candidates,
        F.concat_ws("/", "app", "hash_key"),
        {
            V.MESSAGE_CANDIDATE_ORGANIZATION: F.col("org") != organization,
            V.MESSAGE_IDENTITY: canonical_uuid(F.col("app")).isNull(),
            V.MESSAGE_HASH: valid_hash(
                F.col("hash_key")
            ).isNull(),
        },
    )


def plan_duplicates(
    records: DataFrame,
    applications: DataFrame,
    candidates: DataFrame,
    organization: str,
    scan_apps: DataFrame | None = None,
    os_types: tuple[int, ...] = (1, 2),
    validate: bool = True,
) -> DuplicatePlan:
    """Groups and removal targets for reported hashes and scanned applications.

    ``candidates``: org, app, hash_key. ``scan_apps``: app. Any violation rejects
    the whole plan before work starts.
    """
    # The report and the applications are small next to the records and used several times.
    candidates = cut_lineage(candidates.select(*dedup.GROUP_KEYS))
    wanted_apps = candidates.select("app")
    if scan_apps is not None:
        scan_apps = cut_lineage(scan_apps.select("app").distinct())
        wanted_apps = wanted_apps.unionByName(scan_apps)
    wanted_apps = wanted_apps.distinct().withColumnRenamed("app", "applicationId")
    scoped = cut_lineage(applications.join(wanted_apps, "applicationId", "left_semi"))
    if validate:
        require(
            all_violations(
                candidate_violations(candidates, organization),
                application_violations(scoped, organization),
            )
        )
    scoped = scoped.filter(F.col("osType").isin(*os_types))
    chosen = scoped.select(F.col("applicationId").alias("app"))
    snapshot = lookup(dedup.record_view(records), chosen, ["app"], ["fid"], "left_semi")
    if validate:
        require(record_violations(snapshot, scoped, organization))
    snapshot = snapshot.withColumn("org", F.lit(organization))
    reported = lookup(candidates, chosen, ["app"], ["hash_key"], "left_semi")
    # Decided once, for the targets and for whoever asks for the groups.
    matched = cut_lineage(dedup.planned_groups(snapshot, reported, scan_apps))
    targets = dedup.with_application_fields(dedup.removal_targets(snapshot, matched), scoped)
    return DuplicatePlan(reconcile.with_fingerprint(snapshot), matched, targets, scoped)


def reconcile_plan(
    plan: DuplicatePlan, records: DataFrame, applications: DataFrame, stop: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(targets with new status, violations) against a fresh snapshot."""
    chosen = plan.applications.select(F.col("applicationId").alias("app"))
    view = lookup(dedup.record_view(records), chosen, ["app"], ["fid"], "left_semi")
    # With columns that the baseline did not have: a filled one is a change.
    current = reconcile.with_fingerprint(view)
    diff = reconcile.snapshot_diff(plan.baseline, current, plan.targets)
    bad = reconcile.diff_violations(diff).unionByName(
        reconcile.metadata_violations(plan.applications, applications)
    )
    if stop:
        require(bad)
    return reconcile.updated_targets(plan.targets, diff), bad
