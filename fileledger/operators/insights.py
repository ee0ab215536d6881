"""Summaries of reports, plans, snapshots and outcomes. Report counts are hints, never targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger import fixed_values as V
from fileledger.functions.hashes import os_name
from fileledger.operators.tables import one_row

_LONG = 9.2e18


def extra_records(count: Column) -> Column:
    """Reported copies beyond the first: null unless the count is a whole number >= 1."""
    value = count.try_cast("double")
    known = (value >= 1) & (value < _LONG) & (value == F.floor(value))
    return F.when(known & ~F.isnan(value), value.try_cast("long") - 1)


def report_by_application(report: DataFrame) -> DataFrame:
    """Candidate groups and estimated extra records per application."""
    extra = extra_records(F.col("count"))
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit(V.UNNAMED_APPLICATION))
    return report.groupBy("application_id").agg(
        F.min_by(name, "hash").alias("application"),
        F.count(F.lit(1)).alias("candidate_groups"),
        F.coalesce(F.sum(extra), F.lit(0)).alias("estimated_extra_records"),
        F.count_if(extra.isNull()).alias("unknown_counts"),
    )


def report_totals(report: DataFrame) -> DataFrame:
    """Groups, distinct and shared hashes, extras and unknown counts.

    A hash is counted once per application first; the exchange carries one row
    per hash and task, however often the hash is reported.
    """
    extra = extra_records(F.col("count"))
    per_hash = (
        report.select("hash", "application_id", extra.alias("extra"))
        .groupBy("hash")
        .agg(
            F.count(F.lit(1)).alias("groups"),
            F.min("application_id").alias("low"),
            F.max("application_id").alias("high"),
            F.sum("extra").alias("extras"),
            F.count_if(F.col("extra").isNull()).alias("unknown"),
        )
    )
    return per_hash.agg(
        F.coalesce(F.sum("groups"), F.lit(0)).alias("groups"),
        F.count(F.lit(1)).alias("hashes"),
        F.count_if(F.col("low") < F.col("high")).alias("shared_hashes"),
        F.coalesce(F.sum("extras"), F.lit(0)).alias("extras"),
        F.coalesce(F.sum("unknown"), F.lit(0)).alias("unknown_counts"),
    )


def shared_hashes(report: DataFrame) -> DataFrame:
    """Hashes reported by more than one application, with the number of them."""
    pairs = report.select("hash", "application_id").distinct()
    return pairs.groupBy("hash").agg(F.count(F.lit(1)).alias("applications")).filter("applications > 1")


def top_applications(summary: DataFrame, limit: int = 15) -> DataFrame:
    """Applications with the most extra records; ties by ID."""
    return summary.orderBy(F.desc("estimated_extra_records"), "application_id").limit(limit)


def large_totals(report: DataFrame) -> DataFrame:
    size = F.col("reported_hashes")
    return report.agg(
        F.count_if(size > 1000).alias("over_1000"),
        F.coalesce(F.sum(size), F.lit(0)).alias("reported"),
        F.coalesce(F.max(size), F.lit(0)).alias("largest"),
        F.count_if(size > 100000).alias("over_100000"),
    )


def largest_applications(report: DataFrame, limit: int | None = None) -> DataFrame:
    ranked = report.orderBy(F.desc("reported_hashes"), "application_id")
    return ranked if limit is None else ranked.limit(limit)


def search_text(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows whose joined columns contain the text, ignoring case."""
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    return df.filter(F.contains(joined, F.lower(F.lit(query))))


def live_counts(records: DataFrame) -> DataFrame:
    """Records, records with a hash and distinct hashes per application."""
    hash_key = F.nullif(F.col("hash_key"), F.lit(""))
    per_hash = records.groupBy("app", hash_key.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return per_hash.groupBy("app").agg(
        F.sum("n").alias("live_records"),
        F.coalesce(F.sum(F.when(F.col("h").isNotNull(), F.col("n"))), F.lit(0)).alias("live_hash_records"),
        F.count("h").alias("live_distinct_hashes"),
    )


def with_live_counts(report: DataFrame, live: DataFrame) -> DataFrame:
    """Large report rows next to the live counts of the applications inspected."""
    return report.join(live.withColumnRenamed("app", "application_id"), "application_id", "left")


def plan_counts(groups: DataFrame, targets: DataFrame) -> DataFrame:
    """Planned, verified, remaining and skipped, with the status histogram."""
    by_status = targets.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    verified = F.sum(F.when(F.col("status") == V.VERIFIED_ABSENT, F.col("n")).otherwise(0))
    totals = by_status.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("planned"),
        F.coalesce(verified, F.lit(0)).alias("verified"),
        # One entry per status value, of which there are six.
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("statuses"),
    )
    skipped = groups.agg(F.count_if(F.col("survivor").isNull()).alias("skipped_groups"))
    return one_row(totals, skipped).select(
        "planned", "verified", (F.col("planned") - F.col("verified")).alias("remaining"),
        "skipped_groups", "statuses",
    )


def status_histogram(targets: DataFrame) -> DataFrame:
    return targets.groupBy("status").agg(F.count(F.lit(1)).alias("targets"))


def run_summary(apps: DataFrame, baseline: DataFrame, groups: DataFrame, targets: DataFrame) -> DataFrame:
    """Baseline, eligible groups, planned and verified deletions per application."""
    before = baseline.groupBy("app").agg(F.count(F.lit(1)).alias("baseline_records"))
    eligible = groups.groupBy("app").agg(F.count("survivor").alias("eligible_groups"))
    planned = targets.groupBy("app").agg(
        F.count(F.lit(1)).alias("planned_deletions"),
        F.count_if(F.col("status") == V.VERIFIED_ABSENT).alias("verified_deletions"),
    )
    joined = apps.select(F.col("applicationId").alias("app"), "name", "osType")
    for part in (before, eligible, planned):
        joined = joined.join(part, "app", "left")
    joined = joined.na.fill(
        0, ["baseline_records", "eligible_groups", "planned_deletions", "verified_deletions"]
    )
    return joined.select(
        F.coalesce("name", F.lit(V.UNNAMED_APPLICATION)).alias("application"),
        F.col("app").alias("application_id"),
        os_name(F.col("osType")).alias("os"),
        "baseline_records", "eligible_groups", "planned_deletions", "verified_deletions",
        (F.col("baseline_records") - F.col("planned_deletions")).alias("expected_after_cleanup"),
        (F.col("planned_deletions") - F.col("verified_deletions")).alias("remaining_planned"),
    )


def _outcome_counts(weight: Column | None = None) -> list[Column]:
    weight = F.lit(1) if weight is None else weight

    def n(*states: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("status").isin(*states), weight)), F.lit(0)).cast("long")

    return [
        F.coalesce(F.sum(weight), F.lit(0)).cast("long").alias("total"),
        n(V.ACCEPTED, V.VERIFIED_ABSENT).alias("accepted"),
        n(V.VERIFIED_ABSENT).alias("verified"),
        n(V.PLANNED).alias("queued"),
        n(V.DISPATCHED).alias("dispatched"),
        n(V.UNCERTAIN, V.STILL_PRESENT).alias("attention"),
    ]


def deletion_progress(targets: DataFrame) -> DataFrame:
    """Outcome counts over all targets. Acceptance is not verification."""
    return targets.agg(*_outcome_counts())


def deletion_progress_by_application(targets: DataFrame) -> DataFrame:
    return targets.groupBy("app").agg(*_outcome_counts())


def progress_of_counts(counts: DataFrame) -> DataFrame:
    """The same over targets already counted: app, status, n."""
    return counts.agg(*_outcome_counts(F.col("n")))


def progress_of_counts_by_application(counts: DataFrame) -> DataFrame:
    return counts.groupBy("app").agg(*_outcome_counts(F.col("n")))


def recent_responses(events: DataFrame, targets: DataFrame, limit: int = 10) -> DataFrame:
    """Latest responses with the current status of their record.

    The few latest events are taken first, at most ``limit``. Their keys filter the
    targets before these are aggregated or moved.
    """
    latest = (
        events.filter(F.col("kind") == V.RESPONSE_EVENT)
        .select("id", "time", "app", "fid", "detail")
        .orderBy(F.desc("time"), F.desc("id"))
        .limit(limit)
    )
    few = F.broadcast(latest.select("app", "fid"))
    status = targets.select("app", "fid", "status").join(few, ["app", "fid"], "left_semi")
    return latest.join(status, ["app", "fid"], "left").select(
        "id", "time", F.col("app").alias("application_id"), F.col("fid").alias("record_id"),
        F.col("detail").alias("response"),
        F.coalesce("status", F.lit(V.UNKNOWN_STATUS)).alias("current_status"),
    )


def last_events(events: DataFrame, limit: int = 10) -> DataFrame:
    return events.orderBy(F.desc("time"), F.desc("id")).limit(limit)


def skip_reasons(groups: DataFrame) -> DataFrame:
    """Why groups were preserved or skipped."""
    return (
        groups.filter(F.col("survivor").isNull())
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("groups"))
    )


def comparison(baseline: DataFrame, targets: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """Records before and after a plan, and the reduction."""
    total = baseline.agg(F.count(F.lit(1)).alias("before"))
    removed = targets.agg(F.count(F.lit(1)).alias("removed"))
    new = (added if added is not None else targets.limit(0)).agg(F.count(F.lit(1)).alias("added"))
    joined = one_row(total, removed, new)
    after = F.col("before") - F.col("removed") + F.col("added")
    return joined.select(
        "before", "removed", "added", after.alias("after"),
        (F.col("before") - F.col("removed")).alias("preserved"),
        F.when(F.col("before") > 0, F.round((F.col("before") - after) / F.col("before"), 4)).alias("reduction"),
    )


def consolidation_progress(insertions: DataFrame, deletions: DataFrame, targets: DataFrame) -> DataFrame:
    """Replacement rules and covered deletions verified so far."""

    def verified(df: DataFrame, prefix: str) -> DataFrame:
        return df.agg(F.count_if(F.col("status") == "Verified").alias(prefix))

    planned = targets.agg(F.count(F.lit(1)).alias("targets"))
    return one_row(
        verified(insertions, "rules_verified"), verified(deletions, "deletions_verified"), planned
    )


def overview(report: DataFrame, large: DataFrame, histories: DataFrame) -> DataFrame:
    """Headline numbers over the loaded reports and runs."""
    groups = report.groupBy("application_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("applications"), F.coalesce(F.sum("n"), F.lit(0)).alias("groups")
    )
    sizes = large.agg(F.count_if(F.col("reported_hashes") > 1000).alias("over_1000"))
    runs = histories.agg(F.coalesce(F.sum("verified"), F.lit(0)).alias("verified"))
    return one_row(groups, sizes, runs)
