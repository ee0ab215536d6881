"""Saved runs: their tables on disk and one history over both workflows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger import fixed_values as V

DUPLICATES, CONSOLIDATION = "Duplicate hashes", "Conditional rules"


def run_history(
    runs: DataFrame,
    run_apps: DataFrame,
    targets: DataFrame,
    organization: str,
    instance: str = "",
    user_instance: str = "",
) -> DataFrame:
    """One row per saved run of the given scope.

    ``runs``: run_id, workflow, phase, created, org, instance, user_instance.
    ``run_apps``: run_id, app, name. ``targets``: run_id, status, where a
    consolidation run marks verified removals ``Verified``. Runs of another
    scope or without a phase are not listed.
    """
    scoped = runs.filter(
        (F.col("org") == organization)
        & (F.col("instance") == instance)
        & (F.col("user_instance") == user_instance)
    )
    counts = targets.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("planned"),
        F.count_if(F.col("status").isin(V.VERIFIED_ABSENT, "Verified")).alias("verified"),
    )
    # A run lists each application it was started for once, however often it is repeated.
    apps = run_apps.groupBy("run_id").agg(
        F.sort_array(F.collect_set(F.struct("app", F.coalesce("name", F.lit("")).alias("name")))).alias("_apps")
    )
    joined = scoped.join(counts, "run_id", "left").join(apps, "run_id", "left")
    return joined.select(
        F.col("run_id").alias("run"),
        "workflow",
        F.coalesce("phase", F.lit("Preview")).alias("status"),
        F.coalesce(F.array_join("_apps.name", ", "), F.lit("")).alias("application"),
        F.coalesce(F.array_join("_apps.app", ", "), F.lit("")).alias("application_ids"),
        F.coalesce("planned", F.lit(0)).alias("planned"),
        F.coalesce("verified", F.lit(0)).alias("verified"),
        F.coalesce("created", F.lit(0.0)).alias("created"),
    )


def newest_first(history: DataFrame) -> DataFrame:
    return history.orderBy(F.desc("created"), "run")


def find_runs(history: DataFrame, query: str = "", workflow: str = "All") -> DataFrame:
    """Runs whose name, application or IDs contain the text."""
    text = F.lower(F.concat_ws(" ", "run", "application", "application_ids"))
    found = history.filter(F.contains(text, F.lower(F.lit(query))))
    return found if workflow == "All" else found.filter(F.col("workflow") == workflow)
