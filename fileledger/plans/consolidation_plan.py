"""The consolidation plan: replace plain hash records by reviewed conditional rules."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger import fixed_values as V
from fileledger.functions.hashes import id_order
from fileledger.functions.text import trimmed, usable_note
from fileledger.operators import coverage, dedup, pairs, rules
from fileledger.operators.parsing import (
    apply_parsing, combined_review, parse_notes, refine_observations,
)
from fileledger.operators.skew import null_safe_join, unestimated
from fileledger.session import cut_lineage
from fileledger.settings import RuleSettings, profile_settings


class RuleOutputs(NamedTuple):
    parsed: DataFrame
    combined_review: DataFrame
    candidate_pairs: DataFrame
    pair_export: DataFrame
    final_rules: DataFrame
    risk_review: DataFrame
    dropped_rules: DataFrame


class ConsolidationPlan(NamedTuple):
    rules: DataFrame
    assignments: DataFrame
    targets: DataFrame
    fallback: DataFrame
    reviews: DataFrame
    #: Mined rules lost with a path-only family: for review, never applied.
    dropped: DataFrame | None = None


def build_outputs(
    observations: DataFrame, settings: RuleSettings, order: str, by: Sequence[str] = ()
) -> RuleOutputs:
    """All tables of a rule-mining run over an observation frame."""
    parsed = cut_lineage(apply_parsing(observations))
    candidates = cut_lineage(pairs.candidate_pairs(parsed, settings, order, by))
    final, dropped = rules.rule_chain(candidates, settings, by)
    final = cut_lineage(final)
    return RuleOutputs(
        parsed, combined_review(parsed), candidates.drop("span"), pairs.pair_export(candidates, by),
        rules.ranked_rules(final, by), rules.risk_review(final, by), dropped,
    )


def observed_records(records: DataFrame) -> DataFrame:
    """Eligible records with the four condition values their notes state.

    ``records`` is a ``record_view``. A record is eligible when it is a plain
    hash and its note names at most one target path.
    """
    eligible = records.filter(F.col("plain") & usable_note(F.col("notes")))
    parsed = parse_notes(eligible.select("app", "fid", "hash", "notes"))
    return parsed.select(
        "app", "fid", "hash", "notes",
        F.col("note_path").alias("path"),
        F.col("note_certificate_primary").alias("certificate"),
        F.col("note_process_path").alias("process_path"),
        F.col("note_created_by").alias("created_by"),
        F.col("note_md5_hash").alias("md5_hash"),
        F.col("note_sha256_hash").alias("sha256_hash"),
    )


def mine_rules(observed: DataFrame, settings: RuleSettings) -> tuple[DataFrame, DataFrame]:
    """Ranked candidate rules per application from eligible records, and the rules dropped with families."""
    own = F.col("hash")
    parsed = refine_observations(
        observed.select(
            "app", id_order(F.col("fid")).alias("id_order"), "notes", "path", "process_path", "created_by",
            F.col("certificate").alias("certificate_primary"),
            F.coalesce("md5_hash", F.when(F.length(own) == 32, own)).alias("md5_hash"),
            F.coalesce("sha256_hash", F.when(F.length(own) == 64, own)).alias("sha256_hash"),
            F.lit(1).cast("long").alias("count"),
        )
    )
    candidates = cut_lineage(pairs.candidate_pairs(parsed, settings, "id_order", ["app"]))
    final, dropped = rules.rule_chain(candidates, settings, ["app"])
    return rules.ranked_rules(final, ["app"]), dropped


def assign_rules(observed: DataFrame, candidates: DataFrame, windows: bool = True) -> ConsolidationPlan:
    """Measure every candidate rule, accept in order, and give each record its rule."""
    is_windows = F.lit(windows)
    by = ["app"]
    observed = cut_lineage(observed)
    candidates = cut_lineage(candidates)
    values = coverage.distinct_condition_values(observed, by)
    edges = cut_lineage(coverage.coverage_edges(values, candidates, by, ignore_case=windows))

    reasons = coverage.static_reasons(is_windows)
    static = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(r)) for r, bad in reasons.items()]))
    screened = candidates.withColumn("_static", static)
    usable = screened.filter((F.size("_static") == 0) & is_windows).select(*by, "rule_rank")
    open_edges = null_safe_join(unestimated(edges), usable, [*by, "rule_rank"])
    accepted, _ = coverage.accept_rules(open_edges, by)
    accepted = cut_lineage(accepted)
    assignment = cut_lineage(coverage.first_accepted(open_edges, accepted, by))

    counted = coverage.new_coverage(edges, assignment, by)
    reviews = null_safe_join(unestimated(screened), counted, [*by, "rule_rank"], "left")
    reviews = reviews.na.fill(0, ["covered", "new_records"]).withColumn(
        "_reasons",
        F.concat(
            F.col("_static"),
            F.array_compact(
                F.array(
                    F.when(F.col("new_records") < 2, F.lit(V.REJECT_COVERAGE)),
                    F.when(~is_windows, F.lit(V.REJECT_MACOS)),
                )
            ),
        ),
    )
    rejected = F.size("_reasons") > 0
    reviews = reviews.select(
        *by, "rule_rank", *rules.CONDITIONS,
        F.col("covered").alias("covered_observations"),
        F.when(rejected, V.STATUS_REJECTED).otherwise(V.STATUS_REVIEW).alias("status"),
        F.when(rejected, F.concat_ws("; ", "_reasons")).otherwise(V.REVIEW_REASON).alias("reason"),
    )
    # Copies of an observation share its rule.
    matched = unestimated(values).join(assignment, [*by, "obs_id"]).select(*by, *rules.CONDITIONS, "rule_rank")
    assignments = null_safe_join(unestimated(observed), matched, [*by, *rules.CONDITIONS]).select(*by, "fid", "rule_rank")
    chosen = null_safe_join(unestimated(candidates), accepted, [*by, "rule_rank"], "left_semi")
    return ConsolidationPlan(chosen, assignments, assignments.select(*by, "fid"), observed, reviews)


def plan_consolidation(
    records: DataFrame, profile: str = "conservative", os_type: int = 1
) -> ConsolidationPlan:
    """Rules, targets, preserved records and reviews for every application of a snapshot."""
    view = records if "plain" in records.columns else dedup.record_view(records)
    observed = cut_lineage(observed_records(view))
    settings = profile_settings(profile).for_consolidation()
    mined, dropped = mine_rules(observed, settings)
    plan = assign_rules(observed, mined, os_type == 1)
    targets = unestimated(view).join(plan.targets, ["app", "fid"], "left_semi")
    fallback = unestimated(view).join(plan.targets, ["app", "fid"], "left_anti")
    return plan._replace(targets=targets, fallback=fallback, dropped=dropped)


def replacement_records(rules_: DataFrame, run: str, organization: str, os_type: int = 1) -> DataFrame:
    """Accepted rules as records of the application, as they would be inserted."""
    return rules_.select(
        "app",
        F.col("app").alias("applicationId"),
        F.lit(organization).alias("organizationId"),
        F.lit(os_type).alias("osType"),
        F.lit("").alias("hash"),
        F.lit(False).alias("keyFile"),
        F.lit(False).alias("isHashOnly"),
        F.concat(F.lit(f"Consolidation {run} rule "), F.col("rule_rank").cast("string")).alias("notes"),
        trimmed(F.col("path")).alias("fullPath"),
        trimmed(F.col("process_path")).alias("processPath"),
        trimmed(F.col("certificate")).alias("cert"),
        trimmed(F.col("created_by")).alias("installedBy"),
    )
