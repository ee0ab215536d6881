"""One query per operator group, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileledger.functions import paths as P
from fileledger.functions import text as T
from fileledger.functions.hashes import all_hashes
from fileledger.operators import dedup, insights, pairs, reconcile, requested, rules
from fileledger.operators.parsing import apply_parsing, parse_notes
from fileledger.operators.skew import with_position
from fileledger.operators.validate import record_violations
from fileledger.plans import consolidation_plan, history
from fileledger.plans.duplicate_plan import DuplicatePlan, plan_duplicates
from fileledger.session import cut_lineage
from fileledger.settings import profile_settings
from fileledger.sources.reports import duplicate_report, large_report, requested_hashes
from fileledger.sources.snapshots import find_applications
from fileledger.streaming.progress import latest_statuses
from workload import views

Query = Callable[[SparkSession, str], DataFrame]


# --- duplicates ----------------------------------------------------------------


def _report(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_report(views.report_rows(spark, sf), views.ORG).rows


def _plan(spark: SparkSession, sf: str, validate: bool = False) -> DuplicatePlan:
    candidates = _report(spark, sf).select(
        F.col("organization_id").alias("org"), F.col("application_id").alias("app"), F.col("hash").alias("hash_key")
    )
    apps = cut_lineage(views.applications(spark, sf))
    scan = apps.filter("name = '1-URGENT'").select(F.col("applicationId").alias("app"))
    return plan_duplicates(views.records(spark, sf), apps, candidates, views.ORG, scan, validate=validate)


def duplicate_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Removal targets of a validated plan over a report and one scanned application."""
    return _plan(spark, sf, validate=True).targets.select(
        "app", "fid", F.col("hash_key").alias("hash"), "status", "applicationName", "osType"
    )


def duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf).groups.select(
        "app", F.col("hash_key").alias("hash"), F.coalesce("members", F.lit(0)).alias("members"), "survivor", "reason"
    )


def group_preview(spark: SparkSession, sf: str) -> DataFrame:
    plan = _plan(spark, sf)
    return dedup.group_preview(plan.groups, plan.targets).select(
        "app", F.col("hash_key").alias("hash"), "survivor", "deletions"
    )


def removal_waves(spark: SparkSession, sf: str) -> DataFrame:
    """Bounded waves over few, large groups: one per application and order status."""
    orders = views.table(spark, sf, "orders").select(
        F.lit(views.ORG).alias("org"), views.app_id(F.col("o_orderpriority")).alias("app"),
        views.text_hash(F.col("o_orderstatus")).alias("hash_key"),
        (F.col("o_orderkey") + 1).cast("string").alias("fid"),
    )
    return dedup.removal_waves(orders).select(
        "app", F.col("hash_key").alias("hash"), "fid", F.col("position").cast("long").alias("position"), "wave"
    )


def text_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose whole text repeats within a language."""
    documents = views.table(spark, sf, "documents").select(
        F.lit(views.ORG).alias("organizationId"), F.col("lang").alias("app"),
        F.col("lang").alias("applicationId"), F.col("doc_id").cast("string").alias("applicationFileId"),
        F.upper(F.md5("text")).alias("hash"), F.lit(True).alias("isHashOnly"),
    )
    view = dedup.record_view(documents)
    return dedup.removal_targets(view, dedup.hash_groups(view)).select(
        "app", "fid", F.col("hash_key").alias("hash")
    )


# --- report summaries -------------------------------------------------------------


def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).select("application_id", "hash", "name", "count")


def report_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_report(views.report_rows(spark, sf), views.ORG).repeated


def report_summary(spark: SparkSession, sf: str) -> DataFrame:
    return insights.report_by_application(_report(spark, sf))


def report_totals(spark: SparkSession, sf: str) -> DataFrame:
    return insights.report_totals(_report(spark, sf))


def shared_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return insights.shared_hashes(_report(spark, sf))


def top_applications(spark: SparkSession, sf: str) -> DataFrame:
    """Applications with the most extra records, from a report per customer."""
    by_customer = views.table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(
        F.count(F.lit(1)).cast("string").alias("count")
    )
    rows = by_customer.select(
        F.lit(views.ORG).alias("organizationid"), views.app_id(F.col("o_custkey").cast("string")).alias("applicationid"),
        views.text_hash(F.col("o_custkey"), F.col("o_orderstatus")).alias("hash"),
        F.concat(F.lit("Customer "), F.col("o_custkey")).alias("name"), "count", F.lit(1).alias("_order"),
    )
    return insights.top_applications(insights.report_by_application(duplicate_report(rows, views.ORG).rows))


def large_app_totals(spark: SparkSession, sf: str) -> DataFrame:
    return insights.large_totals(large_report(views.size_report_rows(spark, sf), views.ORG).rows)


def largest_applications(spark: SparkSession, sf: str) -> DataFrame:
    report = large_report(views.size_report_rows(spark, sf), views.ORG).rows
    return insights.largest_applications(report, 12)


def application_search(spark: SparkSession, sf: str) -> DataFrame:
    report = large_report(views.size_report_rows(spark, sf), views.ORG).rows
    return insights.search_text(report, "CUSTOMER 1", "application", "application_id")


def application_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Custom Windows applications by name, from a supplier dimension."""
    suppliers = views.table(spark, sf, "supplier").select(
        views.app_id(F.col("s_name")).alias("applicationId"), F.lit(views.ORG).alias("organizationId"),
        F.col("s_name").alias("name"), F.when(F.col("s_acctbal") < 0, 2).otherwise(1).alias("osType"),
        (F.col("s_acctbal") > 9000).alias("isBuiltIn"),
    )
    return find_applications(suppliers, " supplier#00000000", 1, views.ORG)


def live_counts(spark: SparkSession, sf: str) -> DataFrame:
    return insights.live_counts(dedup.record_view(views.records(spark, sf)))


# --- plans and outcomes -------------------------------------------------------------


def _statuses(targets: DataFrame) -> DataFrame:
    return targets.withColumn("status", views.state_of(F.col("fid").cast("long")))


def plan_counts(spark: SparkSession, sf: str) -> DataFrame:
    plan = _plan(spark, sf)
    return insights.plan_counts(plan.groups, _statuses(plan.targets)).drop("statuses")


def status_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return insights.status_histogram(_statuses(_plan(spark, sf).targets))


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    plan = _plan(spark, sf)
    return insights.run_summary(plan.applications, plan.baseline, plan.groups, _statuses(plan.targets))


def skip_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return insights.skip_reasons(_plan(spark, sf).groups)


def before_after(spark: SparkSession, sf: str) -> DataFrame:
    plan = _plan(spark, sf)
    return insights.comparison(plan.baseline, plan.targets)


def plan_applied(spark: SparkSession, sf: str) -> DataFrame:
    plan = _plan(spark, sf)
    return reconcile.plan_applied(plan.baseline, plan.targets).select("app", "fid", F.col("hash_key").alias("hash"))


def replan_after_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Groups that would still be planned on the cleaned table, per reason."""
    plan = _plan(spark, sf)
    cleaned = reconcile.plan_applied(plan.baseline, plan.targets)
    groups = dedup.hash_groups(cleaned)
    return groups.groupBy("reason").agg(
        F.count(F.lit(1)).alias("groups"), F.count("survivor").alias("planned_groups")
    )


def _diff_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    plan = _plan(spark, sf)
    current = dedup.record_view(views.records_now(spark, sf)).withColumn("org", F.lit(views.ORG))
    return plan.baseline, reconcile.with_fingerprint(current), _statuses(plan.targets)


def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.snapshot_diff(*_diff_inputs(spark, sf))


def reconcile_violations(spark: SparkSession, sf: str) -> DataFrame:
    diff = reconcile.snapshot_diff(*_diff_inputs(spark, sf))
    return reconcile.diff_violations(diff).groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


def wave_precheck(spark: SparkSession, sf: str) -> DataFrame:
    baseline, current, targets = _diff_inputs(spark, sf)
    groups = dedup.hash_groups(baseline)
    return reconcile.wave_precheck(baseline, current, targets, groups).withColumnRenamed("hash_key", "hash")


def validation_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected rows of a snapshot read for the wrong system or with repeated IDs."""
    rows = views.records(spark, sf).withColumn("app", F.col("applicationId"))
    rows = rows.withColumn("osType", F.when(F.col("keyFile"), 2).otherwise(0))
    repeated = rows.unionByName(rows.filter("keyFile"))
    apps = views.applications(spark, sf)
    return record_violations(repeated, apps, views.ORG).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def outcome_progress(spark: SparkSession, sf: str) -> DataFrame:
    return insights.deletion_progress_by_application(latest_statuses(views.outcome_events(spark, sf)))


def outcome_totals(spark: SparkSession, sf: str) -> DataFrame:
    return insights.deletion_progress(latest_statuses(views.outcome_events(spark, sf)))


def recent_responses(spark: SparkSession, sf: str) -> DataFrame:
    events = views.outcome_events(spark, sf)
    return insights.recent_responses(events, latest_statuses(events))


def run_history(spark: SparkSession, sf: str) -> DataFrame:
    """One run per supplier with the line items it was asked to remove."""
    suppliers = views.table(spark, sf, "supplier")
    items = views.table(spark, sf, "lineitem")
    runs = suppliers.select(
        F.col("s_suppkey").cast("string").alias("run_id"),
        F.when(F.col("s_nationkey") < 12, history.DUPLICATES).otherwise(history.CONSOLIDATION).alias("workflow"),
        F.when(F.col("s_acctbal") > 0, "Complete").alias("phase"), F.col("s_acctbal").alias("created"),
        F.lit(views.ORG).alias("org"), F.lit("a").alias("instance"),
        F.when(F.col("s_nationkey") == 3, "other").otherwise("me").alias("user_instance"),
    )
    run_apps = items.select(
        F.col("l_suppkey").cast("string").alias("run_id"), F.col("l_returnflag").alias("app"),
        F.concat(F.lit("App "), F.col("l_returnflag")).alias("name"),
    ).distinct()
    targets = items.select(
        F.col("l_suppkey").cast("string").alias("run_id"),
        F.when(F.col("l_linestatus") == "F", "VerifiedAbsent").otherwise("Planned").alias("status"),
    )
    return history.run_history(runs, run_apps, targets, views.ORG, "a", "me")


# --- requested hashes --------------------------------------------------------------


def _requested(spark: SparkSession, sf: str) -> requested.RequestedPlan:
    wanted = requested_hashes(views.requested_rows(spark, sf)).rows
    return requested.requested_plan(dedup.record_view(views.records(spark, sf)), wanted)


def requested_match(spark: SparkSession, sf: str) -> DataFrame:
    return _requested(spark, sf).targets


def requested_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return _requested(spark, sf).unmatched.select("app", "hash", "os", "kind")


def requested_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _requested(spark, sf).counts


def requested_preview(spark: SparkSession, sf: str) -> DataFrame:
    wanted = requested_hashes(views.requested_rows(spark, sf)).rows
    plan = requested.requested_plan(dedup.record_view(views.records(spark, sf)), wanted)
    return requested.application_preview(wanted, plan.targets)


def recovered_targets(spark: SparkSession, sf: str) -> DataFrame:
    now = dedup.record_view(views.records_now(spark, sf))
    return requested.recover_targets(_requested(spark, sf).targets, now)[0].select("app", "fid", "hash", "status")


# --- text and paths -----------------------------------------------------------------


def note_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Every field of part notes, page notes and whole documents."""
    parsed = parse_notes(views.free_notes(spark, sf), "notes", "")
    return parsed.drop("notes")


def usable_notes(spark: SparkSession, sf: str) -> DataFrame:
    notes = views.free_notes(spark, sf)
    return notes.select("note_id", T.usable_note(F.col("notes")).alias("usable"))


def path_normalize(spark: SparkSession, sf: str) -> DataFrame:
    raw = views.mixed_paths(spark, sf)
    staged = raw.withColumn("path", P.normalize_path(F.col("raw")))
    path = F.col("path")
    return staged.select(
        "raw", "path", P.wildcard_user_profile(path).alias("profile"), P.shorten_leaf(path).alias("leaf"),
        P.extension(path).alias("extension"), P.basename(path).alias("base"),
        P.macos_target_path(path).alias("target"),
    )


def version_collapse(spark: SparkSession, sf: str) -> DataFrame:
    staged = views.mixed_paths(spark, sf).select(P.normalize_path(F.col("raw")).alias("path")).distinct()
    path = F.col("path")
    return staged.select("path", P.collapse_versions(path).alias("collapsed"), P.volatile_shape(path).alias("shape"))


def path_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Grouping key and wildcard suggestion of each path under the balanced profile."""
    staged = views.mixed_paths(spark, sf).select(P.normalize_path(F.col("raw")).alias("path")).distinct()
    keyed = pairs.with_path_condition(staged, "path", "path", profile_settings("balanced"), wildcard=True)
    return keyed.select("path", F.col("path_key").alias("head"), F.col("path_wc").alias("wildcard"))


def certificate_vendors(spark: SparkSession, sf: str) -> DataFrame:
    parts = views.table(spark, sf, "part")
    names = parts.select(F.concat(F.lit("CN="), F.col("p_name"), F.lit("; O= "), F.col("p_type"), F.lit(" Inc.")).alias("certificate"))
    plain = parts.select(F.upper(F.concat("p_name", F.lit("  "), "p_brand")).alias("certificate"))
    both = names.unionByName(plain).distinct()
    value = F.col("certificate")
    return both.select(
        "certificate", T.certificate_vendor(value).alias("vendor"), T.certificate_condition(value).alias("condition")
    )


def record_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct hashes of each customer's records as a sorted list."""
    customers = views.table(spark, sf, "customer")
    name = F.md5("c_name")
    values = all_hashes(name, F.upper(name), F.lit(""), F.md5("c_mktsegment"))
    return customers.select("c_custkey", F.concat_ws(",", F.array_sort(values)).alias("hashes"))


# --- rules ----------------------------------------------------------------------------


def observation_rows(spark: SparkSession, sf: str) -> DataFrame:
    return apply_parsing(views.observations(spark, sf)).select(
        "row_id", "path", "process_path", "certificate_primary", "created_by", "md5_hash", "hostname",
        "timestamp_utc", "wildcard_path", "condition_count", "row_fingerprint",
    )


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    parsed = apply_parsing(views.observations(spark, sf))
    return pairs.candidate_pairs(parsed, profile_settings("balanced"), "row_id")


def candidate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).drop("span")


def pair_export(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.pair_export(_pairs(spark, sf))


def base_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Pair rules and merged siblings before families are built."""
    rows = rules.base_rules(cut_lineage(_pairs(spark, sf)), profile_settings("balanced"))
    return rows.select("path", "process_path", "certificate", "created_by", "rule_type", "source_rows")


def rules_final(spark: SparkSession, sf: str) -> DataFrame:
    """Final rules of the balanced profile, numbered in rule order."""
    found = rules.final_rules(cut_lineage(_pairs(spark, sf)), profile_settings("balanced"))
    return rules.ranked_rules(found).select(
        "path", "certificate", "process_path", "created_by", F.col("rule_rank").cast("long").alias("rule_rank")
    )


def rule_suppression(spark: SparkSession, sf: str) -> DataFrame:
    numbered = views.rule_set(spark, sf).withColumn(
        "ord", rules.rule_order(0, rules.nulls_last(F.col("level").cast("string"), F.col("path")))
    ).drop("level")
    return rules.suppress_covered(numbered, ["app"]).drop("ord")


def rule_risk(spark: SparkSession, sf: str) -> DataFrame:
    return rules.risk_review(views.risky_rules(spark, sf))


def dangerous_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that survive the danger filter and the high-risk process gate."""
    kept = rules.filter_dangerous(views.risky_rules(spark, sf))
    return rules.enforce_high_risk(kept, profile_settings("balanced"))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.asc("level"), F.asc("path"), F.asc_nulls_last("certificate"), F.asc_nulls_last("process_path")]
    return with_position(views.rule_set(spark, sf), order, "rule_rank", keys=["app"]).drop("level")


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    """Observations without those of key files."""
    return consolidation_plan.observed_records(views.flagged_records(spark, sf))


def rule_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Covered records of every rule, with the decision and its reasons."""
    observed = consolidation_plan.observed_records(views.observation_records(spark, sf))
    return consolidation_plan.assign_rules(observed, _ranked(spark, sf)).reviews


def rule_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """The accepted rule of every covered record."""
    plan = consolidation_plan.assign_rules(_observed(spark, sf), _ranked(spark, sf))
    return plan.assignments.select("app", "fid", F.col("rule_rank").cast("long").alias("rule_rank"))


def consolidation_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Whole consolidation per application: mine rules from notes, measure and accept them."""
    plan = consolidation_plan.plan_consolidation(views.observation_records(spark, sf), "conservative")
    return plan.reviews


# --- operators over less usual rows ----------------------------------------------------


def long_id_waves(spark: SparkSession, sf: str) -> DataFrame:
    """Waves over identifiers that are short, padded, or longer than any number type holds."""
    key = F.col("o_orderkey") + 1
    fid = F.when(key % 3 == 0, key.cast("string")).when(key % 3 == 1, F.concat(F.lit("000"), key)).otherwise(
        F.concat(F.lit("1"), F.lpad(key.cast("string"), 44, "0"))
    )
    orders = views.table(spark, sf, "orders").select(
        F.lit(views.ORG).alias("org"), views.app_id(F.col("o_orderpriority")).alias("app"),
        views.text_hash(F.col("o_orderstatus")).alias("hash_key"), fid.alias("fid"), F.col("o_totalprice").alias("price"),
    )
    return dedup.removal_waves(orders, 20).select(
        "app", F.col("hash_key").alias("hash"), "fid", F.col("position").cast("long").alias("position"), "wave", "price"
    )


def unknown_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of records of which some carry a filled column that the library does not know."""
    tagged = views.records(spark, sf).withColumn("customTag", F.when(F.endswith("notes", F.lit("-15")), F.col("notes")))
    groups = dedup.hash_groups(dedup.record_view(tagged))
    return groups.select("app", F.col("hash_key").alias("hash"), "members", "survivor", "reason")


def padded_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers that repeat but for leading zeros."""
    rows = views.records(spark, sf).withColumn("app", F.col("applicationId"))
    padded = rows.filter(F.endswith("notes", F.lit("-15"))).withColumn("applicationFileId", F.concat(F.lit("00"), "applicationFileId"))
    found = record_violations(rows.unionByName(padded), views.applications(spark, sf), views.ORG)
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def insertion_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Each inserted rule among new records: found, missing, doubled, changed or narrowed."""
    return reconcile.match_insertions(views.inserted_records(spark, sf), views.insertions(spark, sf)).select(
        "app", "rule_no", "fid", "problem"
    )


def consolidation_difference(spark: SparkSession, sf: str) -> DataFrame:
    """What a consolidation run changed, and what of it stops the run."""
    baseline = reconcile.with_fingerprint(views.flagged_records(spark, sf))
    part = F.col("fid").cast("long") - 1
    inserted = dedup.record_view(views.inserted_records(spark, sf).drop("app", "fid"))
    kept = baseline.filter(~(part % 10).isin(0, 4, 5, 7)).drop("fingerprint")
    current = reconcile.with_fingerprint(kept.unionByName(inserted, allowMissingColumns=True))
    status = F.when((part % 10).isin(0, 3), "Verified").when((part % 10).isin(2, 5), "Dispatched").when((part % 10).isin(1, 4), "Planned")
    deletions = baseline.select("app", "fid", status.alias("status")).filter("status IS NOT NULL")
    # The fingerprint covers the columns both have.
    common = [c for c in baseline.columns if c in current.columns]
    baseline = reconcile.with_fingerprint(baseline.select(*common).drop("fingerprint"))
    diff, bad = reconcile.consolidation_diff(baseline, current, views.insertions(spark, sf), deletions)
    changes = diff.groupBy(F.col("change").alias("what")).agg(F.count(F.lit(1)).alias("records"))
    return changes.unionByName(bad.groupBy(F.col("reason").alias("what")).agg(F.count(F.lit(1)).alias("records")))


def replacement_records(spark: SparkSession, sf: str) -> DataFrame:
    """Rules as the records they would be inserted as."""
    return consolidation_plan.replacement_records(_ranked(spark, sf), "r1", views.ORG).select(
        "app", "hash", "isHashOnly", "keyFile", "notes", "fullPath", "processPath", "cert"
    )


def application_health(spark: SparkSession, sf: str) -> DataFrame:
    """Reported sizes of large applications next to their live records."""
    live = views.table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(
        views.app_id(F.col("o_custkey").cast("string")).alias("app"),
        F.when(F.col("o_totalprice") > 50000, views.text_hash(F.col("o_orderpriority"))).alias("hash_key"),
    )
    report = large_report(views.size_report_rows(spark, sf), views.ORG).rows
    return insights.with_live_counts(report, insights.live_counts(live)).select(
        "application_id", "application", "reported_hashes", "live_records", "live_hash_records", "live_distinct_hashes"
    )


def consolidation_progress(spark: SparkSession, sf: str) -> DataFrame:
    items = views.table(spark, sf, "lineitem")
    status = F.when(F.col("l_linestatus") == "F", "Verified").otherwise("Dispatched").alias("status")
    rules_ = views.table(spark, sf, "supplier").select(F.when(F.col("s_acctbal") > 0, "Verified").alias("status"))
    return insights.consolidation_progress(rules_, items.filter("l_quantity < 25").select(status), items.select(status))


def overview(spark: SparkSession, sf: str) -> DataFrame:
    """Headline numbers over the report, the large applications and the runs."""
    large = large_report(views.size_report_rows(spark, sf), views.ORG).rows
    return insights.overview(_report(spark, sf), large, run_history(spark, sf))


def selective_presence(spark: SparkSession, sf: str) -> DataFrame:
    """Planned targets that a later snapshot still holds under their hash."""
    now = dedup.record_view(views.records_now(spark, sf))
    return requested.selective_presence(_requested(spark, sf).targets, now).select("app", "fid", "hash")


def dropped_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Mined rules that a path-only family takes along, with the family, for review."""
    observed = cut_lineage(_observed(spark, sf))
    settings = profile_settings("conservative").for_consolidation()
    return consolidation_plan.mine_rules(observed, settings)[1]


def queries() -> dict[str, Query]:
    names = [
        duplicate_plan, duplicate_groups, group_preview, removal_waves, text_duplicates, report_rows,
        report_repeats, report_summary, report_totals, shared_hashes, top_applications, large_app_totals,
        largest_applications, application_search, application_lookup, live_counts, plan_counts,
        status_histogram, run_summary, skip_reasons, before_after, plan_applied, replan_after_apply,
        snapshot_diff, reconcile_violations, wave_precheck, validation_report, outcome_progress,
        outcome_totals, recent_responses, run_history, requested_match, requested_unmatched,
        requested_counts, requested_preview, recovered_targets, note_parse, usable_notes, path_normalize,
        version_collapse, path_heads, certificate_vendors, record_hashes, observation_rows, candidate_pairs,
        pair_export, base_rules, rules_final, rule_suppression, rule_risk, dangerous_filter, rule_coverage,
        rule_assignment, consolidation_rules, dropped_rules, long_id_waves, unknown_fields, padded_ids,
        insertion_matches, consolidation_difference, replacement_records, application_health,
        consolidation_progress, overview, selective_presence,
    ]
    return {q.__name__: q for q in names}
