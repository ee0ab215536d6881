import re

import pytest
from pyspark.sql import functions as F

from fileledger.operators import dedup, reconcile
from fileledger.operators.validate import ValidationError, require
from fileledger.plans.duplicate_plan import plan_duplicates, reconcile_plan
from tests.helpers import APP, APP2, H, ORG, applications, candidates, frame, record


def plan_of(spark, rows, wanted, apps=(APP, APP2), **kw):
    return plan_duplicates(frame(spark, rows), applications(spark, *apps), candidates(spark, *wanted), ORG, **kw)


def ids(df):
    return sorted(int(r["fid"]) for r in df.select("fid").collect())


@pytest.mark.parametrize(
    "change",
    [
        {"keyFile": True}, {"fullPath": "c:/a"}, {"isHashOnly": False}, {"minSize": 0},
        {"extras": {"newMatchingField": "value"}}, {"extras": {"unknownRuleMode": "false"}},
        {"sha256": "B" * 64}, {"originalHash": "B" * 64}, {"recordType": "X"}, {"name": "x"},
        {"originalFullPath": "c:/a"}, {"isHashOnly": None},
    ],
)
def test_ambiguous_groups_are_preserved(spark, change):
    view = dedup.record_view(frame(spark, [record(1), record(2, **change)]))
    group = dedup.hash_groups(view).collect()
    assert [g["survivor"] for g in group] == [None]
    assert dedup.removal_targets(view, dedup.hash_groups(view)).count() == 0


def test_harmless_fields_do_not_matter(spark):
    rows = [record(1), record(2, sha256=H.lower(), originalHash=H, extras={"x": "", "y": None}, keyFile=None)]
    view = dedup.record_view(frame(spark, rows))
    assert ids(dedup.removal_targets(view, dedup.hash_groups(view))) == [2]


def test_lowest_numeric_id_survives_whatever_the_notes(spark):
    view = dedup.record_view(frame(spark, [record(8), record(10), record(9)]))
    groups = dedup.hash_groups(view)
    assert groups.first()["survivor"] == "8"
    assert ids(dedup.removal_targets(view, groups)) == [9, 10]


def test_invalid_hash_is_preserved(spark):
    view = dedup.record_view(frame(spark, [record(1, "invalid"), record(2, "invalid")]))
    assert dedup.removal_targets(view, dedup.hash_groups(view)).count() == 0


def test_plan_is_per_application_and_idempotent(spark):
    rows = [record(i) for i in range(1, 5)] + [record(8, "B" * 64), record(9, app=APP2)]
    plan = plan_of(spark, rows, [(APP, H), (APP2, H)])
    assert ids(plan.targets) == [2, 3, 4]
    assert {r["applicationName"] for r in plan.targets.collect()} == {"Identical name"}
    cleaned = reconcile.plan_applied(plan.baseline, plan.targets)
    assert ids(cleaned) == [1, 8, 9]
    again = dedup.hash_groups(cleaned)
    assert again.filter("survivor is not null").count() == 0


def test_absent_hash_is_skipped_and_scanned_application_adds_groups(spark):
    rows = [record(1), record(2), record(3, "B" * 64), record(4, "B" * 64)]
    plan = plan_of(spark, rows, [(APP, "C" * 64)], scan_apps=spark.createDataFrame([(APP,)], "app string"))
    reasons = {r["hash_key"]: r["survivor"] for r in plan.groups.collect()}
    assert reasons == {"C" * 64: None, H: "1", "B" * 64: "3"}


def test_seven_hundred_copies(spark):
    rows = [record(i) for i in range(1, 702)] + [record(999, "B" * 64)]
    plan = plan_of(spark, rows, [(APP, H)], apps=(APP,))
    assert ids(reconcile.plan_applied(plan.baseline, plan.targets)) == [1, 999]
    waves = dedup.removal_waves(plan.targets)
    sizes = {r["wave"]: r["count"] for r in waves.groupBy("wave").count().collect()}
    assert sizes == {**{w: 32 for w in range(21)}, 21: 28}
    ordered = [r["fid"] for r in waves.orderBy("position").collect()]
    assert ordered == [str(i) for i in range(2, 702)]


@pytest.mark.parametrize(
    "rows",
    [
        [record(1, organizationId=APP)], [record(1, applicationId=APP2.replace("3", "9"), )], [record(0)],
        [record(1), record(1)], [record("x1")], [record(1, osType=2)],
    ],
)
def test_bad_snapshots_reject_the_plan(spark, rows):
    given = frame(spark, rows).withColumn("app", F.lit(APP))
    with pytest.raises(ValidationError):
        plan_duplicates(given, applications(spark, APP), candidates(spark, (APP, H)), ORG)


def test_foreign_candidates_and_built_in_applications_reject(spark):
    foreign = candidates(spark, (APP, H)).withColumn("org", F.lit(APP2))
    with pytest.raises(ValidationError):
        plan_duplicates(frame(spark, [record(1)]), applications(spark, APP), foreign, ORG)
    built_in = applications(spark, APP).withColumn("isBuiltIn", F.lit(True))
    with pytest.raises(ValidationError):
        plan_duplicates(frame(spark, [record(1)]), built_in, candidates(spark, (APP, H)), ORG)


# --- reconciliation -----------------------------------------------------------


@pytest.fixture(scope="module")
def planned(spark):
    rows = [record(i) for i in range(1, 5)] + [record(8, "B" * 64)]
    return rows, plan_of(spark, rows, [(APP, H)], apps=(APP,))


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda rows: [dict(rows[0], notes="edited"), *rows[1:]], "changed"),
        (lambda rows: rows[1:], "disappeared"),
        (lambda rows: [*rows, record(10)], "New application records"),
        (lambda rows: rows[:1] + rows[2:], "Unsubmitted target"),
    ],
)
def test_differences_stop_the_plan(spark, planned, change, message):
    rows, plan = planned
    with pytest.raises(ValidationError, match=message):
        reconcile_plan(plan, frame(spark, change(rows)), applications(spark, APP))


def test_changed_metadata_stops_the_plan(spark, planned):
    rows, plan = planned
    with pytest.raises(ValidationError, match="metadata"):
        reconcile_plan(plan, frame(spark, rows), applications(spark, APP, os_type=2))


def test_statuses_follow_what_is_found(spark, planned):
    rows, plan = planned
    sent = plan._replace(
        targets=plan.targets.withColumn(
            "status", F.when(F.col("fid") == "2", "Dispatched").when(F.col("fid") == "3", "Accepted").otherwise("Planned")
        )
    )
    live = [r for r in rows if r["applicationFileId"] != "2"]
    targets, _ = reconcile_plan(sent, frame(spark, live), applications(spark, APP))
    found = {r["fid"]: r["status"] for r in targets.collect()}
    assert found == {"2": "VerifiedAbsent", "3": "StillPresent", "4": "Planned"}


def test_reappeared_record_is_reported(spark, planned):
    rows, plan = planned
    gone = plan._replace(targets=plan.targets.withColumn("status", F.lit("VerifiedAbsent")))
    with pytest.raises(ValidationError, match="reappeared"):
        reconcile_plan(gone, frame(spark, rows), applications(spark, APP))


def test_wave_precheck(spark, planned):
    rows, plan = planned
    live = reconcile.with_fingerprint(dedup.record_view(frame(spark, rows)).withColumn("org", F.lit(ORG)))
    same = reconcile.wave_precheck(plan.baseline, live, plan.targets, plan.groups).first()
    assert same["safe"]
    without = live.filter("fid <> '1'")
    lost = reconcile.wave_precheck(plan.baseline, without, plan.targets, plan.groups).first()
    assert (lost["unchanged"], lost["survivor_present"], lost["safe"]) == (False, False, False)


def test_inserted_rules_are_matched_once(spark):
    base = dedup.record_view(frame(spark, [record(1), record(2)])).withColumn("org", F.lit(ORG))
    rule = record(101, "", fullPath=r"c:\x\*", processPath="p", isHashOnly=False, notes="rule 1")
    live = dedup.record_view(frame(spark, [record(1), rule])).withColumn("org", F.lit(ORG))
    inserted = spark.createDataFrame(
        [(APP, 1, "rule 1", r"c:\x\*", "p", "", "")],
        "app string, rule_no int, notes string, fullPath string, processPath string, cert string, installedBy string",
    )
    deleted = spark.createDataFrame([(APP, "2", "Dispatched")], "app string, fid string, status string")
    old, new = reconcile.with_fingerprint(base), reconcile.with_fingerprint(live)
    diff, bad = reconcile.consolidation_diff(old, new, inserted, deleted)
    assert bad.count() == 0
    assert {r["fid"]: r["change"] for r in diff.collect()} == {"1": "unchanged", "2": "verified_absent"}
    _, missing = reconcile.consolidation_diff(old, new, inserted.withColumn("notes", F.lit("other")), deleted)
    assert {r["reason"] for r in missing.collect()} == {
        "Inserted rule missing or ambiguous.", "New application records detected; existing plan cannot proceed.",
    }


def counted(spark, df):
    """The rows of ``df``, and how often one of them was read."""
    reads = spark.sparkContext.accumulator(0)

    def read(row):
        reads.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(df.collect(), 2).map(read), df.schema), reads


def test_planned_groups_are_the_wanted_groups_matched(spark):
    hashes = [c * 32 for c in "ABCDEF"]
    rows = [record(f"{n}", hashes[n % 5], app=(APP, APP2)[n % 3 == 0], keyFile=n == 12) for n in range(1, 23)]
    rows += [record(100, "invalid"), record(101, "invalid"), record(102, ""), record(103, None)]
    view = dedup.record_view(frame(spark, rows)).withColumn("fid", F.when(F.col("fid") != "7", F.col("fid")))
    wanted = [(ORG, APP, hashes[0]), (ORG, APP, hashes[0]), (ORG, APP2, hashes[1]), (ORG, APP, hashes[5]), (ORG, APP2, "INVALID"),
              (APP, APP, hashes[1]), (None, APP, hashes[1]), (ORG, None, hashes[1]), (ORG, APP, None), (ORG, APP, "")]
    wanted = spark.createDataFrame(wanted, "org string, app string, hash_key string")
    groups = dedup.hash_groups(view)
    for apps in (None, [], [APP], [APP, APP2, APP, None]):
        scan = None if apps is None else spark.createDataFrame([(a,) for a in apps], "app string")
        expected = dedup.match_candidates(dedup.wanted_groups(wanted, groups, scan), groups)
        found = dedup.planned_groups(view, wanted, scan)
        assert found.columns == expected.columns
        assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))


def test_a_plan_reads_the_records_once_for_its_groups(spark):
    records, reads = counted(spark, frame(spark, [record(i) for i in range(1, 11)]))
    scan = spark.createDataFrame([(APP,)], "app string")
    plan = plan_duplicates(records, applications(spark, APP), candidates(spark, (APP, H)), ORG, scan, validate=False)
    assert plan.groups.first()["survivor"] == "1"
    assert reads.value == 10


def test_a_valid_input_is_looked_through_at_once(spark):
    found = spark.range(0, 100, 1, 50).filter("id < 0").selectExpr("'bad' as reason", "string(id) as key")
    spark.sparkContext.setJobGroup("looked-through", "")
    require(found)
    spark.sparkContext.setJobGroup("others", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("looked-through")) <= 2
    with pytest.raises(ValidationError, match=r"bad \(1\)"):
        require(spark.range(1, 9).selectExpr("'bad' as reason", "string(id) as key"))


def sorts(df):
    """Columns by which the physical plan sorts, first ones first."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", found) for found in re.findall(r"Sort \[(\w+#\d+|coalesce\(\w+#\d+)", plan)]


def test_groups_are_sorted_by_hash_first(spark):
    view = dedup.record_view(frame(spark, [record(1), record(2), record(3, app=APP2)]))
    groups = dedup.hash_groups(view)
    matched = dedup.planned_groups(view, candidates(spark, (APP, H), (APP2, H)))
    targets = dedup.removal_targets(view, matched.hint("merge"))
    for df in (groups, matched):
        assert set(sorts(df)) == {"hash_key"}
    assert "coalesce(hash_key" in sorts(targets) and not {"coalesce(org", "coalesce(app"} & set(sorts(targets))
    assert groups.columns[:3] == dedup.GROUP_KEYS and ids(targets) == [2]


def test_the_hash_of_a_record_is_found_once(spark):
    raw = frame(spark, [record(1, H.lower()), record(2, "", originalHash=H), record(3, None), record(4, " x ")])
    view = dedup.record_view(raw)
    assert [tuple(r) for r in view.orderBy("fid").select("hash_key", "plain").collect()] == [(H, True), (H, True), ("", False), ("X", False)]
    assert view.columns == [*raw.columns, "fid", "id_num", "hash_key", "plain", "app", "org"]
    plan = view.select("hash_key", "plain")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("btrim") <= 1 and "lambda" not in plan.split("map_filter")[0]


def test_a_comparison_sorts_records_by_id_first(spark, planned):
    rows, plan = planned
    current = reconcile.with_fingerprint(dedup.record_view(frame(spark, rows)))
    diff = reconcile.snapshot_diff(plan.baseline, current, plan.targets)
    assert "fid" in sorts(diff) and "app" not in sorts(diff)
    assert diff.columns == ["app", "fid", "previous_status", "change", "status"]


def test_an_applied_plan_sorts_records_by_id_first(spark, planned):
    _, plan = planned
    cleaned = reconcile.plan_applied(plan.baseline, plan.targets.hint("merge"))
    assert "fid" in sorts(cleaned) and "app" not in sorts(cleaned)
    assert cleaned.columns == ["app", "fid", *[c for c in plan.baseline.columns if c not in ("app", "fid")]]


def test_a_wave_check_sorts_records_by_hash_first(spark, planned):
    _, plan = planned
    groups = dedup.hash_groups(plan.baseline)
    found = reconcile.wave_precheck(plan.baseline, plan.baseline, plan.targets, groups)
    assert "hash_key" in sorts(found) and "app" not in sorts(found)
    assert found.columns == ["app", "hash_key", "unchanged", "survivor_present", "still_plain", "safe"]
    assert found.filter("safe").count() == found.count() == 1
