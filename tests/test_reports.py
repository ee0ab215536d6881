import json

import pytest
from pyspark.sql import functions as F

from fileledger.operators import insights, requested
from fileledger.operators.dedup import record_view
from fileledger.operators.validate import ValidationError
from fileledger.sources import files, reports, snapshots
from tests.helpers import APP, APP2, H, ORG, applications, frame, record


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def row(app=APP, hash_=H, org=ORG, **kw):
    return {"OrganizationId": org, "ApplicationId": app, "Hash": hash_, "Count": 999, **kw}


def test_json_report_counts_repeats_and_last_row_wins(spark, tmp_path):
    rows = [row(Name="a"), row(Name="b"), row(Name="c"), row(hash_="C" * 64)]
    path = write(tmp_path, "r.json", json.dumps({"data": rows}))
    report = reports.read_duplicate_report(spark, path, ORG)
    assert report.repeated.first().asDict() == {"repeated": 2, "rows": 2}
    assert {r["hash"]: r["name"] for r in report.rows.collect()} == {H: "c", "C" * 64: ""}


def test_csv_report_with_byte_order_mark(spark, tmp_path):
    line = f"4,{H.lower()},{{{APP.upper()}}},Example,{ORG}\r\n"
    text = ("Count,Hash,Application Id,Name,Organization-ID\r\n" + line * 2).encode("utf-8-sig")
    report = reports.read_duplicate_report(spark, write(tmp_path, "r.csv", text), ORG)
    assert [r.asDict() for r in report.rows.collect()] == [
        {"organization_id": ORG, "application_id": APP, "hash": H, "name": "Example", "count": "4"}
    ]
    assert report.repeated.first()["repeated"] == 1


def test_quoted_line_breaks_and_json_lines(spark, tmp_path):
    text = f'Hash,ApplicationId,Name,OrganizationId,Count\n{H},{APP},"two\nlines",{ORG},4\n'
    report = reports.read_duplicate_report(spark, write(tmp_path, "r.csv", text.encode()), ORG, multi_line=True)
    assert [r["name"] for r in report.rows.collect()] == ["two\nlines"]
    lines = "\n".join(json.dumps(row(hash_=h)) for h in (H, "C" * 64))
    report = reports.read_duplicate_report(spark, write(tmp_path, "r.json", lines.encode()), ORG, multi_line=False)
    assert {r["hash"] for r in report.rows.collect()} == {H, "C" * 64}


@pytest.mark.parametrize("form", ["array", "pretty", "data", "lone"])
def test_json_arrays_are_read_by_many_tasks(spark, tmp_path, form):
    rows = [row(hash_=f"{i:064X}", Name='a "b" \\ ü', Count=i if i % 2 else None) for i in range(400 if form != "lone" else 1)]
    document = {"data": rows} if form == "data" else rows
    path = write(tmp_path, "r.json", json.dumps(document, indent=2 if form == "pretty" else None) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        found = files.read_json_rows(spark, path)
        tasks = {r[0] for r in found.select(F.spark_partition_id()).distinct().collect()}
        report = reports.read_duplicate_report(spark, path, ORG)
        got = {r["hash"]: (r["name"], r["count"]) for r in report.rows.collect()}
        order = [r["Hash"] for r in found.orderBy(files.ORDER).select("Hash").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(tasks) > 3 or form == "lone"
    assert got == {r["Hash"]: (r["Name"], None if r["Count"] is None else str(r["Count"])) for r in rows}
    assert order == [r["Hash"] for r in rows]


@pytest.mark.parametrize("text", [
    json.dumps([row(Name="br{ace"), row(hash_="C" * 64, Name="end}")]), json.dumps([row(Name={"n": 1}), row(hash_="C" * 64)]),
    json.dumps({"total": 2, "data": [row(), row(hash_="C" * 64)]}), json.dumps({"data": [row(), row(hash_="C" * 64)], "next": None}),
    json.dumps(row()) + "\n" + json.dumps(row(hash_="C" * 64)),
])
def test_other_json_documents_are_read_whole(spark, tmp_path, text):
    path = write(tmp_path, "r.json", text)
    multi_line = not text.startswith('{"OrganizationId"')
    assert {r["Hash"] for r in files.read_json_rows(spark, path, multi_line).collect()} == {H, "C" * 64}


@pytest.mark.parametrize("text", ['[{"Hash": "a"} {"Hash": "b"}]', '[{"Hash": "a"}, {"Hash": b}]', '[{"Hash": "a"}', '[{"Hash" "a"}, {"Hash": "b"}]'])
def test_malformed_json_is_rejected(spark, tmp_path, text):
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.read_json_rows(spark, write(tmp_path, "r.json", text)).collect()


@pytest.mark.parametrize("bad", [row(org=APP), row(app="x"), row(hash_="12"), {"Hash": H}])
def test_bad_reports_are_rejected_whole(spark, tmp_path, bad):
    with pytest.raises(ValidationError):
        reports.read_duplicate_report(spark, write(tmp_path, "r.json", json.dumps([bad, row()] if len(bad) > 1 else [bad])), ORG)


def test_colliding_headers_are_rejected(spark, tmp_path):
    text = f"Hash,ha-sh,ApplicationId,OrganizationId\n{H},{H},{APP},{ORG}\n"
    with pytest.raises(ValidationError):
        reports.read_duplicate_report(spark, write(tmp_path, "r.csv", text), ORG)


def test_large_report(spark, tmp_path):
    good = {"ApplicationId": APP, "OrganizationId": ORG, "Name": "Test", "Count of Hashes": "1,001"}
    report = reports.read_large_report(spark, write(tmp_path, "a.json", json.dumps([good, good])), ORG)
    assert [tuple(r) for r in report.rows.collect()] == [(APP, "Test", 1001)]
    assert insights.large_totals(report.rows).first().asDict() == {
        "over_1000": 1, "reported": 1001, "largest": 1001, "over_100000": 0
    }
    changes = ({"Count of Hashes": -1}, {"OrganizationId": APP}, {"Count of Hashes": "7"})
    for number, change in enumerate(changes):
        rows = json.dumps([good, {**good, **change}])
        with pytest.raises(ValidationError):
            reports.read_large_report(spark, write(tmp_path, f"bad{number}.json", rows), ORG)


def test_requested_list(spark, tmp_path):
    text = f" ApplicationId ,HASH,OsType,RecordType\n{APP},{H.lower()},1,\n{APP},{H},1,hash\n{APP2},{H},2,SHA-256\n"
    report = reports.read_requested_hashes(spark, write(tmp_path, "q.csv", text))
    assert sorted(tuple(r) for r in report.rows.collect()) == [(APP, H, 1, "HASH"), (APP2, H, 2, "SHA256ONLY")]
    assert report.repeated.first()["repeated"] == 1
    for number, line in enumerate((f"{APP},{H},2,", f"{APP},{'A' * 32},1,SHA256", f"x,{H},1,", f"{APP},{H},3,", f"{APP},zz,1,", f"{APP},{'B' * 32},2,")):
        bad = f"ApplicationId,Hash,OsType,RecordType\n{APP},{H},1,\n{line}\n"
        with pytest.raises(ValidationError):
            reports.read_requested_hashes(spark, write(tmp_path, f"bad{number}.csv", bad))
    with pytest.raises(ValidationError):
        reports.read_requested_hashes(spark, write(tmp_path, "empty.csv", "ApplicationId,Hash,OsType\n"))


def test_requested_plan(spark):
    rows = [record(1), record(2, "B" * 64, sha256=H), record(3, isHashOnly=False), record(4, "D" * 64)]
    wanted = spark.createDataFrame([(APP, H, 1, "HASH"), (APP, "E" * 64, 1, "HASH")], "app string, hash string, os int, kind string")
    plan = requested.requested_plan(record_view(frame(spark, rows)), wanted)
    assert sorted((r["fid"], r["hash"]) for r in plan.targets.collect()) == [("1", H), ("2", H)]
    assert [r["hash"] for r in plan.unmatched.collect()] == ["E" * 64]
    assert plan.counts.first().asDict() == {"requested": 2, "scanned": 4, "planned": 2, "unmatched": 1}
    live = record_view(frame(spark, [record(2, "B" * 64, sha256=H)]))
    recovered, bad = requested.recover_targets(plan.targets, live)
    assert {r["fid"]: r["status"] for r in recovered.collect()} == {"1": "VerifiedAbsent", "2": "Planned"}
    assert bad.count() == 0
    changed = record_view(frame(spark, [record(2, "B" * 64)]))
    assert requested.recover_targets(plan.targets, changed)[1].count() == 1
    assert [r["fid"] for r in requested.selective_presence(plan.targets, live).collect()] == ["2"]


def test_report_summaries(spark):
    schema = "organization_id string, application_id string, hash string, name string, count string"

    def report(*rows):
        return spark.createDataFrame([(ORG, *r) for r in rows], schema)

    shared = report(("one", "A", "Same", "4"), ("two", "A", "Same", "4"), ("one", "B", "Same", "11"))
    assert insights.report_totals(shared).first().asDict() == {
        "groups": 3, "hashes": 2, "shared_hashes": 1, "extras": 16, "unknown_counts": 0
    }
    assert insights.report_by_application(shared).count() == 2
    assert [r["hash"] for r in insights.shared_hashes(shared).collect()] == ["A"]
    counts = [None, "invalid", "0", "-1", "2.5", "NaN", "Infinity", "11"]
    unknown = report(*[("one", str(i), None, c) for i, c in enumerate(counts)])
    summary = insights.report_by_application(unknown).first()
    assert (summary["unknown_counts"], summary["estimated_extra_records"]) == (7, 10)
    assert summary["application"] == "Unnamed application"


def test_progress_and_run_summary(spark):
    states = ["Planned", "Dispatched", "Accepted", "VerifiedAbsent", "Uncertain", "StillPresent"]
    targets = spark.createDataFrame([("one", str(i), s) for i, s in enumerate(states)], "app string, fid string, status string")
    events = spark.createDataFrame(
        [(i, float(i), "DeleteResponse", "one", "2", "HTTP 200") for i in range(3)] + [(9, 9.0, "Other", "one", "2", "")],
        "id bigint, time double, kind string, app string, fid string, detail string",
    )
    assert insights.deletion_progress(targets).first().asDict() == {
        "total": 6, "accepted": 2, "verified": 1, "queued": 1, "dispatched": 1, "attention": 2
    }
    recent = insights.recent_responses(events, targets).orderBy("time", ascending=False).collect()
    assert (recent[0]["time"], recent[0]["current_status"]) == (2.0, "Accepted")
    empty = insights.deletion_progress(targets.limit(0)).first()
    assert empty["total"] == 0
    apps = spark.createDataFrame([("app", "Example", 2)], "applicationId string, name string, osType int")
    baseline = spark.createDataFrame([("app", str(i)) for i in range(4)], "app string, fid string")
    planned = spark.createDataFrame([("app", "2", "Accepted"), ("app", "3", "VerifiedAbsent")], "app string, fid string, status string")
    groups = spark.createDataFrame([("app", None, "x"), ("app", "1", "y")], "app string, survivor string, reason string")
    row = insights.run_summary(apps, baseline, groups, planned).first().asDict()
    assert (row["verified_deletions"], row["expected_after_cleanup"], row["remaining_planned"], row["os"]) == (1, 2, 1, "macOS")
    counts = insights.plan_counts(groups, planned).first()
    assert (counts["planned"], counts["skipped_groups"], counts["statuses"]) == (2, 1, {"Accepted": 1, "VerifiedAbsent": 1})
    compared = insights.comparison(baseline, planned).first().asDict()
    assert (compared["before"], compared["after"], compared["reduction"]) == (4, 2, 0.5)


def test_application_search(spark):
    apps = applications(spark, APP, APP2)
    assert [r["applicationId"] for r in snapshots.search_results(apps, ORG, 1).collect()] == [APP, APP2]
    assert snapshots.find_applications(apps, " IDENTICAL ", 1, ORG).count() == 2
    for bad in (apps.unionByName(apps), applications(spark, APP, os_type=2), applications(spark, APP).selectExpr("applicationId", f"'{APP}' organizationId", "name", "osType", "isBuiltIn"), applications(spark, APP).selectExpr("applicationId", "organizationId", "name", "osType", "true isBuiltIn")):
        with pytest.raises(ValidationError):
            snapshots.search_results(bad, ORG, 1)


def test_a_request_list_is_read_once(spark):
    rows = [(APP, "1" * 32, 1, "HASH"), (APP, "2" * 32, 1, "HASH"), (APP2, "1" * 32, 1, "HASH")]
    reads = spark.sparkContext.accumulator(0)

    def read(row):
        reads.add(1)
        return row

    wanted = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(read), "app string, hash string, os int, kind string")
    records = record_view(frame(spark, [record(1, "1" * 32), record(2, "1" * 32), record(3, "3" * 32)]))
    plan = requested.requested_plan(records, wanted)
    assert plan.counts.first().asDict() == {"requested": 3, "scanned": 3, "planned": 2, "unmatched": 2}
    assert plan.unmatched.count() == 2
    assert reads.value == 3
