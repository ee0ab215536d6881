"""Sources, sinks, saved runs and the streaming query."""

import json

from pyspark.sql import functions as F

from fileledger.operators import dedup, reconcile
from fileledger.operators.insights import deletion_progress, deletion_progress_by_application, recent_responses
from fileledger.plans import history
from fileledger.sinks import writers
from fileledger.sources import runs, snapshots
from fileledger.streaming.progress import distinct_events, latest_statuses, recent_outcomes, record_changes, start_progress
from tests.helpers import APP, H, ORG, frame, record
from workload import queries as Q
from workload import views

SF = "/root/testdata/sf0.001"


def test_record_json_keeps_unknown_and_unusable_fields(spark, tmp_path):
    rows = [
        {"applicationFileId": 1, "applicationId": APP, "hash": H, "isHashOnly": True, "keyFile": False, "minSize": None},
        {"applicationFileId": 2, "applicationId": APP, "hash": H, "isHashOnly": True, "newRule": False},
        {"applicationFileId": 3, "applicationId": APP, "hash": H, "isHashOnly": True, "keyFile": "true"},
        {"applicationFileId": 12345678901234567890123, "applicationId": APP, "hash": H, "isHashOnly": True},
    ]
    (tmp_path / "records.json").write_text("\n".join(json.dumps(r) for r in rows))
    read = snapshots.read_records_json(spark, str(tmp_path / "records.json"))
    view = dedup.record_view(read)
    assert {r["fid"]: r["plain"] for r in view.collect()} == {"1": True, "2": False, "3": False, "12345678901234567890123": True}
    assert view.filter("fid = '2'").first()["extras"] == {"newRule": "false"}


def test_snapshot_round_trip_prunes_and_pushes_down(spark, tmp_path):
    view = dedup.record_view(frame(spark, [record(i, f"{i % 3:032X}") for i in range(1, 30)]))
    writers.write_snapshot(view.drop("extras"), str(tmp_path / "s"))
    found = snapshots.read_records(spark, str(tmp_path / "s")).filter((F.col("applicationId") == APP) & (F.col("hash_key") == f"{1:032X}"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(applicationId" in plan and "EqualTo(hash_key" in plan
    assert found.count() == 10
    assert snapshots.records_with_hash(view, APP, f"{1:032x}").count() == 10


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_stored_snapshots_are_compared_inside_their_buckets(spark, tmp_path):
    old = reconcile.with_fingerprint(dedup.record_view(views.records(spark, SF)))
    # Some records got another hash, beside those that are gone, new or edited.
    raw = views.records_now(spark, SF).withColumn("hash", F.when(F.endswith("notes", F.lit("-15")), F.upper(F.md5("notes"))).otherwise(F.col("hash")))
    new = reconcile.with_fingerprint(dedup.record_view(raw))
    plan = Q._plan(spark, SF)
    targets = plan.targets.withColumn("status", views.state_of(F.col("fid").cast("long")))
    baseline = old.join(plan.applications.select(F.col("applicationId").alias("app")), "app", "left_semi")
    kept = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in kept}
    for name, rows in (("old_snapshot", baseline), ("new_snapshot", new)):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        writers.write_stored_snapshot(rows, name, str(tmp_path / name), 6)
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        one, two = spark.table("old_snapshot"), spark.table("new_snapshot")
        diff = reconcile.stored_snapshot_diff(one, two, spark.createDataFrame(targets.collect(), targets.schema))
        assert exchanges(diff) == 1  # of the targets
        assert sorted(map(tuple, diff.collect()), key=str) == sorted(map(tuple, reconcile.snapshot_diff(baseline, new, targets).collect()), key=str)
        assert {r["change"] for r in diff.select("change").distinct().collect()} >= {"new", "changed", "missing_unplanned", "unchanged"}
        writers.write_stored_snapshot(targets.select("app", "fid", "status", F.lit("").alias("fingerprint")), "stored_targets", str(tmp_path / "targets"), 6)
        assert exchanges(reconcile.stored_snapshot_diff(one, two, spark.table("stored_targets"))) == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        for name in ("old_snapshot", "new_snapshot", "stored_targets"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_plan_tables_round_trip(spark, tmp_path):
    root = str(tmp_path / "runs")
    targets = spark.createDataFrame([(APP, "1", H, "VerifiedAbsent", "")], "app string, fid string, hash string, status string, detail string")
    meta = spark.createDataFrame([("org", ORG), ("workflow", history.DUPLICATES), ("phase", "Complete"), ("created", "5.5"), ("prepared", "6")], "key string, value string")
    writers.write_plan({"targets": targets, "meta": meta}, root, "r1")
    writers.write_plan({"targets": targets, "meta": meta.filter("key <> 'org'")}, root, "r2")
    loaded = runs.read_run(spark, root, "r1")
    assert set(loaded) == {"targets", "meta"} and loaded["targets"].count() == 1
    everything = runs.read_run_table(spark, root, "meta")
    headers = runs.complete_runs(everything)
    listed = history.run_history(headers, spark.createDataFrame([("r1", APP, "Example")], "run_id string, app string, name string"), runs.read_run_table(spark, root, "targets"), ORG)
    row = history.newest_first(history.find_runs(listed, "EXAMPLE", history.DUPLICATES)).collect()
    assert [(r["run"], r["planned"], r["verified"], r["created"]) for r in row] == [("r1", 1, 1, 5.5)]
    assert {r["key"] for r in runs.run_scope_violations(everything, ORG).collect()} == {"r2"}
    writers.write_audit(loaded, str(tmp_path / "audit"))
    writers.write_results(targets, str(tmp_path / "results"))
    writers.write_run_history(listed, str(tmp_path / "history"))
    back = spark.read.option("header", True).csv(str(tmp_path / "results"))
    assert back.columns == ["app", "fid", "hash", "status", "detail"] and back.count() == 1


def test_stream_equals_batch(spark, tmp_path):
    raw = spark.read.parquet(f"{SF}/events.parquet")
    raw.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []

    def sink(totals, by_app, recent, batch):
        seen.append((batch, totals.first().asDict(), sorted(map(tuple, by_app.collect())), recent.count()))

    query = start_progress(views.event_outcomes(stream), sink, str(tmp_path / "cp"))
    query.awaitTermination(120)
    statuses = latest_statuses(views.event_outcomes(raw))
    assert len(seen) >= 5
    assert seen[-1][1] == deletion_progress(statuses).first().asDict()
    assert seen[-1][2] == sorted(map(tuple, deletion_progress_by_application(statuses).collect()))
    assert seen[-1][3] == recent_outcomes(statuses).count() == 10


class Stopped(Exception):
    pass


def test_stream_counts_once_when_a_trigger_is_run_again(spark, tmp_path):
    """Retried records, late and repeated events, and a sink that fails: the same as the batch."""
    def event(i, time, fid, status, app="a", kind="DeleteResponse"):
        return (i, time, kind, app, fid, f"HTTP {i}", status)

    shape = "id long, time long, kind string, app string, fid string, detail string, status string"
    pieces = [
        [event(i, 100 + i, str(i % 4), "Planned") for i in range(12)],
        [event(20, 90, "1", "Accepted"), event(21, 300, "1", "Accepted"), event(22, 301, "1", "Uncertain"), event(21, 300, "1", "Accepted")],
        [event(22, 301, "1", "Uncertain"), event(30, 400, "9", "VerifiedAbsent", "b"), event(31, 401, "2", "Accepted", kind="Note")],
        [event(40 + i, 302, "7", "StillPresent") for i in range(15)],
        [event(60, 500, "9", None, "b"), event(61, 501, None, "Planned", None), (62, None, "DeleteResponse", "b", "9", "x", "Planned")],
        [event(31, 401, "2", "Accepted", kind="Note")],
    ]
    for n, rows in enumerate(pieces):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={n}"))
    seen, failed = [], []

    def sink(totals, by_app, recent, batch):
        if batch in (1, 3) and batch not in failed:
            failed.append(batch)
            raise Stopped
        seen.append((totals.first().asDict(), sorted(map(str, by_app.collect())), sorted(map(str, recent.collect()))))

    folder = str(tmp_path / "cp")
    for _ in range(3):
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = start_progress(stream, sink, folder)
        try:
            query.awaitTermination(120)
        except Exception as error:  # noqa: BLE001
            assert "Stopped" in str(error)
    assert failed == [1, 3] and len(seen) == len(pieces)
    raw = spark.createDataFrame([r for rows in pieces for r in rows], shape)
    statuses = latest_statuses(raw)
    recent = recent_responses(raw.dropDuplicates(["id"]), statuses)
    assert seen[-1][0] == deletion_progress(statuses).first().asDict()
    assert seen[-1][1] == sorted(map(str, deletion_progress_by_application(statuses).collect()))
    # The key without a record is no target of the batch query, which joins on equality.
    mine, other = ([r for r in rows if "record_id=None" not in r] for rows in (seen[-1][2], sorted(map(str, recent.collect()))))
    assert mine == other and len(seen[-1][2]) == 10
    assert sum("record_id='7'" in r for r in seen[3][2]) > 1  # several responses of one record


def test_changes_hold_touched_records_only(spark, tmp_path):
    shape = "id long, time long, kind string, app string, fid string, detail string, status string"
    for n, keys in enumerate([range(50), [3], [3, 4]]):
        rows = [(100 * n + k, n, "DeleteResponse", "a", str(k), "x", "Planned" if n == 0 else "Accepted") for k in keys]
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / f"in/part={n}"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sizes = []
    query = record_changes(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
    query = query.foreachBatch(lambda df, n: sizes.append(sorted((r.fid, r.old, r.status) for r in df.filter("not response").collect())))
    query.trigger(availableNow=True).start().awaitTermination(120)
    assert len(sizes[0]) == 50
    assert sizes[1:] == [[("3", "Planned", "Accepted")], [("3", "Accepted", "Accepted"), ("4", "Planned", "Accepted")]]


def test_repeated_deliveries_change_nothing(spark):
    events = views.outcome_events(spark, SF)
    twice = events.unionByName(events)
    assert distinct_events(twice).count() == events.count()
    assert deletion_progress(latest_statuses(twice)).first() == deletion_progress(latest_statuses(events)).first()


def test_results_do_not_depend_on_partitions(spark):
    few = sorted(map(tuple, Q.duplicate_plan(spark, SF).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        many = sorted(map(tuple, Q.duplicate_plan(spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert few == many
