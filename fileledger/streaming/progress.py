"""Running outcome counts over an event stream."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fileledger import fixed_values as V
from fileledger.operators.insights import progress_of_counts, progress_of_counts_by_application
from fileledger.operators.skew import null_safe_join

#: Responses that are kept as the latest ones.
RECENT = 10
_NEVER = -(2**63)

_CHANGE = "app string, fid string, response boolean, known boolean, old string, status string, time long, id long, detail string"
_LAST = "time long, id long, given boolean, status string"
_COUNTS = "app string, status string, n long"
_RESPONSES = "id long, time long, app string, fid string, detail string, status string"


def latest_statuses(events: DataFrame) -> DataFrame:
    """Current status per (application, record): the latest event wins.

    ``events``: id, time, app, fid, status. Works on batch and streaming input;
    the state is one row per record however often it is retried, and an event
    delivered twice changes nothing.
    """
    return events.groupBy("app", "fid").agg(
        F.max(F.struct("time", "id", "status")).alias("_last")
    ).select("app", "fid", F.col("_last.status").alias("status"), F.col("_last.time").alias("time"))


def distinct_events(events: DataFrame, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """Drop repeated deliveries of an event; with a watermark the state stays bounded."""
    if watermark is None:
        return events.dropDuplicates(["id"])
    return events.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["id"])


def recent_outcomes(statuses: DataFrame, limit: int = RECENT) -> DataFrame:
    return statuses.orderBy(F.desc("time"), "app", "fid").limit(limit)


def _record_changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What one trigger tells of a record: its status before and now, and its latest responses."""
    before = state.get if state.exists else None
    last, responses = before, []
    for frame in frames:
        rows = list(zip(frame["time"], frame["id"], frame["status"].notna(), frame["status"].fillna(""), frame["response"], frame["detail"], strict=True))
        newest = max(r[:4] for r in rows)
        last = newest if last is None else max(tuple(last), newest)
        told = {r[:2]: r[5] for r in rows if r[4]}
        responses = heapq.nlargest(RECENT, {*responses, *((t, i, d) for (t, i), d in told.items())}, key=lambda r: r[:2])
    state.update((int(last[0]), int(last[1]), bool(last[2]), last[3]))
    old = before[3] if before is not None and before[2] else None
    now = last[3] if last[2] else None
    out = [(False, before is not None, old, now, 0, 0, None)]
    out += [(True, True, None, now, t, i, d) for t, i, d in responses]
    frame = pd.DataFrame(out, columns=["response", "known", "old", "status", "time", "id", "detail"])
    frame.insert(0, "app", key[0])
    frame.insert(1, "fid", key[1])
    yield frame


def record_changes(events: DataFrame) -> DataFrame:
    """A stream of changes: per trigger and record seen in it, one row with its status before and
    now (``known``: it had one before), and one row for each of its latest responses.

    The state is the last event of a record. An event that comes again, or late, changes nothing.
    Rows of a record arrive in pieces, so a record retried very often takes no more memory.
    """
    shaped = events.select(
        "app", "fid", F.coalesce("time", F.lit(_NEVER)).alias("time"), F.coalesce("id", F.lit(_NEVER)).alias("id"),
        "status", F.coalesce(F.col("kind") == V.RESPONSE_EVENT, F.lit(False)).alias("response"), "detail",
    )
    return shaped.groupBy("app", "fid").applyInPandasWithState(
        _record_changes, _CHANGE, _LAST, "update", GroupStateTimeout.NoTimeout
    )


def merged_counts(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """Records per (app, status) after the changes: each takes back its old status and adds its new one."""
    moved = changes.filter("not response")
    taken = moved.filter("known").select("app", F.col("old").alias("status"), F.lit(-1).cast("long").alias("n"))
    given = moved.select("app", "status", F.lit(1).cast("long").alias("n"))
    total = counts.unionByName(taken).unionByName(given).groupBy("app", "status").agg(F.sum("n").alias("n"))
    return total.filter("n <> 0")


def merged_responses(latest: DataFrame, changes: DataFrame) -> DataFrame:
    """The latest responses after the changes, each with the current status of its record.

    A response pushed out once cannot come back, so ten rows are all the state there is, and one
    that is delivered again is told by its id.
    """
    now = changes.filter("not response").select("app", "fid", F.col("status").alias("_now"), F.lit(True).alias("_seen"))
    known = null_safe_join(latest, now, ["app", "fid"], "left")
    known = known.withColumn("status", F.when(F.col("_seen"), F.col("_now")).otherwise(F.col("status"))).drop("_now", "_seen")
    new = changes.filter("response").select("id", "time", "app", "fid", "detail", "status")
    both = known.unionByName(new.orderBy(F.desc("time"), F.desc("id")).limit(RECENT)).dropDuplicates(["id"])
    return both.orderBy(F.desc("time"), F.desc("id")).limit(RECENT)


def start_progress(
    events: DataFrame,
    sink: Callable[[DataFrame, DataFrame, DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep outcome counts up to date: overall, per application, and the latest responses.

    ``events``: id, time, kind, app, fid, detail, status. Each trigger merges the changes of the
    records it saw into two small tables below ``checkpoint``, one row per application and status
    and one per recent response, and hands ``sink`` what follows from them; records that did not
    change are not touched. A trigger writes beside the tables it read, so that one that is run
    again after a failure counts nothing twice. ``sink`` may see the same trigger again.
    """
    spark = events.sparkSession

    def table(name: str, batch: int, shape: str) -> DataFrame:
        if batch < 0:
            return spark.createDataFrame([], shape)
        return spark.read.schema(shape).parquet(f"{checkpoint}/tables/{name}-{batch % 2}")

    def keep(name: str, batch: int, shape: str, rows: DataFrame) -> DataFrame:
        rows.coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}/tables/{name}-{batch % 2}")
        return table(name, batch, shape)

    def each_batch(changes: DataFrame, batch: int) -> None:
        kept = changes.persist()
        try:
            counts = keep("counts", batch, _COUNTS, merged_counts(table("counts", batch - 1, _COUNTS), kept))
            latest = keep("responses", batch, _RESPONSES, merged_responses(table("responses", batch - 1, _RESPONSES), kept))
            sink(progress_of_counts(counts), progress_of_counts_by_application(counts), shown_responses(latest), batch)
        finally:
            kept.unpersist()

    writer = record_changes(events).writeStream.outputMode("update").foreachBatch(each_batch)
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def shown_responses(latest: DataFrame) -> DataFrame:
    """Kept responses in the form of ``insights.recent_responses``."""

    def given(name: str):
        return F.when(F.col(name) != _NEVER, F.col(name)).alias(name)

    return latest.select(
        given("id"), given("time"), F.col("app").alias("application_id"), F.col("fid").alias("record_id"),
        F.col("detail").alias("response"), F.coalesce("status", F.lit(V.UNKNOWN_STATUS)).alias("current_status"),
    )
