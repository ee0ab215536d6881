"""Comparison of saved baselines with fresh snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger import fixed_values as V
from fileledger.functions.hashes import plain_hash_record, record_fingerprint, unknown_fields
from fileledger.functions.text import trimmed

KEYS = ["app", "fid"]
# For sorts and joins: an application's records are told apart by their ID.
SORT_KEYS = ["fid", "app"]
_DERIVED = {"app", "org", "fid", "id_num", "hash_key", "plain", "fingerprint"}

# Classes that stop a plan, with the message they stop it with.
BLOCKING = {
    "new": V.MESSAGE_NEW,
    "changed": V.MESSAGE_CHANGED,
    "missing_unplanned": V.MESSAGE_MISSING_UNPLANNED,
    "missing_planned": V.MESSAGE_MISSING_PLANNED,
    "reappeared": V.MESSAGE_REAPPEARED,
}


def with_fingerprint(records: DataFrame) -> DataFrame:
    """Fingerprint over all original fields of a record."""
    columns = {c: F.col(c) for c in records.columns if c not in _DERIVED}
    return records.withColumn("fingerprint", record_fingerprint(columns))


def _side(df: DataFrame, tag: str, *columns) -> DataFrame:
    """Rows of one of several tables to be grouped together."""
    return df.select(F.lit(tag).alias("_tag"), *columns)


def _of(tag: str, column: str = "value"):
    return F.when(F.col("_tag") == tag, F.col(column))


def _classified(records: DataFrame) -> DataFrame:
    """Change and next status of records with ``in_old``, ``in_new``, ``same`` and ``previous_status``."""
    absent, before = ~F.col("in_new"), F.col("previous_status")
    kind = (
        F.when(~F.col("in_old"), "new")
        .when(~absent & ~F.col("same"), "changed")
        .when(absent & before.isNull(), "missing_unplanned")
        .when(absent & (before == V.PLANNED), "missing_planned")
        .when(absent, "verified_absent")
        .when(before == V.VERIFIED_ABSENT, "reappeared")
        .when(before.isNotNull() & (before != V.PLANNED), "still_present")
        .otherwise("unchanged")
    )
    next_status = (
        F.when(before.isNull(), F.lit(None).cast("string"))
        .when(absent, V.VERIFIED_ABSENT)
        .when(before == V.PLANNED, V.PLANNED)
        .otherwise(V.STILL_PRESENT)
    )
    return records.select(*KEYS, before, kind.alias("change"), next_status.alias("status"))


def snapshot_diff(baseline: DataFrame, current: DataFrame, targets: DataFrame) -> DataFrame:
    """Classify every record of either snapshot.

    Only keys, fingerprints and statuses travel, all three tables in one exchange. A record that
    a snapshot holds several times is unchanged if the other holds it as often with the same
    fingerprints.
    """
    rows = _side(baseline, "old", *KEYS, F.col("fingerprint").alias("value"))
    rows = rows.unionByName(_side(current, "new", *KEYS, F.col("fingerprint").alias("value")))
    rows = rows.unionByName(_side(targets, "status", *KEYS, F.col("status").alias("value")))
    ends = [f(_of(tag)).alias(f"{tag}_{name}") for tag in ("old", "new") for name, f in (("n", F.count), ("low", F.min), ("high", F.max))]
    joined = rows.groupBy(*SORT_KEYS).agg(*ends, F.min(_of("status")).alias("previous_status"))
    same = F.lit(True)
    for name in ("n", "low", "high"):
        same = same & (F.col(f"old_{name}") == F.col(f"new_{name}"))
    found = {"in_old": F.col("old_n") > 0, "in_new": F.col("new_n") > 0, "same": F.coalesce(same, F.lit(False))}
    return _classified(joined.withColumns(found).filter("in_old or in_new"))


def stored_snapshot_diff(baseline: DataFrame, current: DataFrame, targets: DataFrame) -> DataFrame:
    """The same for two snapshots stored by record in as many buckets.

    Records meet inside their bucket, so of the three tables only targets are exchanged, and not
    even they if they are stored alike. Each snapshot holds a record once. Every target is a
    record of the baseline.
    """
    status = targets.select(*KEYS, F.col("status").alias("previous_status"))
    old = baseline.select(*KEYS, F.col("fingerprint").alias("old_fp")).join(status, KEYS, "left")
    met = old.join(current.select(*KEYS, F.col("fingerprint").alias("new_fp")), KEYS, "full_outer")
    return _classified(met.withColumns({
        "in_old": F.col("old_fp").isNotNull(), "in_new": F.col("new_fp").isNotNull(),
        "same": F.coalesce(F.col("old_fp") == F.col("new_fp"), F.lit(False)),
    }))


def diff_violations(diff: DataFrame) -> DataFrame:
    """Differences that mean the plan no longer describes the application."""
    reason = F.when(F.lit(False), F.lit(""))
    for kind, message in BLOCKING.items():
        reason = reason.when(F.col("change") == kind, F.lit(message))
    return diff.filter(F.col("change").isin(list(BLOCKING))).select(
        reason.alias("reason"), F.concat_ws("/", *KEYS).alias("key")
    )


def metadata_violations(planned: DataFrame, current: DataFrame) -> DataFrame:
    """Applications whose name or operating system changed since planning, or that vanished."""
    now = current.select("applicationId", F.col("name").alias("_name"), F.col("osType").alias("_os"))
    joined = planned.join(now, "applicationId", "left")
    same = F.col("name").eqNullSafe(F.col("_name")) & F.col("osType").eqNullSafe(F.col("_os"))
    return joined.filter(~same).select(
        F.lit(V.MESSAGE_METADATA).alias("reason"),
        F.col("applicationId").alias("key"),
    )


def updated_targets(targets: DataFrame, diff: DataFrame) -> DataFrame:
    """Targets with the status a reconciliation found."""
    found = diff.filter(F.col("status").isNotNull()).select(*KEYS, F.col("status").alias("_status"))
    return (
        targets.join(found, KEYS, "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .drop("_status")
    )


def wave_precheck(baseline: DataFrame, live: DataFrame, targets: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group: is the live group exactly the expected one, and still safe to continue?

    Expected records are the baseline group without targets already accepted or
    verified. Inputs carry ``app``, ``fid``, ``hash_key``, ``fingerprint``, ``plain``.
    """
    keys = ["app", "hash_key", "fid"]
    none = F.lit(None)
    gone = targets.filter(F.col("status").isin(V.VERIFIED_ABSENT, V.ACCEPTED))
    if "hash_key" not in gone.columns:
        gone = gone.join(baseline.select(*keys), KEYS)
    expected = _side(baseline, "old", *keys, F.col("fingerprint").alias("value"), none.cast("boolean").alias("plain"))
    rows = expected.unionByName(_side(gone, "gone", *keys, none.cast("string").alias("value"), none.cast("boolean").alias("plain")))
    rows = rows.unionByName(_side(live, "new", *keys, F.col("fingerprint").alias("value"), "plain"))
    first = groups.filter(F.col("survivor").isNotNull()).select("app", "hash_key", F.col("survivor").alias("fid"))
    rows = rows.unionByName(_side(first, "survivor", *keys, none.cast("string").alias("value"), none.cast("boolean").alias("plain")))
    records = rows.groupBy("hash_key", "fid", "app").agg(
        F.max(_of("old")).alias("old_fp"), F.max(_of("new")).alias("new_fp"), F.bool_and(_of("new", "plain")).alias("plain"),
        F.bool_or(F.col("_tag") == "gone").alias("gone"), F.bool_or(F.col("_tag") == "survivor").alias("survivor"),
    )
    # An expected record that a target took away counts only where it is still there.
    records = records.withColumn("old_fp", F.when(~F.col("gone"), F.col("old_fp")))
    counts = F.col("old_fp").isNotNull() | F.col("new_fp").isNotNull()
    checked = records.groupBy("hash_key", "app").agg(
        F.bool_and(F.when(counts, F.coalesce(F.col("old_fp") == F.col("new_fp"), F.lit(False)))).alias("unchanged"),
        F.bool_or(F.when(counts, F.col("survivor") & F.col("new_fp").isNotNull())).alias("survivor_present"),
        F.bool_and(F.when(counts, F.coalesce("plain", F.lit(True)))).alias("still_plain"),
        F.bool_or("survivor").alias("_eligible"),
    ).filter(F.col("_eligible") & F.col("unchanged").isNotNull())
    checked = checked.select("app", "hash_key", "unchanged", "survivor_present", "still_plain")
    return checked.withColumn("safe", F.col("unchanged") & F.col("survivor_present") & F.col("still_plain"))


# --- consolidation -----------------------------------------------------------

_MATCH_FIELDS = ["fullPath", "processPath", "cert", "installedBy"]


def match_insertions(extra: DataFrame, insertions: DataFrame) -> DataFrame:
    """Find each inserted rule among new records.

    ``insertions``: app, rule_no, notes, the four condition fields and optionally
    the ``record_fp`` seen earlier. A rule is verified when exactly one new
    record carries its notes and conditions and nothing else.
    """
    columns = {c: F.col(c) for c in extra.columns}

    def text_of(name: str):
        return trimmed(columns[name]) if name in columns else F.lit("")

    originals_agree = F.lit(True)
    for field in _MATCH_FIELDS:
        name = "original" + field[0].upper() + field[1:]
        if name in columns:
            originals_agree = originals_agree & (columns[name].isNull() | (text_of(name) == text_of(field)))
    blank = F.lit(True)
    for name in ("originalHash", "name", "recordType"):
        blank = blank & (text_of(name) == "")
    for name in ("minSize", "maxSize"):
        if name in columns:
            blank = blank & columns[name].isNull()
    if "originalKeyFile" in columns:
        blank = blank & ~F.coalesce(columns["originalKeyFile"], F.lit(False))
    if "extras" in columns:
        blank = blank & (F.coalesce(F.size(unknown_fields(columns["extras"])), F.lit(0)) <= 0)
    # A filled column of unknown meaning may narrow what the rule matches.
    for name in columns:
        if name not in V.KNOWN_FIELDS and name not in V.DERIVED_FIELDS:
            blank = blank & (F.coalesce(columns[name].cast("string"), F.lit("")) == "")
    is_rule = (
        (text_of("hash") == "")
        & ~F.coalesce(columns["isHashOnly"], F.lit(True))
        & ~F.coalesce(columns["keyFile"], F.lit(False))
    )
    found = with_fingerprint(extra).filter(is_rule).select(
        "app", "notes", "fid", "fingerprint",
        *[text_of(f).alias(f) for f in _MATCH_FIELDS],
        blank.alias("blank"), originals_agree.alias("originals_agree"),
    )
    wanted = insertions.select(
        "app", "rule_no", "notes", *[trimmed(F.col(f)).alias(f) for f in _MATCH_FIELDS],
        (F.col("record_fp") if "record_fp" in insertions.columns else F.lit(None).cast("string")).alias("record_fp"),
    )
    joined = wanted.join(found, ["app", "notes", *_MATCH_FIELDS], "left")
    per_rule = joined.groupBy("app", "rule_no", "record_fp").agg(
        F.count("fid").alias("found"), F.min("fid").alias("fid"),
        F.min("fingerprint").alias("fingerprint"),
        F.bool_and("blank").alias("blank"), F.bool_and("originals_agree").alias("originals_agree"),
    )
    problem = (
        F.when(F.col("found") != 1, V.MESSAGE_RULE_MISSING)
        .when(~F.col("blank"), V.MESSAGE_RULE_SEMANTICS)
        .when(~F.col("originals_agree"), V.MESSAGE_RULE_ORIGINALS)
        .when(F.col("record_fp").isNotNull() & (F.col("record_fp") != F.col("fingerprint")), V.MESSAGE_RULE_CHANGED)
    )
    return per_rule.select("app", "rule_no", "fid", problem.alias("problem"))


def consolidation_diff(
    baseline: DataFrame, current: DataFrame, insertions: DataFrame, deletions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(classified records, violations) of a consolidation run.

    ``deletions``: app, fid, status (``Dispatched`` or ``Verified``). New records
    are allowed only where they are the inserted rules.
    """
    extra = current.join(baseline.select(*KEYS), KEYS, "left_anti")
    matched = match_insertions(extra, insertions)
    accounted = matched.filter(F.col("problem").isNull()).select("app", "fid")
    remaining = current.join(accounted, KEYS, "left_anti")
    status = deletions.select(
        *KEYS,
        F.when(F.col("status") == "Verified", V.VERIFIED_ABSENT).otherwise(F.col("status")).alias("status"),
    )
    diff = snapshot_diff(baseline, remaining, status)
    bad_rules = matched.filter(F.col("problem").isNotNull()).select(
        F.col("problem").alias("reason"), F.concat_ws("/", "app", "rule_no").alias("key")
    )
    return diff, diff_violations(diff).unionByName(bad_rules)


def plan_applied(records: DataFrame, targets: DataFrame, new_rules: DataFrame | None = None) -> DataFrame:
    """The table a plan leads to: records without targets, plus replacement rules."""
    kept = records.join(targets.select(*KEYS), SORT_KEYS, "left_anti").select(
        *KEYS, *[c for c in records.columns if c not in KEYS]
    )
    if new_rules is None:
        return kept
    return kept.unionByName(new_rules, allowMissingColumns=True)


def still_plain(records: DataFrame) -> DataFrame:
    """Recompute eligibility on a fresh snapshot."""
    return records.withColumn("plain", plain_hash_record({c: F.col(c) for c in records.columns}))
