"""The library's input tables, derived from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fileledger.operators.dedup import record_view

ORG = "11111111-1111-1111-1111-111111111111"
STATES = ["Planned", "Dispatched", "Accepted", "Uncertain", "StillPresent", "VerifiedAbsent"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A benchmark table. Each is one file with one row group, hence one task.

    On a single machine such a table is spread over the cores before text work;
    on a cluster, tables have many splits and are read as they are.
    """
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spark.sparkContext.master.startswith("local") and rows.rdd.getNumPartitions() < cores:
        return rows.repartition(cores)
    return rows


def app_id(value: Column) -> Column:
    """An application's UUID. A digest has 32 digits, so that only the hyphens are missing."""
    digits = F.md5(value)
    return F.concat(
        F.substring(digits, 1, 8), F.lit("-"), F.substring(digits, 9, 4), F.lit("-"), F.substring(digits, 13, 4),
        F.lit("-"), F.substring(digits, 17, 4), F.lit("-"), F.substring(digits, 21, 12),
    )


def text_hash(*parts: Column) -> Column:
    return F.upper(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])))


def state_of(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), (number % 6).cast("int") + 1)


def raw_records(spark: SparkSession, sf: str) -> DataFrame:
    """One file record per order; cheap orders carry a key-file flag."""
    orders = table(spark, sf, "orders")
    return orders.select(
        F.lit(ORG).alias("organizationId"),
        app_id(F.col("o_orderpriority")).alias("applicationId"),
        (F.col("o_orderkey") + 1).cast("string").alias("applicationFileId"),
        text_hash(F.col("o_custkey"), F.col("o_orderstatus")).alias("hash"),
        (F.col("o_totalprice") < 10000).alias("keyFile"),
        F.lit(True).alias("isHashOnly"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("notes"),
        F.col("o_totalprice").alias("_price"),
    )


def records(spark: SparkSession, sf: str) -> DataFrame:
    return raw_records(spark, sf).drop("_price")


def records_now(spark: SparkSession, sf: str) -> DataFrame:
    """A later snapshot: dear orders are gone, some notes edited, some records new."""
    raw = raw_records(spark, sf)
    price = F.col("_price")
    notes = F.when(price.between(250000, 260000), F.concat("notes", F.lit(" edited"))).otherwise(F.col("notes"))
    kept = raw.filter(price <= 480000).withColumn("notes", notes)
    new = raw.filter(price > 495000).withColumn(
        "applicationFileId", (F.col("applicationFileId").cast("long") + 1000000000).cast("string")
    )
    return kept.unionByName(new).drop("_price")


def applications(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("name")).distinct()
    return names.select(
        app_id(F.col("name")).alias("applicationId"), F.lit(ORG).alias("organizationId"), "name",
        F.when(F.col("name") < "4", 1).otherwise(2).alias("osType"), F.lit(False).alias("isBuiltIn"),
    )


def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A duplicate report as exported: repeated rows, stale rows and unusable counts."""
    orders = table(spark, sf, "orders")
    counted = orders.groupBy(
        F.col("o_orderpriority").alias("name"), text_hash(F.col("o_custkey"), F.col("o_orderstatus")).alias("hash")
    ).agg(F.count(F.lit(1)).alias("n"))
    # Orders are read and counted once for both rows of a group.
    current = F.struct(F.col("n").cast("string").alias("count"), F.lit(2).alias("_order"))
    earlier = F.struct(F.lit("999").alias("count"), F.lit(1).alias("_order"))
    listed = counted.select(
        "name", "hash", F.inline(F.when(F.col("n") > 1, F.array(current, earlier)).otherwise(F.array(current)))
    )
    stale = table(spark, sf, "customer").select(
        F.lit("1-URGENT").alias("name"), text_hash(F.col("c_custkey"), F.lit("X")).alias("hash"),
        F.when(F.col("c_acctbal") < 0, "invalid").otherwise(F.col("c_acctbal").cast("string")).alias("count"),
        F.lit(1).alias("_order"),
    )
    rows = listed.unionByName(stale)
    return rows.select(
        F.lit("{" + ORG.upper() + "}").alias("organizationid"),
        F.upper(app_id(F.col("name"))).alias("applicationid"),
        F.concat(F.lit(" "), F.lower("hash")).alias("hash"), "name", "count", "_order",
    )


def size_report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A large-application report: one application per customer, sized by its spending."""
    spent = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("k")
    )
    return spent.select(
        F.lit(ORG).alias("organizationid"),
        app_id(F.col("o_custkey").cast("string")).alias("applicationid"),
        F.concat(F.lit("Customer "), F.col("o_custkey")).alias("name"),
        F.format_number(F.col("n") * (F.col("k") + 1), 0).alias("countofhashes"),
    )


def part_path() -> Column:
    return F.concat(
        F.lit("C:\\Program Files\\"), F.col("p_brand"), F.lit("\\"), F.col("p_type"), F.lit("\\"),
        F.col("p_size"), F.lit("."), F.col("p_partkey") % 7, F.lit("\\"), F.col("p_name"), F.lit(".exe"),
    )


def part_note() -> Column:
    return F.concat(
        F.lit("2024-05-06 07:08 UTC Host: PC-"), F.col("p_partkey"),
        F.lit("\nPath: "), part_path(),
        F.lit("\nProcess: C:/Program Files//"), F.col("p_brand"), F.lit("/launcher.exe"),
        F.lit("\nCert: CN="), F.col("p_name"), F.lit("; O="), F.col("p_type"),
        F.lit("\nCreated By:  "), F.col("p_brand"), F.lit("  installer RE(2)"),
    )


def observations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        (F.col("p_partkey") + 1).alias("row_id"), F.upper(F.md5(F.col("p_partkey").cast("string"))).alias("Hash"),
        part_note().alias("Notes"),
    )


def observation_records(spark: SparkSession, sf: str) -> DataFrame:
    """Plain hash records with notes, one for every part; one application per part type."""
    return _part_records(spark, sf, F.lit(False))


def flagged_records(spark: SparkSession, sf: str) -> DataFrame:
    """The same records; dear parts carry a key-file flag."""
    return _part_records(spark, sf, F.col("p_retailprice") >= 990)


def _part_records(spark: SparkSession, sf: str, key_file: Column) -> DataFrame:
    rows = table(spark, sf, "part").select(
        F.lit(ORG).alias("organizationId"),
        app_id(F.col("p_type")).alias("applicationId"),
        (F.col("p_partkey") + 1).cast("string").alias("applicationFileId"),
        F.upper(F.md5(F.col("p_partkey").cast("string"))).alias("hash"),
        key_file.alias("keyFile"),
        F.lit(True).alias("isHashOnly"),
        part_note().alias("notes"),
    )
    return record_view(rows)


def insertions(spark: SparkSession, sf: str) -> DataFrame:
    """A rule that a run has inserted for every part."""
    return _inserted(spark, sf).select("app", "rule_no", "notes", "fullPath", "processPath", "cert", "installedBy")


def _inserted(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        app_id(F.col("p_type")).alias("app"), key.alias("rule_no"), F.concat(F.lit("Consolidation r1 rule "), key).alias("notes"),
        F.concat(F.lit("c:\\program files\\"), F.lower("p_brand"), F.lit("\\*\\"), F.col("p_name"), F.lit(".exe")).alias("fullPath"),
        F.concat(F.lit("c:\\program files\\"), F.lower("p_brand"), F.lit("\\launcher.exe")).alias("processPath"),
        F.lit("").alias("cert"), F.concat("p_brand", F.lit(" ")).alias("installedBy"),
    )


def inserted_records(spark: SparkSession, sf: str) -> DataFrame:
    """The records those rules became: some missing, doubled, narrowed or with other originals."""
    kind = F.col("rule_no") % 8
    rows = _inserted(spark, sf).filter(kind != 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(kind == 1, 1).otherwise(0))))
    return rows.select(
        "app", F.col("app").alias("applicationId"), F.lit(ORG).alias("organizationId"),
        (F.lit(10**9) + 2 * F.col("rule_no") + F.col("copy")).cast("string").alias("applicationFileId"),
        (F.lit(10**9) + 2 * F.col("rule_no") + F.col("copy")).cast("string").alias("fid"),
        F.lit("").alias("hash"), F.lit(False).alias("isHashOnly"), F.lit(False).alias("keyFile"), "notes", "fullPath",
        "processPath", "cert", F.trim("installedBy").alias("installedBy"),
        F.when(kind == 2, "named").otherwise("").alias("name"),
        F.when(kind == 3, "c:\\other").when(kind == 4, F.concat("fullPath", F.lit(" "))).alias("originalFullPath"),
        F.when(kind == 5, "tag").alias("customTag"),
    )


def free_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Part notes, whole documents and page addresses as notes."""
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("part-"), F.col("p_partkey")).alias("note_id"), part_note().alias("notes")
    )
    documents = table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("note_id"), F.col("text").alias("notes")
    )
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id")).alias("note_id"),
        F.concat(F.lit("Device: web File: "), F.col("url"), F.lit(" Hash: "), F.md5("html")).alias("notes"),
    )
    return parts.unionByName(documents).unionByName(pages)


def mixed_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Windows, POSIX and malformed paths."""
    parts = table(spark, sf, "part")
    windows = parts.select(part_path().alias("raw"))
    quoted = parts.select(
        F.concat(F.lit("  \"C:/Users/"), F.col("p_name"), F.lit("//AppData\\\\Local\\en-US\\v"), F.col("p_size"),
                 F.lit(".1\\"), F.md5("p_name"), F.lit("\\setup.MSI\" process=x")).alias("raw")
    )
    apps = parts.select(
        F.concat(F.lit("/Applications/"), F.col("p_type"), F.lit(".app/Contents//MacOS/"), F.col("p_name"), F.lit("/")).alias("raw")
    )
    urls = table(spark, sf, "pages").select(F.regexp_replace("url", "^https?://[^/]*", "").alias("raw"))
    return windows.unionByName(quoted).unionByName(apps).unionByName(urls).distinct()


def requested_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A request list: for every order the hash its customer would have when finished."""
    orders = table(spark, sf, "orders")
    return orders.select(
        app_id(F.col("o_orderpriority")).alias("applicationid"),
        text_hash(F.col("o_custkey"), F.lit("F")).alias("hash"),
        F.when(F.col("o_orderpriority") < "4", "1").otherwise("2").alias("ostype"),
        F.lit("").alias("recordtype"),
    )


def outcome_events(spark: SparkSession, sf: str) -> DataFrame:
    return event_outcomes(table(spark, sf, "events"))


def micros(moment: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    since = moment - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    parts = {"DAY": 86_400_000_000, "HOUR": 3_600_000_000, "MINUTE": 60_000_000, "SECOND": 1_000_000}
    total = F.lit(0).cast("long")
    for field, size in parts.items():
        total = total + (F.extract(F.lit(field), since) * F.lit(size).cast("long")).cast("long")
    return total


def event_outcomes(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"), micros(F.col("ts")).alias("time"), F.lit("DeleteResponse").alias("kind"),
        F.col("event_type").alias("app"), F.col("user_id").cast("string").alias("fid"),
        F.concat(F.lit("HTTP "), (F.col("event_id") % 6).cast("string")).alias("detail"),
        state_of(F.col("event_id")).alias("status"),
    )


def rule_set(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping rules per application, from narrow to broad, in rank order."""
    parts = table(spark, sf, "part")
    base = F.concat(F.lit("c:\\program files\\"), F.lower("p_brand"))
    launcher = F.concat(base, F.lit("\\launcher.exe"))

    def rules(level: int, path: Column, process: Column, certificate: Column) -> DataFrame:
        return parts.select(
            app_id(F.col("p_type")).alias("app"), F.lit(level).alias("level"), path.alias("path"),
            certificate.cast("string").alias("certificate"), process.cast("string").alias("process_path"),
            F.lit(None).cast("string").alias("created_by"),
        ).distinct()

    kind = F.lower("p_type")
    by_name = rules(1, F.concat(base, F.lit("\\"), kind, F.lit("\\*\\"), F.col("p_name"), F.lit(".exe")), launcher, F.lit(None))
    by_size = rules(2, F.concat(base, F.lit("\\"), kind, F.lit("\\"), F.col("p_size"), F.lit(".*")), launcher, F.lit(None))
    by_cert = rules(3, F.concat(base, F.lit("\\"), kind, F.lit("\\*")), F.lit(None), F.concat(F.lit("CN="), F.col("p_name")))
    broad = rules(4, F.lit("c:\\program files\\*.exe"), launcher, F.lit(None))
    return by_name.unionByName(by_size).unionByName(by_cert).unionByName(broad)


def risky_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules in safe, writable and system locations, with and without identities."""
    parts = table(spark, sf, "part")
    size = F.col("p_size") % 10
    path = (
        F.when(size == 0, F.lit("c:\\users\\*\\*"))
        .when(size == 1, F.concat(F.lit("c:\\programdata\\"), F.lower("p_brand"), F.lit("\\*.dll")))
        .when(size == 2, F.concat(F.lit("c:\\windows\\temp\\"), F.col("p_name"), F.lit(".exe")))
        .when(size == 3, F.concat(F.lit("/users/bob/"), F.lower("p_type"), F.lit("/.venv/lib/python/"), F.col("p_name"), F.lit(".so")))
        .when(size == 4, F.lit("/users/*/library/python/*"))
        .when(size == 5, F.lit("/applications/*/*"))
        .otherwise(F.concat(F.lit("c:\\program files\\"), F.lower("p_brand"), F.lit("\\*\\*")))
    )
    key = F.col("p_partkey") % 6
    process = (
        F.when(key == 0, F.lit("c:\\windows\\system32\\msiexec.exe"))
        .when(key == 1, F.lit("/users/bob/bin/python3.11"))
        .when(key == 2, F.lit("/system/library/privateframeworks/x.framework/helper"))
        .when(key == 3, F.concat(F.lit("c:\\program files\\"), F.lower("p_brand"), F.lit("\\app.exe")))
        .when(key == 4, F.lit("/applications/*"))
    )
    return parts.select(
        path.alias("path"),
        F.when(F.col("p_retailprice") < 950, F.concat(F.lit("o="), F.lower("p_type"))).alias("certificate"),
        process.alias("process_path"),
        F.when(F.col("p_retailprice") < 920, F.col("p_brand")).alias("created_by"),
    ).distinct()
