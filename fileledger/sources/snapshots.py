"""Application-file record snapshots and application metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fileledger import fixed_values as V
from fileledger.functions.hashes import canonical_uuid, primary_hash, valid_hash
from fileledger.operators.validate import application_violations, require
from fileledger.schemas import APPLICATIONS, RECORD_FIELDS, RECORD_TYPES

_UNPARSED = "unparsed:"


def parse_record_json(rows: DataFrame, text: str = "value") -> DataFrame:
    """Records from JSON text: known fields typed, all others kept in ``extras``.

    A known field whose value does not fit its type is also kept there, because
    dropping it would make an unusual record look plain.
    """
    parsed = rows.withColumns(
        {
            "_known": F.from_json(text, RECORD_FIELDS),
            "_all": F.from_json(text, "map<string,string>"),
        }
    )
    entries = F.map_entries("_all")
    unknown = F.map_from_entries(F.filter(entries, lambda e: ~e["key"].isin(list(RECORD_TYPES))))
    typed = [n for n, t in RECORD_TYPES.items() if not isinstance(t, T.StringType)]
    mismatched = F.filter(
        F.array(
            *[
                F.struct(F.lit(n).alias("key"), F.concat(F.lit(_UNPARSED), F.try_element_at("_all", F.lit(n))).alias("value"))
                for n in typed
            ]
        ),
        lambda e: e["value"].isNotNull(),
    )
    parsed_nulls = F.array(*[F.when(F.col(f"_known.{n}").isNull(), F.lit(n)) for n in typed])
    mismatched = F.filter(mismatched, lambda e: F.array_contains(F.array_compact(parsed_nulls), e["key"]))
    return parsed.select(
        *[c for c in rows.columns if c != text],
        "_known.*",
        F.map_concat(unknown, F.map_from_entries(mismatched)).alias("extras"),
    )


def read_records_json(spark: SparkSession, path: str) -> DataFrame:
    """Landed snapshots as JSON lines; partition folders become columns."""
    return parse_record_json(spark.read.text(path))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Landed snapshots as Parquet, laid out by organization and application.

    Filters on those folders prune files; other filters are pushed to the scan.
    """
    return spark.read.parquet(path)


def with_record_keys(records: DataFrame) -> DataFrame:
    """Add the record's own application and hash keys, which reads and joins use."""
    app = canonical_uuid(F.col("applicationId"))
    return records.withColumns(
        {"app": app, "hash_key": primary_hash(F.col("hash"), F.col("originalHash"))}
    )


def records_with_hash(records: DataFrame, application: str, wanted: str | Column) -> DataFrame:
    """Records of one application whose primary hash is the given one.

    On a snapshot written with its keys both conditions reach the Parquet scan.
    """
    keyed = records if "hash_key" in records.columns else with_record_keys(records)
    wanted = F.lit(wanted) if isinstance(wanted, str) else wanted
    return keyed.filter((F.col("app") == application) & (F.col("hash_key") == valid_hash(wanted)))


def read_applications(spark: SparkSession, path: str, organization: str) -> DataFrame:
    """Application metadata, rejected when owner, type or identity is wrong."""
    rows = spark.read.schema(APPLICATIONS).json(path)
    require(application_violations(rows, organization))
    return rows


def search_results(rows: DataFrame, organization: str, os_type: int) -> DataFrame:
    """Order application search results by name then ID.

    A foreign owner, another operating system, a built-in application or a
    repeated ID rejects the whole result.
    """
    require(application_violations(rows, organization, (os_type,)))
    return _named(rows).orderBy(F.lower("name"), "applicationId")


def find_applications(applications: DataFrame, query: str, os_type: int, organization: str) -> DataFrame:
    """Custom applications of one system whose name contains the text."""
    needle = F.lower(F.lit(query.strip()))
    hits = applications.filter(
        F.contains(F.lower("name"), needle)
        & (F.col("osType") == os_type)
        & ~F.col("isBuiltIn")
        & (canonical_uuid(F.col("organizationId")) == organization)
    )
    return _named(hits).orderBy(F.lower("name"), "applicationId")


def _named(rows: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit(V.UNNAMED_APPLICATION))
    return rows.select(
        canonical_uuid(F.col("applicationId")).alias("applicationId"), name.alias("name"), "osType"
    )
