"""Free-text notes to typed observation columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger import fixed_values as V
from fileledger.functions.paths import (
    embedded_path, embedded_parts, macos_process_path, macos_target_path, normalize_path,
    normalize_tidy_path, renormalized, shorten_leaf,
)
from fileledger.functions.risk import looks_like_path
from fileledger.functions.text import (
    certificate_vendor, first_match, label_value, mark_labels, none_if_empty,
    normalize_spaces, note_hashes, primary_certificate, split_certificates, tidy,
)
from fileledger.sources.observations import with_canonical_columns

NOTE_FIELDS = [
    "timestamp_utc", "hostname", "md5_hash", "sha256_hash", "path", "process_path",
    "certificate_raw", "certificate_primary", "certificate_all", "created_by", "added_by",
]


def parse_notes(df: DataFrame, note: str = "notes", prefix: str = "note_") -> DataFrame:
    """Add the parsed fields of a note, each named ``prefix + field``.

    ``sha1`` is an extra: a 40-digit hash is recognised but is neither md5 nor sha256.
    """
    staged = df.withColumn("_note", tidy(F.col(note)))
    staged = staged.withColumn("_marked", mark_labels(F.col("_note")))
    staged = staged.withColumns({f"_l_{kind}": label_value(F.col("_marked"), kind) for kind in V.LABELS})
    text, raw_hash = F.col("_note"), F.col("_l_hash")
    listed = split_certificates(F.col("_l_certificate_raw"))
    staged = staged.withColumns(
        {
            "_path": normalize_tidy_path(F.col("_l_path")),
            "_found": F.when(F.col("_l_path") == "", first_match(text, V.WINDOWS_PATH, V.POSIX_PATH)),
            "_process": normalize_tidy_path(F.col("_l_process_path")),
            "_cn": first_match(text, V.CERT_CN),
            "_md5": F.when(F.length(raw_hash) == 32, raw_hash),
            "_sha256": F.coalesce(
                none_if_empty(F.col("_l_sha256_hash")), F.when(F.length(raw_hash) == 64, raw_hash)
            ),
            "_certs": listed,
        }
    )
    labelled = F.col("_md5").isNotNull() | F.col("_sha256").isNotNull()
    staged = staged.withColumn("_hashes", F.when(~labelled, note_hashes(text)))
    found_md5, found_sha1, found_sha256 = (F.col("_hashes")[kind] for kind in ("md5", "sha1", "sha256"))
    certs = F.when(F.size("_certs") > 0, F.col("_certs")).when(F.col("_cn") != "", F.array("_cn"))
    fields = {
        "timestamp_utc": none_if_empty(first_match(text, V.TIMESTAMP)),
        "hostname": none_if_empty(F.col("_l_hostname")),
        "md5_hash": F.when(labelled, F.col("_md5")).otherwise(found_md5),
        "sha256_hash": F.when(labelled, F.col("_sha256")).otherwise(found_sha256),
        "sha1": found_sha1,
        "path": none_if_empty(
            F.when(F.col("_path") != "", F.col("_path")).otherwise(
                normalize_tidy_path(F.coalesce("_found", F.lit("")))
            )
        ),
        "process_path": none_if_empty(F.col("_process")),
        "certificate_raw": none_if_empty(F.col("_l_certificate_raw")),
        "certificate_primary": primary_certificate(certs),
        "certificate_all": F.array_join(certs, "; "),
        "created_by": none_if_empty(F.col("_l_created_by")),
        "added_by": none_if_empty(F.col("_l_added_by")),
    }
    return staged.select(*df.columns, *[c.alias(prefix + n) for n, c in fields.items()])


def fingerprint_column(
    path: str = "path", process: str = "process_path", certificate: str = "certificate_primary",
    creator: str = "created_by", sha256: str = "sha256_hash", md5: str = "md5_hash",
) -> Column:
    """Text that two observations of the same thing share."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in (path, process, certificate, creator)]
    return F.concat_ws(" | ", *parts, F.coalesce(F.col(sha256), F.col(md5), F.lit("")))


def apply_parsing(df: DataFrame) -> DataFrame:
    """Observation rows: one per embedded path, note values preferred over direct columns.

    Input columns may use any known spelling (notes, path, process path, ...).
    All other columns pass through.
    """
    source = with_canonical_columns(df)
    known = {
        "path", "process_path", "created_by", "certificate_primary", "certificate_raw",
        "md5_or_sha256", "sha256_hash", "hostname", "timestamp_utc", "count",
    }
    passed = [c for c in source.columns if c not in known]

    def direct(name: str) -> Column:
        return F.col(name) if name in source.columns else F.lit(None).cast("string")

    if "path" in source.columns:
        source = source.withColumn("path", F.explode_outer(embedded_parts(direct("path"))))
        source = source.withColumn("path", embedded_path(F.col("path")))
    if "notes" in source.columns:
        parsed = parse_notes(source)
    else:
        parsed = source.withColumns({f"note_{f}": F.lit(None).cast("string") for f in [*NOTE_FIELDS, "sha1"]})

    mixed = normalize_spaces(direct("md5_or_sha256"))
    raw_certificate = normalize_spaces(direct("certificate_raw"))
    if "certificate_raw" in source.columns:
        certificates = split_certificates(raw_certificate)
    else:
        certificates = F.lit(None).cast("array<string>")
    count = direct("count").try_cast("double").try_cast("long")
    staged = parsed.select(
        *passed,
        F.coalesce("note_path", direct("path")).alias("path"),
        F.coalesce("note_process_path", normalize_path(direct("process_path"))).alias("process_path"),
        F.coalesce("note_created_by", normalize_spaces(direct("created_by"))).alias("created_by"),
        F.coalesce("note_certificate_raw", raw_certificate).alias("certificate_raw"),
        F.coalesce(
            "note_certificate_primary", normalize_spaces(direct("certificate_primary")),
            primary_certificate(certificates),
        ).alias("certificate_primary"),
        F.coalesce("note_certificate_all", none_if_empty(F.array_join(certificates, "; "))).alias("certificate_all"),
        F.coalesce("note_hostname", normalize_spaces(direct("hostname"))).alias("hostname"),
        F.coalesce("note_timestamp_utc", normalize_spaces(direct("timestamp_utc"))).alias("timestamp_utc"),
        F.coalesce("note_md5_hash", F.when(F.length(mixed) == 32, mixed)).alias("md5_hash"),
        F.coalesce(
            "note_sha256_hash", normalize_spaces(direct("sha256_hash")), F.when(F.length(mixed) == 64, mixed)
        ).alias("sha256_hash"),
        F.col("note_added_by").alias("added_by"),
        F.col("note_sha1").alias("sha1"),
        F.coalesce(count, F.lit(1)).alias("count"),
    )
    return refine_observations(staged)


def refine_observations(staged: DataFrame) -> DataFrame:
    """Split, clean and fingerprint observations whose notes are parsed already."""
    certificates = [
        c for c in ("certificate_primary", "certificate_raw", "certificate_all") if c in staged.columns
    ]
    # A note can itself hold several paths in one value.
    staged = staged.withColumn("path", F.explode_outer(embedded_parts(F.col("path"))))
    staged = staged.withColumn("path", embedded_path(F.col("path")))
    staged = staged.withColumns(
        {
            **{c: certificate_vendor(F.col(c)) for c in certificates},
            # Creator notes in a path are already gone: normalising a path cuts them off.
            "path": macos_target_path(F.col("path")),
            "process_path": macos_process_path(renormalized(F.col("process_path"))),
        }
    )
    # A path in the certificate column is the process, when none is known.
    moved = F.col("process_path").isNull() & looks_like_path(F.col("certificate_primary"))
    staged = staged.withColumn("_moved", moved)
    cleared = {c: F.when(~F.col("_moved"), F.col(c)) for c in certificates}
    staged = staged.withColumns(
        {
            "process_path": F.coalesce(
                F.col("process_path"), F.when(F.col("_moved"), normalize_path(F.col("certificate_primary")))
            ),
            **cleared,
        }
    ).drop("_moved")
    populated = [F.col(c).isNotNull().cast("int") for c in ("path", "process_path", "certificate_primary", "created_by")]
    return staged.withColumns(
        {
            "wildcard_path": shorten_leaf(F.col("path")),
            "condition_count": sum(populated[1:], populated[0]),
            "row_fingerprint": fingerprint_column(),
        }
    )


def combined_review(parsed: DataFrame) -> DataFrame:
    """Parsed observations under display names."""
    names = {
        "path": "Path", "process_path": "Process Path", "certificate_primary": "Certificate",
        "created_by": "Created By", "sha256_hash": "SHA256", "md5_hash": "MD5",
        "hostname": "Host Name", "timestamp_utc": "Timestamp", "count": "Count", "notes": "Notes",
    }
    return parsed.select(*[F.col(c).alias(n) for c, n in names.items() if c in parsed.columns])
