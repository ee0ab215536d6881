"""Column functions for identifiers, hashes and record eligibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fileledger import fixed_values as V
from fileledger.functions.text import first_capture, none_if_empty, once, strip

_HEX_HASH = r"^(?:[A-F0-9]{32}|[A-F0-9]{40}|[A-F0-9]{64})$"
_DECORATION = r"urn:|uuid:|(?:^|(?<=:))[{}]+|[{}]+$|-"
_DIGITS = "^([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})$"
_CANONICAL = "^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$"
_HEX_DIGITS = "^[0-9a-f]{32}$"
_HYPHENATED = r"^\{?([0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})\}?$"


def canonical_uuid(value: Column) -> Column:
    """Lower-case hyphenated UUID, null when the text is not one.

    Accepts the usual decorations: ``urn:uuid:`` prefixes, braces and any hyphens.
    """

    def spelled(text: Column) -> Column:
        parts = [F.substring(text, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        plain = F.regexp_replace(text, _DECORATION, "")
        hyphenated = F.regexp_replace(plain, _DIGITS, "$1-$2-$3-$4-$5")
        # The usual spellings are told by one pattern each; only others are searched for decorations.
        # Digits alone are told by one pattern; only other spellings are searched for decorations.
        return F.when(text.rlike(_HEX_DIGITS), F.concat_ws("-", *parts)).otherwise(
            none_if_empty(F.regexp_extract(hyphenated, _CANONICAL, 0))
        )

    text = F.lower(value.cast("string"))
    # The usual spelling takes one pattern in compiled code and never reaches the rest.
    return F.coalesce(first_capture(text, _HYPHENATED, 1), once(text, spelled))


def hash_text(value: Column) -> Column:
    """Trimmed upper-case hash text, '' when missing."""
    return strip(F.upper(F.coalesce(value.cast("string"), F.lit(""))))


def is_hash(value: Column) -> Column:
    return F.coalesce(value.rlike(_HEX_HASH), F.lit(False))


def valid_hash(value: Column) -> Column:
    """Upper-case 32, 40 or 64 digit hash, null when invalid."""
    return first_capture(hash_text(value), _HEX_HASH, 0)


def primary_hash(hash_: Column, original: Column) -> Column:
    """The record's hash, else its original hash; '' when it has neither."""
    text = hash_.cast("string")
    return hash_text(F.coalesce(F.when(text != "", text), original))


def all_hashes(*columns: Column) -> Column:
    """Distinct non-empty hashes of a record as an array."""
    return F.array_remove(F.array_distinct(F.array(*[hash_text(c) for c in columns])), "")


def numeric_id(value: Column) -> Column:
    """Ordering key of an identifier: ids are unbounded integers, not text."""
    return value.try_cast("decimal(38,0)")


def canonical_id(value: Column) -> Column:
    """The identifier without leading zeros; ``007`` and ``7`` are the same one."""
    return F.regexp_replace(value.cast("string"), "^0+(?=.)", "")


def id_order(value: Column) -> Column:
    """Numeric order of identifiers of any length; equal numbers are ordered by their text."""
    canonical = canonical_id(value)
    return F.struct(F.length(canonical).alias("digits"), canonical.alias("number"), value.cast("string").alias("text"))


def valid_id(value: Column) -> Column:
    return F.coalesce(value.cast("string").rlike("^[0-9]+$") & (canonical_id(value) != "0"), F.lit(False))


def unknown_fields(extras: Column) -> Column:
    """Names of populated fields whose meaning is not known; ``false`` counts as populated."""
    return F.map_keys(F.map_filter(extras, lambda k, v: v.isNotNull() & (v != "")))


def plain_hash_record(columns: dict[str, Column], main: Column | None = None) -> Column:
    """True when a record identifies a file by its hash alone.

    ``columns`` maps field names to columns; an absent field is an empty one. ``main`` is the
    record's ``primary_hash`` where it is a column already.
    """

    def field(name: str, kind: str = "string") -> Column:
        return columns[name].cast(kind) if name in columns else F.lit(None).cast(kind)

    def blank(name: str) -> Column:
        return F.coalesce(field(name), F.lit("")) == ""

    def absent_or_false(name: str) -> Column:
        return ~F.coalesce(field(name, "boolean"), F.lit(False))

    if main is None:
        main = primary_hash(field("hash"), field("originalHash"))

    def agrees(name: str) -> Column:
        return blank(name) | (F.upper(field(name)) == main)

    conditions = [
        is_hash(main),
        F.coalesce(field("isHashOnly", "boolean"), F.lit(False)),
        absent_or_false("keyFile"),
        absent_or_false("originalKeyFile"),
        field("minSize").isNull(),
        field("maxSize").isNull(),
        agrees("originalHash"),
        agrees("sha256"),
        agrees("sha256Hash"),
    ]
    conditions += [
        blank(name)
        for name in (
            "fullPath", "cert", "processPath", "installedBy", "originalFullPath",
            "originalCert", "originalProcessPath", "originalInstalledBy", "name", "recordType",
        )
    ]
    # A populated column of unknown meaning may narrow what the record matches.
    conditions += [blank(name) for name in columns if name not in V.KNOWN_FIELDS and name not in V.DERIVED_FIELDS]
    if "extras" in columns:
        conditions.append(F.coalesce(F.size(unknown_fields(columns["extras"])), F.lit(0)) <= 0)
    result = conditions[0]
    for condition in conditions[1:]:
        result = result & condition
    return result


def record_fingerprint(columns: dict[str, Column]) -> Column:
    """SHA-256 over the record's populated fields in name order.

    Nulls are left out, so that a column only one of two snapshots has counts when it is filled.
    A map has no fixed entry order, so the unknown fields go in sorted.
    """
    parts = []
    for name in sorted(columns):
        column = columns[name]
        if name == "extras":
            column = F.array_sort(F.map_entries(column))
        parts.append(column.alias(name))
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "true"}), 256)


def os_name(os_type: Column) -> Column:
    result = F.when(F.lit(False), F.lit(""))
    for code, name in V.OS_NAMES.items():
        result = result.when(os_type == code, F.lit(name))
    return result.otherwise(F.lit("Unknown"))
