"""Column functions for free text, note labels and certificates.

Chains are written so that each input column is referenced once where possible:
a missing value travels as an empty string and becomes null at the end. That
keeps expression trees small and inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fileledger import fixed_values as V

# Every character the note format treats as white space, as a Java class.
_SPACE = (
    r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
# The same characters one by one.
_SPACES = (
    "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
_LABEL_MARK, _VALUE_MARK = "\u0001", "\u0002"


def strip(value: Column) -> Column:
    """Trim all white space, not only blanks. Reads only the ends of the text, unlike a pattern."""
    return F.btrim(value, F.lit(_SPACES))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, however often ``use`` names it.

    Inside conditions Spark shares no subexpressions: a value named twice there is computed
    twice, and four times a level further up.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_capture(value: Column, pattern: str, group: int) -> Column:
    """A group of the pattern's first match, null without one; names the value once and needs no lambda."""
    return F.get(F.regexp_extract_all(value, F.lit(pattern), F.lit(group)), F.lit(0))


def none_if_empty(value: Column) -> Column:
    return once(value, lambda v: F.when(v != "", v))


def tidy(value: Column) -> Column:
    """Trimmed text with single blanks; '' for null, null words and blanks."""
    spaced = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), f"{_SPACE}+", " ")
    return tidy_part(spaced)


def tidy_part(value: Column) -> Column:
    """``tidy`` for a piece cut out of tidy text, whose blanks are single already."""
    return F.regexp_replace(F.trim(value), rf"(?i)^(?:{V.NULL_WORDS})$|\s+RE\(\d+\)$", "")


def normalize_spaces(value: Column) -> Column:
    return none_if_empty(tidy(value))


def trimmed(value: Column) -> Column:
    """Null-safe trim: missing text is ''."""
    return strip(F.coalesce(value.cast("string"), F.lit("")))


def first_match(text: Column, *patterns: str) -> Column:
    """First capture of the first pattern that hits in tidy text, else ''."""
    if len(patterns) == 1:
        return tidy_part(F.regexp_extract(text, patterns[0], 1))
    hit = F.regexp_extract(text, patterns[0], 1)
    return F.when(text.rlike(patterns[0]), tidy_part(hit)).otherwise(first_match(text, *patterns[1:]))


def mark_labels(note: Column) -> Column:
    """Surround every label of a note with control marks so that values can be cut out."""
    labels = "|".join(V.LABELS.values())
    plain = F.translate(note, _LABEL_MARK + _VALUE_MARK, "")
    return F.regexp_replace(plain, f"(?i)({labels})", f"{_LABEL_MARK}$1{_VALUE_MARK}")


def label_value(marked: Column, kind: str) -> Column:
    """Value after the last label of a kind, '' without one; a greedy prefix finds the last."""
    pattern = (
        f"(?is)^.*{_LABEL_MARK}(?:{V.LABELS[kind]}){_VALUE_MARK}([^{_LABEL_MARK}]*)"
    )
    return tidy_part(F.regexp_extract(marked, pattern, 1))


def canonical_label(label: Column) -> Column:
    """Kind of a label spelling; an unknown label is itself without its colon."""
    text = strip(F.lower(label))
    kind = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, spellings in (
        ("hostname", "hostname|host|computer|device|machine"),
        ("sha256_hash", "sha256"),
        ("hash", "hash:$"),
        ("path", "path"),
        ("process_path", "process|image|file|binary"),
        ("certificate_raw", "cert|publisher|thumbprint"),
        ("created_by", "created by"),
        ("added_by", "added by"),
    ):
        kind = kind.when(text.rlike(f"^(?:{spellings})"), F.lit(name))
    return kind.otherwise(F.regexp_replace(text, ":+$", ""))


def note_hashes(note: Column) -> Column:
    """md5, sha1 and sha256 from the text, as a struct: the longest kind present wins."""
    kinds = {"sha256": V.HASH64, "sha1": V.HASH40, "md5": V.HASH32}

    def chosen(found: Column) -> Column:
        sha256, sha1, md5 = (found[kind] for kind in kinds)
        return F.struct(
            F.when((sha256 == "") & (sha1 == "") & (md5 != ""), md5).alias("md5"),
            F.when((sha256 == "") & (sha1 != ""), sha1).alias("sha1"), F.when(sha256 != "", sha256).alias("sha256"),
        )

    return once(F.struct(*[F.regexp_extract(note, pattern, 1).alias(kind) for kind, pattern in kinds.items()]), chosen)


def usable_note(note: Column) -> Column:
    """At most one target-path label, otherwise the note is ambiguous."""
    return F.regexp_count(F.coalesce(note, F.lit("")), F.lit(V.PATH_LABEL_COUNT)) <= 1


# --- certificates ----------------------------------------------------------


def split_certificates(text: Column) -> Column:
    """Array of certificates from tidy text: a JSON list of {subject, sha} or a ';' list."""
    empty_parts = rf"(?i)(?<=^|;)\s*(?:{V.NULL_WORDS})\s*(?=;|$)|\s+RE\(\d+\)\s*(?=;|$)"
    listed = F.array_remove(F.split(F.regexp_replace(text, empty_parts, ""), r"\s*;\s*"), "")
    is_json = text.rlike(r"^\[.*\]$")
    items = F.from_json(F.when(is_json, text), "array<struct<subject:string,sha:string>>")

    def compose(item: Column) -> Column:
        return F.concat_ws(
            " | sha=",
            none_if_empty(tidy(item["subject"])), none_if_empty(tidy(item["sha"])),
        )

    parsed = F.array_remove(F.transform(items, compose), "")
    return F.when(is_json & (F.size(parsed) > 0), parsed).otherwise(listed)


def primary_certificate(certificates: Column) -> Column:
    """First signer that is not the generic one, else the first."""
    specific = F.filter(
        certificates, lambda c: ~F.contains(F.lower(c), F.lit(V.GENERIC_SIGNER))
    )
    return F.coalesce(F.try_element_at(specific, F.lit(1)), F.try_element_at(certificates, F.lit(1)))


def _unquoted_lower(value: Column) -> Column:
    return F.lower(F.trim(F.btrim(F.btrim(tidy(value), F.lit('"')), F.lit("'"))))


def _subject_part(lowered: Column) -> Column:
    """Organization of a subject, else its common name, else the whole text."""
    def part(low: Column) -> Column:
        organization = none_if_empty(F.trim(F.regexp_extract(low, V.CERT_ORGANIZATION, 1)))
        common_name = none_if_empty(F.trim(F.regexp_extract(low, V.CERT_COMMON_NAME, 1)))
        return F.coalesce(organization, common_name, low)

    return once(lowered, part)


def _known_vendor(vendor: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in V.CERT_VENDORS.items() for x in pair])
    return once(vendor, lambda v: F.coalesce(F.try_element_at(table, v), v))


def certificate_vendor(value: Column) -> Column:
    """Vendor of a certificate: organization, else common name, else the text."""
    vendor = F.btrim(_subject_part(_unquoted_lower(value)), F.lit('"'))
    return F.when(value.isNotNull(), none_if_empty(_known_vendor(vendor)))


def certificate_condition(value: Column) -> Column:
    """Certificate in rule form: ``o=<vendor>``."""
    vendor = F.trim(F.regexp_replace(_subject_part(_unquoted_lower(value)), r"^o\s*=\s*", ""))
    return F.when(
        value.isNotNull(), F.concat(F.lit("o="), none_if_empty(_known_vendor(vendor)))
    )


# --- creators and inline metadata ------------------------------------------


def creator_in(value: Column) -> Column:
    """Creator named in a trailing 'added by:' / 'merged by:' note, else null."""
    return F.coalesce(
        none_if_empty(tidy_part(F.regexp_extract(value, V.INLINE_ADDED_BY, 1))),
        none_if_empty(tidy_part(F.regexp_extract(value, V.INLINE_MERGED_BY, 1))),
    )


def without_creator(value: Column) -> Column:
    """The value before its trailing creator note."""
    return normalize_spaces(F.regexp_replace(value, f"{V.INLINE_ADDED_BY}|{V.INLINE_MERGED_BY}", ""))


def clean_inline_metadata(value: Column) -> Column:
    """Drop trailing creator notes and ``process=`` / ``cert=`` style tails."""
    return normalize_spaces(F.regexp_replace(without_creator(value), V.INLINE_FIELD, ""))


# --- wildcard matching -----------------------------------------------------


def like_pattern(pattern: Column) -> Column:
    """SQL LIKE form of a pattern in which only ``*`` is special."""
    escaped = F.regexp_replace(pattern, r"([\\%_])", r"\\$1")
    return F.replace(escaped, F.lit("*"), F.lit("%"))


def matches(pattern: Column, value: Column, ignore_case: bool = True) -> Column:
    """Whole-value wildcard match. An empty pattern matches; an empty value does not.

    Patterns with up to two wildcards, nearly all of them, are decided by plain
    text comparisons. LIKE with a pattern column compiles it for every row, so it
    runs only for what is left.
    """
    if ignore_case:
        pattern, value = F.lower(pattern), F.lower(value)
    wildcards = F.length(pattern) - F.length(F.replace(pattern, F.lit("*"), F.lit("")))
    before, after = F.substring_index(pattern, "*", 1), F.substring_index(pattern, "*", -1)
    inner = F.length(value) - F.length(before) - F.length(after)
    middle = F.contains(
        F.substring(value, F.length(before) + 1, inner), F.split_part(pattern, F.lit("*"), F.lit(2))
    )
    starred = (
        F.startswith(value, before)
        & F.endswith(value, after)
        & (inner >= 0)
        & F.when(wildcards == 1, F.lit(True))
        .when(wildcards == 2, middle)
        .otherwise(F.call_function("like", value, like_pattern(pattern)))
    )
    hit = F.when(wildcards == 0, value == pattern).otherwise(starred)
    return F.when(F.coalesce(pattern, F.lit("")) == "", F.lit(True)).otherwise(
        F.coalesce((value != "") & hit, F.lit(False))
    )
