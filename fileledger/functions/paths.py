"""Column functions over Windows and POSIX paths.

Segment rules are single regular expressions with look-around on the separator,
so a path is rewritten in one pass inside code generation instead of being split
into an array and mapped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fileledger import fixed_values as V
from fileledger.functions.text import none_if_empty, once, tidy
from fileledger.settings import RuleSettings

BACKSLASH = "\\"
_WIN, _POSIX = r"\\", "/"
_IS_WINDOWS = r"(?i)^[a-z]:[\\/]"

_ALWAYS_VOLATILE = [
    *V.LANGUAGE_FOLDERS, V.SEGMENT_VERSION, V.SEGMENT_RELEASE, V.SEGMENT_YEAR, V.SEGMENT_GUID
]
_COLLAPSED = "|".join([*_ALWAYS_VOLATILE, V.SEGMENT_LONG_NUMBER, V.SEGMENT_LONG_HEX])


def _volatile(separators: str) -> str:
    return "|".join(
        [*_ALWAYS_VOLATILE, V.SEGMENT_MIXED, V.SEGMENT_HEX, f"[^{separators}]*{V.SEGMENT_TMP}"]
    )


def _segment(body: str, separator: str) -> str:
    """Pattern of one whole segment, with optional blanks around it."""
    return rf"(?i)(?<=^|{separator})\s*(?:{body})\s*(?={separator}|$)"


def is_windows(path: Column) -> Column:
    return path.rlike(_IS_WINDOWS)


def is_posix(path: Column) -> Column:
    return path.startswith("/")


def has_backslash(path: Column) -> Column:
    return F.contains(path, F.lit(BACKSLASH))


def separator(path: Column) -> Column:
    return F.when(has_backslash(path), F.lit(BACKSLASH)).otherwise(F.lit("/"))


def stars(value: Column) -> Column:
    """Number of wildcards in a value, 0 for null."""
    text = F.coalesce(value, F.lit(""))
    return F.length(text) - F.length(F.replace(text, F.lit("*"), F.lit("")))


# Metadata that slipped into a path: everything from the first of these on is cut.
_TAIL = "|".join(
    [V.INLINE_FIELD, V.INLINE_ADDED_BY.replace("by:", f"by:(?!{V.INLINE_FIELD[4:]})"), V.INLINE_MERGED_BY]
)
# ``\G`` continues where the last match ended, so these rewrite all separators of
# strings that start like a path, and nothing else.
_WIN_SEPARATORS = r"(^[a-z]:|\G(?!^)[^\\/]*)[\\/]+"
_POSIX_SEPARATORS = r"(^|\G(?!^)[^/]+)/+"


def normalize_tidy_path(text: Column) -> Column:
    """``normalize_path`` of text that is tidy already; '' stays ''."""
    raw = F.btrim(F.btrim(text, F.lit('"')), F.lit("'"))
    raw = F.lower(F.trim(F.regexp_replace(raw, _TAIL, "")))
    raw = F.regexp_replace(raw, _WIN_SEPARATORS, r"$1\\")
    raw = F.regexp_replace(raw, _POSIX_SEPARATORS, "$1/")
    return F.regexp_replace(raw, "^(/.+)/$", "$1")


def normalize_path(value: Column) -> Column:
    """Canonical lower-case path without quotes, inline metadata or repeated separators."""
    return none_if_empty(normalize_tidy_path(tidy(value)))


def renormalized(path: Column) -> Column:
    """A second pass for values that were quoted twice; all others are already canonical."""
    return F.when(path.rlike("^[\"']|[\"']$"), normalize_path(path)).otherwise(path)


def path_prefixes(path: Column) -> Column:
    """'' and every leading part of a path that ends with a separator."""
    tokens = F.split(path, r"(?<=[\\/])")
    return F.transform(
        F.sequence(F.lit(0), F.size(tokens) - 1),
        lambda i: F.array_join(F.slice(tokens, F.lit(1), i), ""),
    )


def literal_head(pattern: Column) -> Column:
    """Leading whole segments of a pattern before its first wildcard, with the separator."""
    return F.regexp_extract(pattern, r"^([^*]*[\\/])", 1)


def literal_leaf(pattern: Column) -> Column:
    """Last segment of a pattern when it has no wildcard, else ''."""
    return F.regexp_extract(pattern, r"[\\/]([^*\\/]+)$", 1)


def wildcard_user_profile(path: Column) -> Column:
    """Replace the profile folder name by ``*``."""
    path = F.regexp_replace(path, r"(?i)^(c:\\users\\)[^\\]+", "$1*")
    return F.regexp_replace(path, "(?i)^(/users/)[^/]+", "$1*")


def collapse_versions(path: Column) -> Column:
    """Replace version, locale, GUID and long-hash segments by ``*``."""
    return F.when(
        has_backslash(path), F.regexp_replace(path, _segment(_COLLAPSED, _WIN), "*")
    ).otherwise(F.regexp_replace(path, _segment(_COLLAPSED, _POSIX), "*"))


def generalized_path(path: Column, settings: RuleSettings) -> Column:
    """A normalised path after the profile and version wildcards a profile allows."""
    if settings.paths.any_profile:
        path = wildcard_user_profile(path)
    if settings.paths.any_version:
        path = collapse_versions(path)
    return path


def is_volatile(segment: Column) -> Column:
    """True for segments that change between installs: versions, locales, random names."""
    return F.coalesce(segment.rlike(rf"(?i)^\s*(?:{_volatile(_WIN + _POSIX)})\s*$"), F.lit(False))


def volatile_wildcard(segment: Column) -> Column:
    """Wildcard of a volatile segment; a ``.tmp`` suffix is kept."""
    suffix = F.regexp_extract(F.trim(F.lower(segment)), rf"^.*?({V.SEGMENT_TMP})$", 1)
    return F.concat(F.lit("*"), suffix)


def volatile_shape(path: Column) -> Column:
    """The path with each volatile segment replaced by a mark."""
    return F.when(
        has_backslash(path),
        F.regexp_replace(path, _segment(_volatile(_WIN), _WIN), V.VOLATILE_MARK),
    ).otherwise(F.regexp_replace(path, _segment(_volatile(_POSIX), _POSIX), V.VOLATILE_MARK))


def root(path: Column) -> Column:
    """Drive (or first component) of a path, '/' for POSIX paths."""
    return F.when(is_posix(path) & ~has_backslash(path), F.lit("/")).otherwise(
        F.when(has_backslash(path), F.substring_index(path, BACKSLASH, 1)).otherwise(
            F.substring_index(path, "/", 1)
        )
    )


def segments(path: Column) -> Column:
    """Non-empty segments after the root."""
    relative = F.regexp_replace(path, r"^[^\\/]*[\\/]|^[^\\/]*$", "")
    return F.when(
        has_backslash(path), F.array_remove(F.split(F.regexp_replace(path, r"^[^\\]*\\", ""), r"\\"), "")
    ).otherwise(F.array_remove(F.split(relative, "/"), ""))


def join_path(root_: Column, parts: Column, sep: Column) -> Column:
    body = F.array_join(parts, "\u0001")
    body = F.replace(body, F.lit("\u0001"), sep)
    return F.when(root_ == "/", F.concat(F.lit("/"), body)).otherwise(
        F.when(body == "", root_).otherwise(F.concat(root_, sep, body))
    )


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def basename(path: Column) -> Column:
    """Last component, ignoring trailing separators."""
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"([^\\/]*)[\\/]*$", 1)


def extension(path: Column) -> Column:
    """Extension of the last segment with its dot, '' when it has none."""
    return F.regexp_extract(path, r"(?:^|[\\/])[^\\/]*?[^.\\/][^\\/]*?(\.[^.\\/]*)$", 1)


def looks_like_file(segment: Column) -> Column:
    """A segment with an extension of at most 12 characters."""
    return F.coalesce(F.trim(segment).rlike(r"[^.].*\.[^.]{0,11}$|[^.]\.[^.]{0,11}$"), F.lit(False))


def directory_of(path: Column) -> Column:
    """The path without a last segment that looks like a file name."""
    parts = segments(path)
    last = F.try_element_at(parts, F.lit(-1))
    kept = F.when(looks_like_file(last), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return join_path(root(path), kept, separator(path))


def shorten_leaf(path: Column) -> Column:
    """Replace the last segment by ``*``, keeping an installer extension.

    Paths that already hold a wildcard, or have fewer than three parts, stay.
    """
    kept = rf"((?:\.(?:{'|'.join(V.INSTALLER_EXTENSIONS)}))?)$"
    path = F.regexp_replace(path, r"^((?:[^\\*]*\\){2,})[^\\*]*?" + kept, "$1*$2")
    return F.regexp_replace(path, r"^((?:[^/\\*]*/){2,})[^/\\*]*?" + kept, "$1*$2")


def head_depth(directory: Column, requested: int, settings: RuleSettings) -> Column:
    """Grouping depth of a path from its directory segments.

    Program Files trees use their real depth up to three levels, so that a file
    name never becomes part of the key of a shallow tree.
    """
    requested = max(1, requested)
    if not settings.paths.fit_program_files:
        return F.lit(requested)
    depth = F.size(directory)
    deep = F.least(F.lit(max(requested, 3)), depth)
    in_program_files = F.coalesce(F.try_element_at(directory, F.lit(1)), F.lit("")).isin(V.PROGRAM_FILES)
    return F.when(
        in_program_files & (depth > 0), F.when(depth <= 3, depth).otherwise(deep)
    ).otherwise(F.lit(requested))


def directory_segments(parts: Column) -> Column:
    """Segments without a trailing file name."""
    has_file = looks_like_file(F.try_element_at(parts, F.lit(-1)))
    return F.when(has_file, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def group_head(
    root_: Column, parts: Column, directory: Column, sep: Column, settings: RuleSettings
) -> Column:
    """Leading folders that identify where a path belongs."""
    levels = head_depth(directory, settings.paths.levels, settings)
    source = directory if settings.paths.folders_only else parts
    return join_path(root_, F.slice(source, F.lit(1), F.greatest(F.lit(1), levels)), sep)


def wildcard_head(head: Column, sep: Column) -> Column:
    return F.concat(F.rtrim(head, sep), sep, F.lit("*"))


def wildcard_at_depth(
    path: Column, root_: Column, directory: Column, sep: Column, depth: Column, settings: RuleSettings
) -> Column:
    """Keep ``depth`` folders and wildcard the rest; null above the wildcard budget."""
    kept = F.regexp_extract(path, rf"[^.\\/](\.(?:{'|'.join(V.INSTALLER_EXTENSIONS)}))$", 1)
    wanted = F.greatest(F.lit(1), F.least(depth, F.size(directory)))
    folders = join_path(root_, F.slice(directory, F.lit(1), wanted), sep)
    # One wildcard is the leaf itself.
    return F.when(F.size(directory) == 0, path).when(
        stars(folders) < settings.paths.wildcards, F.concat(folders, sep, F.lit("*"), kept)
    )


def embedded_parts(value: Column) -> Column:
    """Pieces of a cell that are paths: split at drive letters, else POSIX paths, else the cell.

    Explode the pieces, then ``embedded_path`` turns each into a normalised path.
    """
    raw = F.btrim(F.trim(F.translate(F.coalesce(value, F.lit("")), "\r", "\n")), F.lit('"'))

    def pieces(raw: Column) -> Column:
        drives = F.split(F.regexp_replace(raw, r"(?is)^.*?(?=[a-z]:\\)", ""), r'(?i)["\s;,|]*(?=[a-z]:\\)')
        posix = F.array_distinct(F.regexp_extract_all(raw, F.lit(V.POSIX_PATH), F.lit(1)))
        return (
            F.when(raw.rlike(r"(?i)[a-z]:\\"), F.array_distinct(F.array_remove(drives, "")))
            .when(F.contains(raw, F.lit("/")), once(posix, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(value))))
            .otherwise(F.array(value))
        )

    return once(raw, pieces)


def embedded_path(part: Column) -> Column:
    """One piece without the labels and delimiters after it, normalised."""
    part = F.btrim(F.trim(F.regexp_replace(part, V.EMBEDDED_LABEL_TAIL, "")), F.lit('"'))
    return normalize_path(F.btrim(part, F.lit(";,|\t\n ")))


# --- common prefix of a group, from its smallest and largest segment arrays --


def common_prefix(low: Column, high: Column) -> Column:
    """Shared leading segments of a group.

    Arrays order element by element, so whatever the smallest and the largest
    member share, every member between them shares too.
    """
    same = F.zip_with(low, high, lambda a, b: a.eqNullSafe(b) & a.isNotNull())
    first_difference = F.array_position(same, F.lit(False))
    return F.when(first_difference > 0, F.slice(low, F.lit(1), first_difference.cast("int") - 1)).otherwise(low)


def before_volatile(parts: Column) -> Column:
    """Leading segments up to the first volatile one."""
    first = F.array_position(F.transform(parts, is_volatile), F.lit(True))
    return F.when(first > 0, F.slice(parts, F.lit(1), first.cast("int") - 1)).otherwise(parts)


# --- macOS -------------------------------------------------------------------


def macos_process_path(path: Column) -> Column:
    """Undo app translocation and wildcard version folders of a process path."""
    path = F.regexp_replace(path, V.MAC_TRANSLOCATION, "/applications/$1")
    path = F.regexp_replace(path, V.MAC_VSCODE_VERSION, "$1-*/")
    for pattern in (V.MAC_HOMEBREW_CELLAR, V.MAC_HOMEBREW_RUBY, V.MAC_PYTHON_FRAMEWORK):
        path = F.regexp_replace(path, pattern, "$1/*/")
    return path


def macos_target_path(path: Column) -> Column:
    """Reduce app bundles to ``<bundle>.app/*`` and wildcard framework versions."""
    # Inline metadata is gone already: normalising a path cuts it off.
    path = F.regexp_replace(path, "(?i)^" + V.MAC_PYTHON_FRAMEWORK[4:], "$1/*/")
    return F.regexp_replace(path, V.MAC_APP_BUNDLE, "$1/*")


def site_packages_path(path: Column) -> Column:
    """Collapse user and Python version of a user site-packages path."""
    return F.regexp_replace(
        path, V.MAC_SITE_PACKAGES, "/users/*/library/python/*/lib/python/site-packages/$3/*"
    )


def posix_depth(path: Column) -> Column:
    """Number of components of a POSIX path, 0 for other paths."""
    return F.when(
        is_posix(path), F.size(F.array_remove(F.split(path, "/"), ""))
    ).otherwise(F.lit(0))
