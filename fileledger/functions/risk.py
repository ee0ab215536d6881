"""Risk predicates and scores over rule conditions.

Paths are expected in normalised form; null means the condition is absent.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from fileledger import fixed_values as V
from fileledger.functions.paths import is_posix, stars


def _hits(value: Column, *patterns: str) -> Column:
    """One regular expression per predicate; an absent value never hits."""
    return F.coalesce(value.rlike("|".join(patterns)), F.lit(False))


def _any_of(texts: list[str]) -> str:
    return "(?:" + "|".join(re.escape(t) for t in texts) + ")"


def _under(prefixes: list[str]) -> str:
    return "^" + _any_of(prefixes)


_END = r"[\\/]*$"
_NAME = r"(?:^|[\\/])"


def is_high_risk_process(path: Column) -> Column:
    """Interpreters, installers and executables in writable or system folders."""
    posix = _hits(path, _NAME + _any_of(V.MAC_HIGH_RISK_BASENAMES) + _END, _under(V.MAC_HIGH_RISK_DIRECTORIES))
    windows = _hits(path, _NAME + _any_of(V.HIGH_RISK_BASENAMES) + _END) | (
        _hits(path, V.HIGH_RISK_DIRECTORIES) & _hits(path, V.HIGH_RISK_EXTENSIONS)
    )
    return F.when(is_posix(path), posix).otherwise(windows)


def is_user_writable(path: Column) -> Column:
    return _hits(path, _under(V.USER_WRITABLE))


def is_macos_user_writable(path: Column) -> Column:
    return _hits(path, _under(V.MAC_USER_WRITABLE))


def is_dangerous_user_wildcard(path: Column) -> Column:
    """Wildcards that open a whole user profile."""
    return _hits(path, V.DANGEROUS_USER_PATHS)


def is_invalid_process(path: Column) -> Column:
    return F.coalesce(path.isin(V.MAC_INVALID_PROCESSES), F.lit(False))


def is_overbroad_macos(path: Column) -> Column:
    return _hits(path, V.MAC_BROAD_PATHS)


def is_private_framework(path: Column) -> Column:
    return _hits(path, V.MAC_PRIVATE_FRAMEWORK)


def is_user_python_library(path: Column) -> Column:
    return _hits(path, "^/users/.*/library/python/|^/users/library/python/")


def is_site_package_rule(path: Column) -> Column:
    return _hits(path, V.MAC_SITE_PACKAGE_RULE)


def is_python_interpreter(path: Column) -> Column:
    return _hits(path, _NAME + V.PYTHON_BASENAME + _END, re.escape(V.PYTHON_APP))


def is_python_package_artifact(path: Column) -> Column:
    """Native Python dependencies anchored at a project or package."""
    return (
        _hits(path, r"^/users(?:/+[^/]+){5,}/*$")
        & _hits(path, _any_of(V.MAC_PYTHON_MARKERS))
        & _hits(path, V.MAC_NATIVE_LEAF)
        & ~is_overbroad_macos(path)
    )


def looks_like_path(value: Column) -> Column:
    return F.coalesce(value.rlike(r"(?i)^(?:[a-z]:[\\/]|/)"), F.lit(False))


def count_conditions(path: Column, process: Column, certificate: Column, creator: Column) -> Column:
    """Populated conditions; a bare wildcard process does not count."""
    valid_process = process.isNotNull() & ~is_invalid_process(process)
    return (
        path.isNotNull().cast("int")
        + valid_process.cast("int")
        + certificate.isNotNull().cast("int")
        + creator.isNotNull().cast("int")
    )


def is_safe_python_rule(path: Column, process: Column, certificate: Column, creator: Column) -> Column:
    """Two-condition macOS Python rules that stay allowed despite their location."""
    return (
        certificate.isNull()
        & creator.isNull()
        & path.isNotNull()
        & process.isNotNull()
        & ~is_invalid_process(process)
        & is_python_interpreter(process)
        & is_python_package_artifact(path)
        & (stars(path) <= 2)
    )


def risk_score(path: Column, process: Column, certificate: Column, creator: Column) -> Column:
    writable = is_user_writable(path)

    def points(condition: Column, value: int) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0))

    total = (
        points(writable, 5)
        + points(_hits(path, r"\\temp\\"), 5)
        + points(is_high_risk_process(process), 5)
        + points(stars(path) > 1, 3)
        + points(certificate.isNull(), 3)
        + points(process.isNull(), 2)
        + points(creator.isNull() & writable, 2)
        + points(is_dangerous_user_wildcard(path), 10)
        + points(is_invalid_process(process), 10)
        + points(is_overbroad_macos(path), 15)
        + points(is_private_framework(process), 5)
        + points(is_user_python_library(path) & ~is_site_package_rule(path), 6)
        + points(
            is_macos_user_writable(path)
            & (count_conditions(path, process, certificate, creator) < 3),
            10,
        )
    )
    return F.when(is_safe_python_rule(path, process, certificate, creator), F.lit(5)).otherwise(total)


def risk_label(score: Column) -> Column:
    return (
        F.when(score >= V.RISK_HIGH, F.lit("High"))
        .when(score >= V.RISK_MEDIUM, F.lit("Medium"))
        .otherwise(F.lit("Low"))
    )


def review_note(path: Column, process: Column) -> Column:
    return (
        F.when(is_invalid_process(process), F.lit(V.NOTE_INVALID_PROCESS))
        .when(is_overbroad_macos(path), F.lit(V.NOTE_BROAD_MAC))
        .when(is_private_framework(process), F.lit(V.NOTE_PRIVATE_FRAMEWORK))
        .when(is_high_risk_process(process), F.lit(V.NOTE_HIGH_RISK))
        .otherwise(F.lit(""))
    )
