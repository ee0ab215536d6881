"""Joins of wildcard patterns with values, without comparing all with all.

``*`` can cross separators, so only the literal head of a pattern is safe to
compare exactly: its leading whole segments before the first wildcard. A value
can match only if one of its own leading parts equals that head. The same holds
for a literal last segment. That turns the pattern join into an equi-join; the
wildcard test runs on what it leaves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger.functions.paths import literal_head, literal_leaf, path_prefixes
from fileledger.functions.text import matches
from fileledger.operators.skew import null_safe_join, unestimated


def with_block_keys(values: DataFrame) -> DataFrame:
    """One row per leading part of ``path``, with its last segment and without one."""
    path = F.coalesce("path", F.lit(""))
    leaf = F.regexp_extract(path, r"[\\/]([^\\/]+)$", 1)
    return values.withColumn("_head", F.explode(path_prefixes(path))).withColumn(
        "_leaf", F.explode(F.array_distinct(F.array(F.lit(""), leaf)))
    )


def pattern_pairs(
    values: DataFrame,
    patterns: DataFrame,
    keys: Sequence[str],
    residual: Column | None = None,
) -> DataFrame:
    """Matching (value, pattern) rows.

    ``values`` has ``path``; ``patterns`` has ``pattern`` and its own columns.
    ``keys`` must be equal on both sides (null equals null).
    """
    heads = patterns.withColumns(
        {"_head": literal_head(F.col("pattern")), "_leaf": literal_leaf(F.col("pattern"))}
    )
    exploded = with_block_keys(values.filter("path is not null"))
    joined = null_safe_join(unestimated(exploded), heads, [*keys, "_head", "_leaf"]).drop("_head", "_leaf")
    # Both sides are normalised, hence lower-case.
    hit = matches(F.col("pattern"), F.col("path"), ignore_case=False)
    return joined.filter(hit if residual is None else hit & residual)
