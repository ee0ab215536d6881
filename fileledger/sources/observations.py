"""Observation frames: column aliases and the last of duplicate names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fileledger import fixed_values as V


def with_canonical_columns(df: DataFrame) -> DataFrame:
    """Rename known column spellings; of columns that end up equal the last is kept."""
    stripped = [str(c).strip() for c in df.columns]
    names = [V.COLUMN_ALIASES.get(c.lower(), c) for c in stripped]
    last = {name: position for position, name in enumerate(names)}
    unique = df.toDF(*[f"_{i}" for i in range(len(names))])
    return unique.select(
        *[unique[f"_{i}"].alias(name) for i, name in enumerate(names) if last[name] == i]
    )
