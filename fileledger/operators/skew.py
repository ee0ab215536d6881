"""Group work that stays balanced when one key holds a large share of the rows.

The idea is the same everywhere: a row's *salt* is a hash of its identity, so a
hot key is spread over as many tasks as there are salts. Work that needs the
whole key runs over one small row per (key, salt), never over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fileledger.session import cut_lineage

SALT = "_salt"


def salt_count(df: DataFrame) -> int:
    """One salt per shuffle partition: a single hot key can use every reducer."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_salt(df: DataFrame, salt_on: Sequence[str], salts: int | None = None) -> DataFrame:
    count = salts or salt_count(df)
    return df.withColumn(SALT, F.pmod(F.xxhash64(*[F.col(c) for c in salt_on]), F.lit(count)).cast("int"))


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which null keys meet null keys; the right key columns are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def unestimated(df: DataFrame) -> DataFrame:
    """A side of a join whose size Spark cannot estimate, so that neither side is broadcast.

    Estimates start from compressed files, count no row an ``explode`` adds and go with a
    checkpoint. By them a table of any size may be collected on the driver to be broadcast.
    """
    return df.hint("merge")


def group_totals(
    df: DataFrame,
    keys: Sequence[str],
    salt_on: Sequence[str],
    partial: dict[str, Column],
    merge: dict[str, Column],
) -> DataFrame:
    """Attach per-group totals to every row without gathering a group in one task.

    ``partial`` aggregates each (key, salt); ``merge`` combines those partial
    results over a window that sees at most one row per salt.
    """
    salted = with_salt(df, salt_on)
    parts = salted.groupBy(*keys, SALT).agg(*[c.alias(n) for n, c in partial.items()])
    window = Window.partitionBy(*keys)
    totals = parts.select(*keys, SALT, *[c.over(window).alias(n) for n, c in merge.items()])
    return null_safe_join(salted, totals, [*keys, SALT]).drop(SALT)


def attach(
    df: DataFrame,
    payload: DataFrame,
    keys: Sequence[str],
    salt_on: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Join a payload by key when ``df`` may be hot on that key and is grouped by it next.

    A join alone needs no salts: Spark splits its hot partitions while it runs. It cannot where
    an aggregation by the same key relies on the partitions of the join. The payload meets only the distinct (key, salt) pairs, then the rows meet it
    on key and salt; no task holds more than one salt of a key. The payload is
    neither replicated up front nor broadcast by hand.
    """
    salted = with_salt(df, salt_on)
    spread = salted.select(*keys, SALT).distinct()
    matched = null_safe_join(spread, payload, keys)
    return null_safe_join(salted, matched, [*keys, SALT], how).drop(SALT)


# Rows of a dimension that may be broadcast: identifiers and names, so a few megabytes.
BROADCAST_ROWS = 50_000


def lookup(
    df: DataFrame, dimension: DataFrame, keys: Sequence[str], salt_on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join a dimension with few key values, such as applications.

    A plain shuffle on such a key would put an application's records into one
    task. A dimension counted to be small is broadcast; a larger one is joined
    by key and salt. Both give the same: null keys match nothing, and the columns
    are those of ``df``, then the dimension's others. The dimension should be cheap
    to read: it is counted first.
    """
    dimension = dimension.dropna(subset=list(keys))
    if dimension.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return null_safe_join(df, F.broadcast(dimension), keys, how)
    if how == "left_semi":
        return attach(df, dimension.select(*keys).distinct(), keys, salt_on)
    return attach(df, dimension, keys, salt_on, how)


def with_position(
    df: DataFrame, order: Sequence[Column], name: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Exact 1-based row number in a total order, globally or within ``keys``.

    A window without a partition would pull everything into one task. Here the
    rows are range-sorted, kept, numbered inside their partition, and shifted by
    the sizes of the partitions before them; only one row per partition and key
    is gathered for that.
    """
    sort = [F.col(k) for k in keys] + list(order)
    ordered = cut_lineage(
        df.orderBy(*sort).withColumn("_line", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_line", 33))
    sizes = ordered.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_size"), F.min("_line").alias("_first")
    )
    # At most one row per sort partition for each key.
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_part", "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
    )
    return (
        null_safe_join(ordered, offsets, [*keys, "_part"])
        .withColumn(name, F.col("_line") - F.col("_first") + F.col("_before") + 1)
        .drop("_line", "_part", "_first", "_before")
    )


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, name: str = "_position"
) -> DataFrame:
    """First ``limit`` rows of each group.

    Spark keeps at most ``limit`` rows of a group per task before the exchange,
    so a hot group shrinks to a few rows first.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= limit)
