"""Path families: what a group of similar rule paths has in common.

Everything is an algebraic aggregate (counts, minima, maxima), so groups of any
size combine before they are exchanged. Only one value per path position is ever
collected, and a path has few positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger import fixed_values as V
from fileledger.functions.paths import (
    before_volatile, common_prefix, extension, is_volatile, join_path, root, segments, separator,
    stars, volatile_shape, volatile_wildcard,
)
from fileledger.functions.risk import is_dangerous_user_wildcard, is_user_writable
from fileledger.session import cut_lineage
from fileledger.settings import RuleSettings


def with_parts(paths: DataFrame) -> DataFrame:
    """Add root, segments and separator of ``path``."""
    path = F.col("path")
    return paths.withColumns({"root": root(path), "parts": segments(path), "sep": separator(path)})


def prefix_stats(paths: DataFrame, keys: Sequence[str], *extra: Column) -> DataFrame:
    """Per group: size and the aggregates its common prefix follows from."""
    return with_parts(paths).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("members"),
        F.min("parts").alias("low"), F.max("parts").alias("high"),
        F.min("root").alias("low_root"), F.max("root").alias("high_root"),
        F.min("sep").alias("low_sep"), F.max("sep").alias("high_sep"),
        *extra,
    )


def with_prefix(stats: DataFrame) -> DataFrame:
    """Add the stable common prefix of each group; null when there is none."""
    shared = stats.withColumn("prefix_parts", before_volatile(common_prefix(F.col("low"), F.col("high"))))
    usable = (
        (F.col("low_root") == F.col("high_root"))
        & (F.col("low_sep") == F.col("high_sep"))
        & (F.size("prefix_parts") > 0)
    )
    prefix = F.when(usable, join_path(F.col("low_root"), F.col("prefix_parts"), F.col("low_sep")))
    # One row per group is left; keeping it stops filters from copying the prefix logic.
    return cut_lineage(shared.withColumn("prefix", prefix))


def _below(prefix: Column, sep: Column, leaf: Column) -> Column:
    return F.concat(F.rtrim(prefix, F.lit("\\/")), sep, leaf)


def language_families(paths: DataFrame, keys: Sequence[str], settings: RuleSettings) -> DataFrame:
    """Groups with at least three locale-folder paths: their common parent, wildcarded."""
    in_locale = F.arrays_overlap(F.col("parts"), F.array(*[F.lit(x) for x in V.LANGUAGE_FOLDERS]))
    locale = with_parts(paths).filter(F.coalesce(in_locale, F.lit(False)))
    stats = with_prefix(prefix_stats(locale.select(*keys, "path"), keys).filter("members >= 3"))
    sep = F.when(F.contains("prefix", F.lit("\\")), F.lit("\\")).otherwise(F.lit("/"))
    family = _below(F.col("prefix"), sep, F.lit("*"))
    return stats.select(*keys, family.alias("family")).filter(
        F.col("family").isNotNull() & (stars(F.col("family")) <= settings.families.wildcards)
    )


def extension_families(
    paths: DataFrame, keys: Sequence[str], settings: RuleSettings, least: int | None = None
) -> DataFrame:
    """Groups of distinct paths with one program extension: ``<prefix>\\*.ext``."""
    ext = F.nullif(extension(F.col("path")), F.lit(""))
    stats = with_prefix(
        prefix_stats(
            paths.select(*keys, "path").distinct(), keys,
            F.bool_or(is_user_writable(F.col("path"))).alias("writable"),
            F.min(ext).alias("low_ext"), F.max(ext).alias("high_ext"),
        ).filter(
            (F.col("members") >= (least or settings.families.least_family))
            & ~F.col("writable")
            & (F.col("low_ext") == F.col("high_ext"))
            & F.col("low_ext").isin(V.FAMILY_EXTENSIONS)
        )
    )
    family = _below(F.col("prefix"), F.col("low_sep"), F.concat(F.lit("*"), F.col("low_ext")))
    return stats.select(*keys, family.alias("family")).filter(
        F.col("family").isNotNull()
        & ~is_dangerous_user_wildcard(F.col("family"))
        & (stars(F.col("family")) <= settings.families.wildcards)
    )


def certificate_anchors(paths: DataFrame, keys: Sequence[str], settings: RuleSettings) -> DataFrame:
    """Groups of at least three paths outside writable folders: ``<vendor folder>\\*``."""
    safe = paths.filter(~is_user_writable(F.col("path"))).select(*keys, "path")
    stats = with_prefix(prefix_stats(safe, keys).filter(F.col("members") >= settings.families.least_family))
    first = F.try_element_at("prefix_parts", F.lit(1))
    needed = F.when(first.isin([*V.PROGRAM_FILES, "programdata"]), 2).otherwise(3)
    family = _below(F.col("prefix"), F.col("low_sep"), F.lit("*"))
    return stats.filter(F.size("prefix_parts") >= needed).select(*keys, family.alias("family")).filter(
        F.col("family").isNotNull()
        & ~is_dangerous_user_wildcard(F.col("family"))
        & (stars(F.col("family")) <= settings.families.wildcards)
    )


_SET = ["kind", "set_root", "set_depth", "set_shape"]


def shape_sets(paths: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Assign each distinct path to the sets it may be compressed in.

    ``whole`` is the group itself, ``family`` the paths equal up to volatile
    segments, ``depth`` the paths of one depth.
    """
    distinct = with_parts(paths.select(*keys, "path").distinct()).withColumn("depth", F.size("parts"))
    distinct = distinct.filter((F.col("root") != "") & (F.col("depth") > 0))
    none = F.lit(None).cast("string")
    options = {
        "whole": (none, F.lit(-1), none),
        "family": (F.col("root"), F.col("depth"), F.col("shape")),
        "depth": (none, F.col("depth"), none),
    }
    members = [
        F.struct(
            F.lit(kind).alias("kind"), options[kind][0].alias("set_root"),
            options[kind][1].alias("set_depth"), options[kind][2].alias("set_shape"),
        )
        for kind in kinds
    ]
    shaped = distinct.withColumn("shape", volatile_shape(F.col("path")))
    return shaped.select(
        *keys, "path", "root", "sep", "depth", "parts", F.explode(F.array(*members)).alias("_set")
    ).select(*keys, "path", "root", "sep", "depth", "parts", "_set.*")


def compress_sets(sets: DataFrame, keys: Sequence[str], settings: RuleSettings) -> DataFrame:
    """One pattern per set whose positions can all be kept or wildcarded.

    A position is kept when all members agree; it becomes a wildcard when all its
    values are volatile, or when nearly every member has its own value.
    """
    group = [*keys, *_SET]
    values = (
        sets.select(*group, "path", "root", "sep", "depth", F.posexplode("parts").alias("pos", "value"))
        .groupBy(*group, "pos", "value")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"), F.min("sep").alias("sep"),
            F.min("root").alias("low_root"), F.max("root").alias("high_root"),
            F.min("depth").alias("low_depth"), F.max("depth").alias("high_depth"),
        )
    )
    positions = values.groupBy(*group, "pos").agg(
        F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("n"),
        F.bool_and(is_volatile(F.col("value"))).alias("volatile"), F.min("value").alias("value"),
        F.min("first_path").alias("first_path"), F.min("sep").alias("sep"),
        F.min("low_root").alias("low_root"), F.max("high_root").alias("high_root"),
        F.min("low_depth").alias("low_depth"), F.max("high_depth").alias("high_depth"),
    )
    share = V.DISTINCT_SHARE.get(settings.families.mode)
    varied = F.lit(False) if share is None else F.col("distinct_values") / F.col("n") >= share
    token = F.when(F.col("distinct_values") == 1, F.col("value")).when(
        F.col("volatile") | varied, volatile_wildcard(F.col("value"))
    )
    tokens = positions.withColumns(
        {"token": token, "added": F.when(F.col("distinct_values") > 1, stars(token)).otherwise(0)}
    )
    # One token per position of a path.
    compressed = tokens.groupBy(*group).agg(
        F.max("n").alias("n"), F.bool_and(F.col("token").isNotNull()).alias("decided"),
        F.sum("added").alias("added"), F.min("first_path").alias("first_path"),
        F.min("sep").alias("sep"),
        F.min("low_root").alias("low_root"), F.max("high_root").alias("high_root"),
        F.min("low_depth").alias("low_depth"), F.max("high_depth").alias("high_depth"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda t: t["token"]
        ).alias("tokens"),
    )
    compressed = cut_lineage(compressed)
    budget = settings.families.wildcards
    return (
        compressed.filter(
            F.col("decided")
            & (F.col("n") >= settings.families.least_members)
            & (F.col("low_root") == F.col("high_root"))
            & (F.col("low_depth") == F.col("high_depth"))
            & F.col("added").between(1, budget)
        )
        .withColumn("family", join_path(F.col("low_root"), F.col("tokens"), F.col("sep")))
        .filter(stars(F.col("family")) <= budget)
        .select(*keys, "kind", "n", "first_path", "family")
    )


def similar_path_families(paths: DataFrame, keys: Sequence[str], settings: RuleSettings) -> DataFrame:
    """Best compression of each group: as a whole, else its best set, else an extension family."""
    ranked = compress_sets(shape_sets(paths, keys, ["whole", "family", "depth"]), keys, settings)
    best = ranked.groupBy(*keys).agg(
        F.max(
            F.struct(
                (F.col("kind") == "whole").cast("int").alias("direct"), "n",
                (-F.length("family")).alias("shortness"), "family",
            )
        )["family"].alias("family")
    )
    least = max(settings.families.least_family, settings.families.least_members)
    by_extension = extension_families(paths, keys, settings, least)
    either = best.withColumn("rank", F.lit(0)).unionByName(by_extension.withColumn("rank", F.lit(1)))
    return either.groupBy(*keys).agg(F.min_by("family", "rank").alias("family"))
