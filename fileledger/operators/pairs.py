"""Candidate condition pairs from parsed observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger import fixed_values as V
from fileledger.functions.paths import (
    extension, generalized_path, group_head, normalize_path, root, segments, separator, shorten_leaf, stars,
    wildcard_at_depth, head_depth, directory_segments, wildcard_head,
)
from fileledger.functions.risk import looks_like_path
from fileledger.functions.text import certificate_condition
from fileledger.operators.skew import null_safe_join, top_per_group, with_position
from fileledger.session import cut_lineage
from fileledger.settings import RuleSettings

PAIR_KEYS = [
    "pair_type", "condition1_kind", "condition1_key", "condition1_wc",
    "condition2_kind", "condition2_key", "condition2_wc",
]


def with_path_condition(
    df: DataFrame, source: str, prefix: str, settings: RuleSettings, wildcard: bool
) -> DataFrame:
    """Add ``<prefix>_key`` and ``<prefix>_wc`` of a path column, in evaluation stages."""
    c = {n: f"_{prefix}_{n}" for n in ("norm", "root", "parts", "dir", "sep", "head", "leaf")}
    df = df.withColumn(c["norm"], generalized_path(F.col(source), settings))
    norm = F.col(c["norm"])
    df = df.withColumns({c["root"]: root(norm), c["parts"]: segments(norm), c["sep"]: separator(norm)})
    root_, parts, sep = F.col(c["root"]), F.col(c["parts"]), F.col(c["sep"])
    df = df.withColumns({c["dir"]: directory_segments(parts), c["leaf"]: shorten_leaf(norm)})
    folders = F.col(c["dir"])
    df = df.withColumn(c["head"], group_head(root_, parts, folders, sep, settings))
    head, leaf = F.col(c["head"]), F.col(c["leaf"])
    fallback = wildcard_head(head, sep)
    if not wildcard:
        wc = norm
    elif prefix == "process" and not settings.paths.fit_depth:
        wc = fallback
    elif settings.paths.fit_depth:
        depth = head_depth(folders, settings.paths.levels, settings)
        deeper = F.coalesce(wildcard_at_depth(norm, root_, folders, sep, depth, settings), norm)
        best = F.when(stars(leaf) <= settings.paths.wildcards, leaf).otherwise(deeper)
        wc = F.when(stars(best) > settings.paths.wildcards, fallback).otherwise(best)
    else:
        wc = F.when(stars(leaf) > settings.paths.wildcards, fallback).otherwise(leaf)
    df = df.withColumn(f"{prefix}_wc", wc)
    df = df.withColumn(f"{prefix}_key", head if settings.pairs.by_head else norm)
    return df.drop(*c.values())


def distinct_observations(parsed: DataFrame, order: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per fingerprint, with its first position, first note and copies.

    Copies collapse before the exchange, so a much repeated observation costs
    one row per task.
    """
    hash_ = F.coalesce("sha256_hash", "md5_hash")
    note = F.col("notes") if "notes" in parsed.columns else F.lit(None).cast("string")
    keys = [*by, "path", "process_path", "certificate_primary", "created_by"]
    return (
        parsed.withColumn("hash", hash_)
        .groupBy(*keys, "hash")
        .agg(
            F.min(order).alias("origin"),
            F.min_by(note, order).alias("notes"),
            F.min_by("count", order).alias("row_count"),
            F.count(F.lit(1)).alias("copies"),
        )
    )


def condition_pairs(
    observations: DataFrame, settings: RuleSettings, by: Sequence[str] = ()
) -> DataFrame:
    """Two-condition combinations of each observation, keyed and wildcarded."""
    staged = with_path_condition(observations, "path", "path", settings, wildcard=True)
    staged = with_path_condition(
        staged, "process_path", "process", settings, wildcard=settings.pairs.any_process
    )
    certificate = F.when(
        ~looks_like_path(F.col("certificate_primary")), certificate_condition(F.col("certificate_primary"))
    )
    staged = staged.withColumn("certificate_key", certificate)
    columns = {
        "Path": ("path", "path_key", "path_wc"),
        "Process Path": ("process_path", "process_key", "process_wc"),
        "Certificate": ("certificate_primary", "certificate_key", "certificate_key"),
        "Created By": ("created_by", "created_by", "created_by"),
    }

    def pair(pair_type: str) -> Column:
        fields = [F.lit(pair_type).alias("pair_type")]
        for number, kind in enumerate(V.PAIR_TYPES[pair_type], 1):
            value, key, wc = columns[kind]
            fields += [
                F.lit(kind).alias(f"condition{number}_kind"),
                F.col(value).alias(f"condition{number}"),
                F.col(key).alias(f"condition{number}_key"),
                F.col(wc).alias(f"condition{number}_wc"),
            ]
        return F.struct(*fields)

    types = list(V.PAIR_TYPES) if settings.pairs.creators else list(V.PAIR_TYPES)[:3]
    exploded = staged.select(
        *by, F.col("path").alias("_path"), "origin", "notes", "row_count",
        F.explode(F.array(*[pair(t) for t in types])).alias("_pair"),
    )
    return exploded.select(*by, "_path", "origin", "notes", "row_count", "_pair.*").filter(
        "condition1_key is not null and condition2_key is not null"
    )


def with_path_shape(paths: DataFrame, source: str, settings: RuleSettings) -> DataFrame:
    """Add ``_line``: the generalised path with all that a common pattern depends on; null without one."""
    staged = paths.withColumn("_path_of", generalized_path(normalize_path(F.col(source)), settings))
    path = F.col("_path_of")
    staged = staged.withColumns({"_root": root(path), "_parts": segments(path), "_sep": separator(path)})
    shape = F.struct(
        path.alias("path"), F.col("_root").alias("root"), F.col("_sep").alias("sep"), F.col("_parts").alias("parts"),
        directory_segments(F.col("_parts")).alias("folders"), F.size("_parts").alias("depth"), extension(path).alias("ext"),
    )
    blank = F.coalesce(F.trim(F.col(source)), F.lit("")) == ""
    return staged.withColumn("_line", F.when(~blank & path.isNotNull(), shape)).drop("_path_of", "_root", "_parts", "_sep")


#: What paths of a group may differ in. A minimum and a maximum of each say whether one value
#: holds for all, and of segment arrays, which prefix all share.
SHAPE = ["root", "sep", "folders", "parts", "depth", "ext"]


def path_span(first: Column) -> list[Column]:
    """Aggregates over ``_line`` that spans of parts of a group can be merged from; ``first`` ranks the lines."""
    line = F.col("_line")
    ends = [f(line[c]).alias(f"{end}_{c}") for c in SHAPE for end, f in (("low", F.min), ("high", F.max))]
    given = F.when(line.isNotNull(), first)
    return [F.count(line["path"]).alias("lines"), F.min_by(line["path"], given).alias("first_path"), *ends]


def merged_span(span: Column, first: Column) -> list[Column]:
    """One span from those of the parts; ``first`` ranks the parts."""
    ends = [f(span[f"{end}_{c}"]).alias(f"{end}_{c}") for c in SHAPE for end, f in (("low", F.min), ("high", F.max))]
    given = F.when(span["lines"] > 0, first)
    return [F.sum(span["lines"]).alias("lines"), F.min_by(span["first_path"], given).alias("first_path"), *ends]


def candidate_pairs(
    parsed: DataFrame, settings: RuleSettings, order: str, by: Sequence[str] = ()
) -> DataFrame:
    """Pairs with their occurrences, samples, example paths and the span of all their paths.

    ``order`` numbers the observations; ``by`` separates independent scopes such
    as applications. Observations shrink to one row for each pair and path, which
    is written once and serves the totals as well as the examples.
    """
    pairs = condition_pairs(distinct_observations(parsed, order, by), settings, by)
    keys = [*by, *PAIR_KEYS]
    note = F.when(F.col("notes").isNotNull(), F.struct("origin", "notes"))
    by_path = pairs.groupBy(*keys, "_path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("row_count").alias("rows"),
        F.min(F.struct("origin", "condition1", "condition2")).alias("sample"), F.min(note).alias("note"),
    )
    by_path = cut_lineage(with_path_shape(by_path, "_path", settings))
    totals = by_path.groupBy(*keys).agg(
        F.sum("n").alias("occurrences"),
        F.sum("rows" if settings.weighted else "n").alias("weighted_count"),
        F.min("sample").alias("sample"), F.min("note").alias("note"),
        *path_span(F.col("_path")),
    )
    span = F.struct("lines", "first_path", *[f"{end}_{c}" for c in SHAPE for end in ("low", "high")])
    totals = totals.select(
        *keys, "occurrences", "weighted_count", F.col("sample.condition1").alias("sample_condition1"),
        F.col("sample.condition2").alias("sample_condition2"), F.col("note.notes").alias("example_notes"),
        span.alias("span"),
    )
    examples = (
        top_per_group(
            by_path.filter("_path is not null").select(*keys, "_path"),
            keys, [F.col("_path")], settings.pairs.examples,
        )
        .groupBy(*keys)
        # At most max_example_paths values per pair, for display.
        .agg(F.array_join(F.sort_array(F.collect_list("_path")), "\n").alias("example_paths"))
    )
    result = null_safe_join(totals, examples, keys, "left").withColumn(
        "example_paths", F.coalesce("example_paths", F.lit(""))
    )
    if settings.pairs.notes > 1:
        notes = (
            top_per_group(
                pairs.filter("notes is not null").select(*keys, "origin", "notes"),
                keys, [F.col("origin")], settings.pairs.notes,
            )
            .groupBy(*keys)
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("origin", "notes"))), lambda n: n["notes"]).alias("_notes"))
        )
        result = null_safe_join(result, notes, keys, "left").withColumn(
            "example_notes", F.array_join("_notes", "\n---\n")
        ).drop("_notes")
    return result


def pair_order() -> list[Column]:
    """Total order of candidate pairs: heaviest first, then by key."""
    return [
        F.desc("weighted_count"), F.desc("occurrences"), F.asc("pair_type"),
        F.asc("condition1_key"), F.asc("condition2_key"), F.asc("condition1_wc"), F.asc("condition2_wc"),
    ]


def condition_value(kind: str) -> Column:
    """Value a pair contributes for a condition: paths as wildcards, identities as keys."""
    suffix = "wc" if kind in ("Path", "Process Path") else "key"
    return F.when(F.col("condition1_kind") == kind, F.col(f"condition1_{suffix}")).when(
        F.col("condition2_kind") == kind, F.col(f"condition2_{suffix}")
    )


def pair_export(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pairs under sequential names, as rule conditions."""
    named = with_position(pairs, pair_order(), "_n", keys=list(by))
    # A pair is worth its occurrences here, whatever weight ordered it.
    return named.select(
        *by,
        F.format_string("Pair %04d", F.col("_n")).alias("pair_name"),
        "pair_type",
        condition_value("Path").alias("path"),
        condition_value("Process Path").alias("process_path"),
        condition_value("Certificate").alias("certificate"),
        condition_value("Created By").alias("created_by"),
        F.col("occurrences").alias("weighted_count"),
        "occurrences",
        "example_paths",
    )
