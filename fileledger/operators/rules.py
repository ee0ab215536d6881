"""From candidate pairs to final rules.

A rule table has ``path``, ``certificate``, ``process_path``, ``created_by``, the
scope columns given as ``by``, and ``ord``: a struct whose order is the rule
order. Rules are ordered data, and a struct keeps that order through joins and
aggregations without numbering rows in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger import fixed_values as V
from fileledger.functions import risk
from fileledger.functions.paths import (
    common_prefix, directory_segments, extension, group_head, join_path,
    macos_process_path, macos_target_path, normalize_path, root, segments, separator, shorten_leaf,
    site_packages_path, stars, wildcard_at_depth, wildcard_head, head_depth,
)
from fileledger.functions.text import (
    certificate_condition, certificate_vendor, creator_in, matches, normalize_spaces,
)
from fileledger.operators import families
from fileledger.operators.pairs import condition_value, merged_span
from fileledger.operators.patterns import pattern_pairs
from fileledger.operators.skew import null_safe_join, with_position
from fileledger.session import cut_lineage
from fileledger.settings import RuleSettings

CONDITIONS = ["path", "certificate", "process_path", "created_by"]
IDENTITY = ["certificate", "process_path", "created_by"]


def _condition_columns() -> tuple[Column, Column, Column, Column]:
    return F.col("path"), F.col("process_path"), F.col("certificate"), F.col("created_by")


def nulls_last(*columns: Column) -> Column:
    """Array that orders like its columns with nulls after values."""
    encoded = [F.coalesce(F.concat(F.lit("0"), c), F.lit("1")) for c in columns]
    return F.array(*encoded)


def rule_order(
    stage: int, keys: Column, weight: Column | None = None, rows: Column | None = None,
    conditions: Column | None = None, wildcards: Column | None = None, kind: Column | None = None,
) -> Column:
    """Weight, rows and conditions descending, wildcards and type ascending, then keys.

    Generated rules come after all earlier ones: their ``stage`` is higher.
    """
    zero = F.lit(0).cast("long")
    return F.struct(
        F.lit(stage).alias("stage"),
        (-(weight.cast("long")) if weight is not None else zero).alias("weight"),
        (-(rows.cast("long")) if rows is not None else zero).alias("rows"),
        (-(conditions.cast("long")) if conditions is not None else zero).alias("conditions"),
        (wildcards.cast("long") if wildcards is not None else zero).alias("wildcards"),
        (kind if kind is not None else F.lit("")).alias("kind"),
        keys.alias("keys"),
    )


def condition_count() -> Column:
    return risk.count_conditions(*_condition_columns())


# --- filters ------------------------------------------------------------------


def enforce_high_risk(rules: DataFrame, settings: RuleSettings) -> DataFrame:
    """Rules anchored at a high-risk process need three conditions."""
    if not settings.rules.risky_process_conditions:
        return rules
    weak = (
        F.col("process_path").isNotNull()
        & risk.is_high_risk_process(F.col("process_path"))
        & (condition_count() < settings.rules.risky_process_conditions)
    )
    return rules.filter(~weak | risk.is_safe_python_rule(*_condition_columns()))


def sanitize(rules: DataFrame) -> DataFrame:
    """Clean final values: inline creators, macOS anchors, wildcard processes, certificates."""
    staged = rules.withColumns(
        {
            "created_by": F.coalesce(
                normalize_spaces(F.col("created_by")), creator_in(F.col("process_path")), creator_in(F.col("path"))
            ),
            # Normalising also cuts the creator note off.
            "path": normalize_path(F.col("path")),
            "process_path": normalize_path(F.col("process_path")),
        }
    )
    staged = staged.withColumns(
        {
            "path": macos_target_path(F.col("path")),
            "process_path": macos_process_path(F.col("process_path")),
            "certificate": certificate_condition(F.col("certificate")),
        }
    )
    staged = staged.filter(~F.coalesce(F.col("path"), F.lit("")).rlike(r"(?i)\s(?:process|installedby|cert)="))
    return staged.withColumns(
        {
            "path": site_packages_path(F.col("path")),
            "process_path": F.when(
                ~risk.is_invalid_process(F.col("process_path")), F.col("process_path")
            ),
        }
    )


def filter_dangerous(rules: DataFrame) -> DataFrame:
    """Drop rules that are too weak for where they point."""
    # Kept before filtering: the optimiser would copy the clean-up into every use of
    # a column in the filter.
    clean = cut_lineage(sanitize(rules))
    path, process, certificate, creator = _condition_columns()
    few = condition_count() < 3
    user_process = F.lit(False)
    for prefix in V.MAC_USER_WRITABLE:
        user_process = user_process | F.coalesce(process.startswith(prefix), F.lit(False))
    dangerous = (
        risk.is_dangerous_user_wildcard(path)
        | risk.is_overbroad_macos(path)
        | (few & (risk.is_macos_user_writable(path) | risk.is_user_writable(path)))
        | (few & (risk.is_private_framework(process) | user_process))
    )
    safe = risk.is_safe_python_rule(path, process, certificate, creator)
    return clean.filter((condition_count() >= 2) & (safe | ~dangerous))


def distinct_rules(rules: DataFrame, by: Sequence[str]) -> DataFrame:
    """First rule of each condition combination, without empty rules."""
    populated = rules.withColumn("certificate", certificate_condition(F.col("certificate")))
    return (
        populated.filter(F.coalesce(*CONDITIONS).isNotNull())
        .groupBy(*by, *CONDITIONS)
        .agg(F.min("ord").alias("ord"))
    )


# --- pairs to rules -------------------------------------------------------------


def pair_rules(pairs: DataFrame, settings: RuleSettings, by: Sequence[str] = ()) -> DataFrame:
    """Map pairs to conditions and keep those a rule may consist of."""
    mapped = pairs.select(
        *by,
        condition_value("Path").alias("path"),
        condition_value("Process Path").alias("process_path"),
        condition_value("Certificate").alias("certificate"),
        condition_value("Created By").alias("created_by"),
        F.col("pair_type").alias("rule_type"),
        F.col("occurrences").alias("source_rows"),
        (F.col("weighted_count") if settings.weighted else F.col("occurrences")).alias("weighted_count"),
        "span", "condition1_key", "condition2_key", "condition1_wc", "condition2_wc",
    )
    counted = mapped.withColumns(
        {
            "condition_count": condition_count(),
            "wildcard_count": stars(F.col("path")) + stars(F.col("process_path")),
        }
    )
    kept = enforce_high_risk(counted, settings).filter(
        (F.col("source_rows") >= settings.rules.least_rows)
        & (F.col("condition_count") >= 2)
        & (F.col("wildcard_count") <= settings.paths.wildcards)
    )
    if settings.rules.needs_path:
        kept = kept.filter(F.coalesce("path", F.lit("")) != "")
    order = rule_order(
        0,
        nulls_last(*[F.col(c) for c in ("condition1_key", "condition2_key", "condition1_wc", "condition2_wc")]),
        F.col("weighted_count"), F.col("source_rows"), F.col("condition_count"),
        F.col("wildcard_count"), F.col("rule_type"),
    )
    return kept.withColumn("ord", order).drop(
        "condition1_key", "condition2_key", "condition1_wc", "condition2_wc"
    )


def sibling_rules(rules: DataFrame, settings: RuleSettings, by: Sequence[str] = ()) -> DataFrame:
    """One merged rule per (process, certificate, creator) over all paths of its rules.

    What the paths share follows from minima and maxima, which each pair brings along.
    """
    keys = [*by, *IDENTITY]
    stats = rules.groupBy(*keys).agg(*merged_span(F.col("span"), F.col("ord"))).filter("lines > 0")
    stats = stats.withColumnsRenamed({"first_path": "path", "low_root": "root", "low_sep": "sep"})
    stats = stats.withColumns(
        {
            "parts": segments(F.col("path")),
            "own_root": root(F.col("path")),
            "own_sep": separator(F.col("path")),
            "own_leaf": shorten_leaf(F.col("path")),
            "folders": common_prefix(F.col("low_folders"), F.col("high_folders")),
            "shared": common_prefix(F.col("low_parts"), F.col("high_parts")),
        }
    )
    stats = stats.withColumn("own_folders", directory_segments(F.col("parts")))
    merged = cut_lineage(stats.select(*keys, _merged_path(settings).alias("path")))
    totals = rules.groupBy(*keys).agg(
        F.sum("source_rows").alias("source_rows"), F.sum("weighted_count").alias("weighted_count")
    )
    result = null_safe_join(merged.filter("path is not null").select(*keys, "path"), totals, keys)
    result = result.withColumns(
        {
            "rule_type": F.lit(V.MERGED_RULE_TYPE),
            "condition_count": condition_count(),
            "wildcard_count": stars(F.col("path")) + stars(F.col("process_path")),
        }
    ).filter((F.col("condition_count") >= 2) & (F.col("wildcard_count") <= settings.paths.wildcards))
    return result.withColumn(
        "ord",
        rule_order(
            0, nulls_last(F.col("process_path"), F.col("certificate"), F.col("created_by")),
            F.col("weighted_count"), F.col("source_rows"), F.col("condition_count"),
            F.col("wildcard_count"), F.col("rule_type"),
        ),
    )


def _merged_path(settings: RuleSettings) -> Column:
    """Pattern of a sibling group from its aggregates; null when nothing safe covers it."""
    root_, parts, sep, own = F.col("own_root"), F.col("parts"), F.col("own_sep"), F.col("own_folders")
    one_root = F.col("root") == F.col("high_root")
    folders, shared = F.col("folders"), F.col("shared")

    # A single path is generalised like any single observation.
    leaf = F.col("own_leaf")
    own_depth = head_depth(own, settings.paths.levels, settings)
    single = F.when(stars(leaf) <= settings.paths.wildcards, leaf).otherwise(
        F.coalesce(wildcard_at_depth(F.col("path"), root_, own, sep, own_depth, settings), F.col("path"))
    )

    least = max(1, settings.paths.least_levels)
    common = F.size(folders)
    first, second = F.try_element_at(folders, F.lit(1)), F.try_element_at(folders, F.lit(2))
    vendor_depth = F.when(second == "common files", 4).otherwise(2)
    depth = F.when(
        first.isin(V.PROGRAM_FILES), F.greatest(F.lit(least), F.least(vendor_depth, common))
    ).otherwise(F.lit(least))
    shallow = F.when(
        one_root & (common >= least),
        wildcard_at_depth(F.col("path"), root_, own, sep, F.least(depth, common), settings),
    )

    # Siblings that differ only in their last one or two parts.
    rest_low, rest_high = F.col("low_depth") - F.size(shared), F.col("high_depth") - F.size(shared)
    installer = F.col("low_ext").isin(["." + e for e in V.INSTALLER_EXTENSIONS]) & (
        F.col("low_ext") == F.col("high_ext")
    )
    leaf_mark = F.concat(F.lit("*"), F.when(installer, F.col("low_ext")).otherwise(F.lit("")))

    def capped(pattern: Column) -> Column:
        return F.when(stars(pattern) <= settings.paths.wildcards, pattern)

    def tail(*marks: Column) -> Column:
        return capped(join_path(F.col("root"), F.concat(shared, F.array(*marks)), F.col("sep")))

    siblings = F.when((rest_low == 1) & (rest_high == 1), tail(leaf_mark))
    if settings.paths.wildcards >= 2:
        siblings = siblings.when((rest_low == 2) & (rest_high == 2), tail(F.lit("*"), leaf_mark))
    if settings.rules.siblings_to_heads:
        head = wildcard_head(group_head(root_, parts, own, sep, settings), sep)
        siblings = siblings.otherwise(capped(head))
    same_tree = one_root & (F.col("sep") == F.col("high_sep"))
    fallback = F.when((F.col("lines") >= 2) & same_tree, siblings)
    if not settings.paths.fit_depth:
        return fallback
    return F.when(F.col("lines") == 1, single).otherwise(F.coalesce(shallow, fallback))


def base_rules(pairs: DataFrame, settings: RuleSettings, by: Sequence[str] = ()) -> DataFrame:
    """Pair rules and merged siblings, one per condition combination and type, in rule order."""
    rules = pair_rules(pairs, settings, by)
    if settings.rules.siblings:
        rules = cut_lineage(rules)
        rules = rules.unionByName(sibling_rules(rules, settings, by), allowMissingColumns=True)
    rules = enforce_high_risk(rules, settings)
    return rules.groupBy(*by, *CONDITIONS, "rule_type").agg(
        F.min("ord").alias("ord"), F.min_by("source_rows", "ord").alias("source_rows")
    )


# --- family stages ----------------------------------------------------------------


def _replace_covered(
    rules: DataFrame, found: DataFrame, keys: Sequence[str], stage: int, keep_equal: bool,
    order: Column | None = None,
) -> DataFrame:
    """Drop a group's rules its family covers and append the family rule."""
    joined = null_safe_join(rules, found.select(*keys, "family"), keys, "left")
    covered = matches(F.col("family"), F.col("path")) & F.col("family").isNotNull()
    if keep_equal:
        covered = covered & (F.col("path") != F.col("family"))
    kept = joined.filter(~F.coalesce(covered, F.lit(False))).drop("family")
    keys_last = nulls_last(F.col("certificate"), F.col("process_path"), F.col("created_by"))
    new = found.select(*keys, F.col("family").alias("path")).withColumn("ord", rule_order(stage, keys_last))
    return kept.unionByName(new, allowMissingColumns=True)


def _family_stage(
    rules: DataFrame, find: Callable[[DataFrame, Sequence[str], RuleSettings], DataFrame],
    settings: RuleSettings, by: Sequence[str], stage: int, keep_equal: bool = False,
) -> DataFrame:
    """Run one family pass; ``rules`` comes in and goes out materialised."""
    keys = [*by, *IDENTITY]
    found = find(rules.filter("path is not null"), keys, settings)
    if found.isEmpty():
        return rules
    return cut_lineage(_replace_covered(rules, found, keys, stage, keep_equal))


def compress_similar(rules: DataFrame, settings: RuleSettings, by: Sequence[str], stage: int) -> DataFrame:
    """Best path compression per group of equal identity conditions."""
    if settings.families.mode == "off":
        return rules
    return _family_stage(rules, families.similar_path_families, settings, by, stage, keep_equal=True)


def compress_languages(rules: DataFrame, settings: RuleSettings, by: Sequence[str], stage: int) -> DataFrame:
    return _family_stage(rules, families.language_families, settings, by, stage)


def compress_extensions(rules: DataFrame, settings: RuleSettings, by: Sequence[str], stage: int) -> DataFrame:
    if not settings.families.by_extension:
        return rules
    return _family_stage(rules, families.extension_families, settings, by, stage)


def global_families(rules: DataFrame, settings: RuleSettings, by: Sequence[str] = ()) -> DataFrame | None:
    """Path-only families over all rules of a scope: ``family`` and where it goes in order; None without any."""
    if (
        not settings.global_families
        or settings.families.mode in ("off", "conservative")
    ):
        return None
    keys = list(by)
    paths = rules.filter("path is not null").select(*keys, "path")
    shaped = families.compress_sets(families.shape_sets(paths, keys, ["family"]), keys, settings)
    found = shaped.select(*keys, "family", F.concat(F.lit("1"), "first_path").alias("at"))
    whole = families.extension_families(paths, keys, settings)
    found = found.unionByName(whole.select(*keys, "family", F.lit("0").alias("at")))
    return None if found.isEmpty() else found


def covered_paths(rules: DataFrame, found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Paths of rules that a family covers without being it, with the first such family."""
    keys = list(by)
    paths = rules.filter("path is not null").select(*keys, "path").distinct()
    return pattern_pairs(
        paths, found.select(*keys, F.col("family").alias("pattern")), keys,
        residual=F.col("path") != F.col("pattern"),
    ).groupBy(*keys, "path").agg(F.min("pattern").alias("family"))


def compress_globally(rules: DataFrame, settings: RuleSettings, by: Sequence[str], stage: int) -> DataFrame:
    """Path-only families over all rules of a scope; the specific rules they cover go.

    The later condition filter removes path-only rules, so a family costs its
    members, which ``dropped_family_rules`` lists; ``global_families=False`` keeps them.
    """
    found = global_families(rules, settings, by)
    if found is None:
        return rules
    kept = null_safe_join(rules, covered_paths(rules, found, by), [*by, "path"], "left_anti")
    new = found.select(
        *by, F.col("family").alias("path"),
        *[F.lit(None).cast("string").alias(c) for c in IDENTITY],
        rule_order(stage, F.array("at")).alias("ord"),
    )
    return cut_lineage(kept.unionByName(new, allowMissingColumns=True))


def dropped_family_rules(rules: DataFrame, settings: RuleSettings, by: Sequence[str] = ()) -> DataFrame:
    """Rules that go with a global family, which is itself too weak to stay: for review.

    ``rules`` are those the global pass gets; ``family`` is the first that covers the path.
    """
    found = global_families(rules, settings, by)
    none = F.lit(None).cast("string")
    if found is None:
        return rules.limit(0).select(*by, *CONDITIONS, none.alias("family"))
    gone = null_safe_join(rules, covered_paths(rules, found, by), [*by, "path"])
    return distinct_rules(gone.withColumn("ord", F.struct("ord", "family")), by).select(
        *by, *CONDITIONS, F.col("ord.family").alias("family")
    )


def add_certificate_anchors(rules: DataFrame, settings: RuleSettings, by: Sequence[str], stage: int) -> DataFrame:
    """Add vendor-folder rules scoped to a certificate."""
    keys = [*by, "certificate"]
    signed = rules.filter("path is not null and certificate is not null")
    found = families.certificate_anchors(signed, keys, settings)
    if found.isEmpty():
        return rules
    new = found.select(
        *by, F.col("family").alias("path"),
        certificate_condition(certificate_vendor(F.col("certificate"))).alias("certificate"),
        F.lit(None).cast("string").alias("process_path"), F.lit(None).cast("string").alias("created_by"),
        rule_order(stage, nulls_last(F.col("certificate"))).alias("ord"),
    )
    return cut_lineage(rules.unionByName(new, allowMissingColumns=True))


# --- suppression --------------------------------------------------------------------


def suppress_covered(rules: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Drop rules whose path another rule with the same identity conditions covers.

    Exact at every size. Of two patterns that match each other's text, the
    earlier rule stays.
    """
    keys = [*by, *IDENTITY]
    broad = rules.filter(
        F.contains("path", F.lit("*")) & ~risk.is_dangerous_user_wildcard(F.col("path"))
    ).groupBy(*keys, F.col("path").alias("pattern")).agg(F.min("ord").alias("broad_ord"))
    narrow = rules.groupBy(*keys, "path").agg(F.min("ord").alias("ord"))
    mutual = matches(F.col("path"), F.col("pattern")) & (F.col("ord") < F.col("broad_ord"))
    covered = pattern_pairs(
        narrow, broad, keys, residual=(F.col("path") != F.col("pattern")) & ~mutual
    ).select(*keys, "path").distinct()
    return null_safe_join(rules, covered, [*keys, "path"], "left_anti")


# --- the whole chain ------------------------------------------------------------------


def idle_passes(rules: DataFrame) -> set[Callable]:
    """Family passes that can find nothing from these rules on: no pass brings in a locale folder
    or a program extension that no rule has."""
    path = F.col("path")
    locale = F.arrays_overlap(segments(path), F.array(*[F.lit(x) for x in V.LANGUAGE_FOLDERS]))
    seen = rules.filter("path is not null").agg(
        F.bool_or(F.coalesce(locale, F.lit(False))).alias("locale"), F.bool_or(extension(path).isin(V.FAMILY_EXTENSIONS)).alias("program")
    ).first()
    return {p for p, found in ((compress_languages, seen["locale"]), (compress_extensions, seen["program"])) if not found}


def rule_chain(pairs: DataFrame, settings: RuleSettings, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Final rules with their ``ord``, in the fixed order of passes, and the rules dropped with global families."""
    rules = cut_lineage(base_rules(pairs, settings, by))
    idle = idle_passes(rules)
    unchanged: dict[str, DataFrame] = {}
    dropped = rules
    for stage, compress in enumerate(
        [
            compress_similar, compress_languages, compress_extensions,
            compress_globally, compress_languages, compress_extensions,
        ],
        1,
    ):
        if compress is compress_globally:
            dropped = rules
        # A pass that found nothing finds nothing again in the same table.
        if compress in idle or unchanged.get(compress.__name__) is rules:
            continue
        before, rules = rules, compress(rules, settings, by, stage)
        if rules is before:
            unchanged[compress.__name__] = rules
    rules = cut_lineage(filter_dangerous(distinct_rules(enforce_high_risk(rules, settings), by)))
    rules = add_certificate_anchors(rules, settings, by, 7)
    for stage, compress in ((8, compress_languages), (9, compress_extensions)):
        rules = rules if compress in idle else compress(rules, settings, by, stage)
    rules = suppress_covered(rules.withColumn("certificate", certificate_condition(F.col("certificate"))), by)
    rules = enforce_high_risk(filter_dangerous(rules), settings)
    return distinct_rules(rules, by), dropped_family_rules(dropped, settings, by)


def final_rules(pairs: DataFrame, settings: RuleSettings, by: Sequence[str] = ()) -> DataFrame:
    return rule_chain(pairs, settings, by)[0]


def ranked_rules(rules: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Final rules numbered in rule order within their scope."""
    return with_position(rules, [F.col("ord")], "rule_rank", keys=list(by)).drop("ord")


def risk_review(rules: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rules with conditions counted, risk scored and a note on what to check."""
    clean = cut_lineage(sanitize(rules))
    path, process, certificate, creator = _condition_columns()
    scored = clean.withColumns(
        {
            "condition_count": condition_count(),
            "risk_score": risk.risk_score(path, process, certificate, creator),
            "wildcard_count": stars(path),
            "review_notes": risk.review_note(path, process),
        }
    )
    return scored.withColumn("risk", risk.risk_label(F.col("risk_score")))


def review_order() -> list[Column]:
    return [F.asc("risk_score"), F.desc("condition_count"), F.asc("wildcard_count")]
