"""Which records each rule covers, and which rule each record goes to.

Records are reduced to distinct observations first: copies match the same rules,
so a much repeated observation is matched once and counted by its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger import fixed_values as V
from fileledger.functions.paths import literal_head, literal_leaf, path_prefixes
from fileledger.functions.risk import is_high_risk_process
from fileledger.functions.text import matches
from fileledger.operators.rules import CONDITIONS
from fileledger.operators.skew import null_safe_join, unestimated
from fileledger.session import cut_lineage

_IDENTITY = ["process_path", "certificate", "created_by"]


def distinct_condition_values(observations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct observations with the number of records that have them."""
    return observations.groupBy(*by, *CONDITIONS).agg(F.count(F.lit(1)).alias("records")).withColumn(
        "obs_id", F.sha2(F.to_json(F.struct(*by, *CONDITIONS), {"ignoreNullFields": "false"}), 256)
    )


def _identity_mask() -> Column:
    """Which identity conditions of a rule are literal text, one bit each."""
    mask = F.lit(0)
    for bit, name in enumerate(_IDENTITY):
        literal = (F.coalesce(F.col(name), F.lit("")) != "") & ~F.contains(name, F.lit("*"))
        mask = mask + F.when(literal, F.lit(1 << bit)).otherwise(F.lit(0))
    return mask


def _meeting_keys(values: DataFrame, by: Sequence[str], masks: Sequence[int]) -> DataFrame:
    """(obs_id, key): one slim row for each place of the rule index an observation may be found at."""
    path = F.coalesce("path", F.lit(""))
    identities = []
    for mask in masks:
        bits = [b for b in range(len(_IDENTITY)) if mask & (1 << b)]
        parts = [F.coalesce(F.col(_IDENTITY[b]), F.lit("")) for b in bits]
        # An observation without an identity cannot match a rule that requires it.
        given = F.lit(True)
        for part in parts:
            given = given & (part != "")
        identities.append(F.when(given, F.xxhash64(F.lit(mask), *[F.col(c) for c in by], *parts)))
    slim = values.select(
        "obs_id", path_prefixes(path).alias("_heads"),
        F.array_distinct(F.array(F.lit(""), F.regexp_extract(path, r"[\\/]([^\\/]+)$", 1))).alias("_leaves"),
        F.array_compact(F.array(*identities)).alias("_identities"),
    )
    slim = slim.select("obs_id", "_leaves", "_identities", F.explode("_heads").alias("_head"))
    slim = slim.select("obs_id", "_head", "_identities", F.explode("_leaves").alias("_leaf"))
    slim = slim.select("obs_id", F.xxhash64("_head", F.lit("/"), "_leaf").alias("_place"), F.explode("_identities").alias("_identity"))
    return slim.select("obs_id", F.xxhash64("_place", "_identity").alias("key"))


def coverage_edges(
    values: DataFrame, rules: DataFrame, by: Sequence[str] = (), ignore_case: bool = True
) -> DataFrame:
    """(scope, rule_rank, obs_id, records): every rule and observation that match.

    All populated conditions of a rule must match. The rules' scope, literal head and last
    segment of the path and literal identity conditions make an index of hashed keys.
    Observations look up the keys they may be found at, with nothing but their id; only what
    the index holds meets the values, on which the match is then decided.
    """
    if ignore_case:
        folded = {c: F.lower(F.col(c)) for c in CONDITIONS}
        values, rules = values.withColumns(folded), rules.withColumns(folded)
    shaped = rules.withColumn("_mask", _identity_mask())
    # At most eight masks: observations are not looked up for combinations no rule has.
    masks = sorted(r[0] for r in shaped.select("_mask").distinct().collect()) or [0]
    place = F.xxhash64(
        F.coalesce(literal_head(F.col("path")), F.lit("")), F.lit("/"), F.coalesce(literal_leaf(F.col("path")), F.lit(""))
    )
    identity = F.lit(None).cast("long")
    for mask in masks:
        parts = [F.coalesce(F.col(_IDENTITY[b]), F.lit("")) for b in range(len(_IDENTITY)) if mask & (1 << b)]
        identity = F.when(F.col("_mask") == mask, F.xxhash64(F.lit(mask), *[F.col(c) for c in by], *parts)).otherwise(identity)
    index = shaped.select(F.xxhash64(place, identity).alias("key"), *[F.col(c).alias(f"rule_{c}") for c in [*by, *CONDITIONS]], "rule_rank")
    met = unestimated(_meeting_keys(values, by, masks)).join(index, "key").drop("key")
    joined = unestimated(values).join(met, "obs_id")
    # Hashed keys may meet by chance, so scope and conditions are compared as they are.
    hit = F.lit(True)
    for name in by:
        hit = hit & F.col(f"rule_{name}").eqNullSafe(F.col(name))
    for name in CONDITIONS:
        hit = hit & matches(F.col(f"rule_{name}"), F.col(name), ignore_case=False)
    return joined.filter(hit).select(*by, "rule_rank", "obs_id", "records")


def static_reasons(os_type: Column) -> dict[str, Column]:
    """Reasons a rule is not usable whatever it covers, in reporting order."""
    path = F.lower(F.coalesce("path", F.lit("")))
    texts = [F.coalesce(F.col(c), F.lit("")) for c in CONDITIONS]
    conditions = sum([(t != "").cast("int") for t in texts[1:]], (texts[0] != "").cast("int"))
    unsupported = F.lit(False)
    for text in texts:
        unsupported = unsupported | F.contains(text, F.lit("?")) | F.lower(text).startswith("regex:")
    starred = F.lit(False)
    for name in _IDENTITY:
        starred = starred | F.contains(F.coalesce(F.col(name), F.lit("")), F.lit("*"))
    head = F.split(F.element_at(F.split(path, r"\\\*"), 1), r"\\")
    in_program_files = F.lit(False)
    for folder in V.PROGRAM_FILES:
        in_program_files = in_program_files | path.startswith(f"c:\\{folder}\\")
    return {
        V.REJECT_CONDITIONS: (conditions < 2) | (path == ""),
        V.REJECT_SYNTAX: unsupported,
        V.REJECT_ANCHORS: starred,
        V.REJECT_LOCATION: ~in_program_files,
        V.REJECT_BROAD: F.size(head) < 4,
        V.REJECT_HIGH_RISK: is_high_risk_process(F.col("process_path")) & (conditions < 3),
    }


def accept_rules(edges: DataFrame, by: Sequence[str] = (), least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Greedy acceptance in rule order: a rule needs ``least`` records no earlier rule took.

    Returns (accepted ``by + rule_rank``, the edges of accepted rules). Equal to going
    through the rules one by one, but many rules are decided per round from two bounds on
    what a rule would newly cover: records no earlier undropped rule holds (it gets at
    least those), and records no earlier accepted rule holds (it gets at most those). The
    first undecided rule of a scope always has equal bounds, so every round makes
    progress; the number of rounds is the longest chain of rules that depend on each other.

    A round reads and writes what is still open: edges of undecided rules to records that no
    earlier accepted rule holds, with the first accepted rule behind them.
    """
    rule, obs = [*by, "rule_rank"], [*by, "obs_id"]
    taken = F.lit(None).cast(edges.schema["rule_rank"].dataType)
    open_edges = cut_lineage(edges.withColumn("_taken", taken))
    accepted = []
    while True:
        first = open_edges.groupBy(*obs).agg(F.least(F.min("rule_rank"), F.min("_taken")).alias("_first"))
        held = null_safe_join(unestimated(open_edges), first, obs)
        bounds = held.groupBy(*rule).agg(
            F.coalesce(F.sum(F.when(F.col("_first") == F.col("rule_rank"), F.col("records"))), F.lit(0)).alias("_sure"),
            F.sum("records").alias("_most"),
        )
        decided = cut_lineage(
            bounds.filter((F.col("_sure") >= least) | (F.col("_most") < least)).select(*rule, (F.col("_sure") >= least).alias("_accept"))
        )
        if decided.isEmpty():
            break
        new = decided.filter("_accept").select(*rule)
        accepted.append(new)
        claims = null_safe_join(unestimated(open_edges), new, rule).groupBy(*obs).agg(F.min("rule_rank").alias("_claim"))
        undecided = null_safe_join(unestimated(open_edges), decided.select(*rule), rule, "left_anti")
        left = null_safe_join(unestimated(undecided), claims, obs, "left").withColumn("_taken", F.least("_taken", "_claim"))
        open_edges = cut_lineage(
            left.filter(F.col("_taken").isNull() | (F.col("_taken") > F.col("rule_rank"))).drop("_claim")
        )
    chosen = accepted[0] if accepted else edges.select(*rule).limit(0)
    for more in accepted[1:]:
        chosen = chosen.unionByName(more)
    return chosen, null_safe_join(unestimated(edges), chosen, rule, "left_semi")


def first_accepted(edges: DataFrame, accepted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The accepted rule of each observation: the lowest one that covers it."""
    rule, obs = [*by, "rule_rank"], [*by, "obs_id"]
    held = null_safe_join(unestimated(edges), accepted, rule, "left_semi")
    return held.groupBy(*obs).agg(F.min("rule_rank").alias("rule_rank"))


def new_coverage(edges: DataFrame, assignment: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per rule: all covered records, and those no earlier accepted rule took."""
    taken = assignment.withColumnRenamed("rule_rank", "_taken")
    held = null_safe_join(unestimated(edges), taken, [*by, "obs_id"], "left")
    free = F.col("_taken").isNull() | (F.col("_taken") >= F.col("rule_rank"))
    return held.groupBy(*by, "rule_rank").agg(
        F.sum("records").alias("covered"),
        F.coalesce(F.sum(F.when(free, F.col("records"))), F.lit(0)).alias("new_records"),
    )
