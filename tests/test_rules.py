"""Rule mining stages on small fixtures, and coverage against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fileledger.operators import coverage, dedup, families, rules
from fileledger.operators.pairs import candidate_pairs
from fileledger.operators.parsing import apply_parsing
from fileledger.operators.patterns import pattern_pairs
from fileledger.plans import consolidation_plan as cp
from fileledger.settings import RuleSettings, profile_settings
from tests.helpers import frame, record, source

PF = "c:\\program files\\"
RULE = "path string, certificate string, process_path string, created_by string"


def table(spark, *rows):
    df = spark.createDataFrame([tuple(r) for r in rows], RULE)
    order = rules.rule_order(0, rules.nulls_last(*[F.col(c) for c in rules.CONDITIONS]))
    return df.withColumn("ord", order)


def conditions(df):
    return sorted((tuple(r) for r in df.select(*rules.CONDITIONS).collect()), key=repr)


def found(df):
    return [r["family"] for r in df.collect()]


# --- the whole plan ------------------------------------------------------------


@pytest.fixture(scope="module")
def fixture_rows():
    custom = source(77, isHashOnly=False, fullPath=r"c:\custom\*")
    return [*[source(i) for i in range(1, 11)], source(99, notes="No observation"), custom]


def test_versions_become_one_rule_and_the_rest_is_preserved(spark, fixture_rows):
    view = dedup.record_view(frame(spark, fixture_rows))
    plan = cp.plan_consolidation(view, "balanced")
    assert conditions(plan.rules) == [(PF + r"codex fixture\app\*\*", None, PF + r"codex fixture\launcher.exe", None)]
    assert sorted(int(r["fid"]) for r in plan.targets.collect()) == list(range(1, 11))
    assert sorted(int(r["fid"]) for r in plan.fallback.collect()) == [77, 99]
    review = plan.reviews.first()
    assert (review["covered_observations"], review["status"]) == (10, "Review required")
    again = cp.plan_consolidation(view.join(plan.targets, ["app", "fid"], "left_anti"), "balanced")
    assert again.targets.count() == 0


def test_ambiguous_notes_key_files_and_macos_have_no_targets(spark, fixture_rows):
    rows = [source(1, notes=source(1)["notes"] + "\nPath: c:\\other.exe"), source(2, keyFile=True)]
    view = dedup.record_view(frame(spark, rows))
    assert cp.observed_records(view).count() == 0
    mac = cp.assign_rules(
        cp.observed_records(dedup.record_view(frame(spark, fixture_rows))),
        spark.createDataFrame(
            [(fixture_rows[0]["applicationId"], PF + r"codex fixture\app\*\*", None, PF + r"codex fixture\launcher.exe", None, 1)],
            f"app string, {RULE}, rule_rank bigint",
        ),
        windows=False,
    )
    assert mac.targets.count() == 0
    assert mac.reviews.first()["reason"].endswith("macOS candidate application is not yet live validated")


# --- families --------------------------------------------------------------------


def paths(spark, *values):
    return spark.createDataFrame([("g", v) for v in values], "k string, path string")


def test_same_shape_families(spark):
    settings = RuleSettings()

    def compress(*values):
        return found(families.similar_path_families(paths(spark, *values), ["k"], settings))

    root = PF + "vendor\\"
    assert compress(*[root + f"app\\1.{i}\\x.dat" for i in range(4)]) == [root + r"app\*\x.dat"]
    assert compress(*[root + f"app\\n{c}\\x.dat" for c in "abcd"]) == [root + r"app\*\x.dat"]
    # Too few, too many wildcards, or a position that repeats too often.
    assert compress(root + "1.1\\x.dat", root + "1.2\\x.dat") == []
    assert compress(*[root + f"{c}1\\{c}2\\{c}3.dat" for c in "abcd"]) == []
    assert compress(*[root + f"{d}\\{i}.dat" for d in "ab" for i in range(4)]) == []
    # Mixed depths: the largest family wins, then the shorter pattern.
    mixed = [root + f"app\\1.{i}\\x.dat" for i in range(3)] + [root + f"deep\\er\\1.{i}\\y.dat" for i in range(4)]
    assert compress(*mixed) == [root + r"deep\er\*\y.dat"]
    assert compress(*[root + f"t\\msi{i}f.tmp-{i}\\x.dat" for i in range(3)]) == [root + r"t\*.tmp-0\x.dat"]


def test_extension_language_and_certificate_families(spark):
    settings, root = RuleSettings(), PF + "vendor\\"
    libraries = [root + "a\\x.dll", root + "b\\y.dll", root + "z.dll"]
    assert found(families.extension_families(paths(spark, *libraries), ["k"], settings)) == [root + "*.dll"]
    assert found(families.extension_families(paths(spark, *libraries, root + "q.exe"), ["k"], settings)) == []
    assert found(families.extension_families(paths(spark, *[f"c:\\users\\{c}\\x.dll" for c in "abc"]), ["k"], settings)) == []
    locales = [root + f"{x}\\r.mui" for x in ("en-us", "de-de", "fr")]
    assert found(families.language_families(paths(spark, *locales), ["k"], settings)) == [root + "*"]
    assert found(families.language_families(paths(spark, *locales[:2], root + "r.mui"), ["k"], settings)) == []
    assert found(families.certificate_anchors(paths(spark, *libraries), ["k"], settings)) == [root + "*"]
    assert found(families.certificate_anchors(paths(spark, *[PF + f"{c}\\x.dll" for c in "abc"]), ["k"], settings)) == []
    posix = [f"/opt/vendor/{c}/lib.jar" for c in "abc"]
    assert found(families.extension_families(paths(spark, *posix), ["k"], settings)) == ["/opt/vendor/*.jar"]


def test_family_passes_replace_what_they_cover(spark):
    settings, root = RuleSettings(), PF + "vendor\\"
    rows = [(root + f"{c}\\x.dll", "o=v", None, None) for c in "abc"] + [(root + "a\\y.txt", "o=w", None, None)]
    before = table(spark, *rows)
    assert conditions(rules.compress_extensions(before, settings, [], 1)) == sorted(
        [(root + "*.dll", "o=v", None, None), rows[3]], key=repr
    )
    unchanged = table(spark, rows[0], rows[3])
    assert rules.compress_extensions(unchanged, settings, [], 1) is unchanged


def test_global_families_and_the_option_to_keep_their_members(spark):
    rows = [(PF + f"v\\1.{i}\\x.dat", f"o=c{i}", None, None) for i in range(3)]
    before = table(spark, *rows)
    after = rules.compress_globally(before, RuleSettings(), [], 1)
    assert conditions(after) == [(PF + r"v\*\x.dat", None, None, None)]
    kept = RuleSettings(global_families=False)
    assert rules.compress_globally(before, kept, [], 1) is before
    assert len(conditions(rules.dropped_family_rules(before, RuleSettings()))) == 3


def test_suppression(spark):
    rows = [
        (PF + r"v\*", "o=c", None, None), (PF + r"v\app\*", "o=c", None, None), (PF + r"v\app\x.exe", "o=c", None, None),
        (PF + r"v\app\x.exe", "o=d", None, None), (PF + r"v\app\x.exe", "o=c", "p", None),
        (r"d:\a\*", "o=c", None, None), (r"d:\a\**", "o=c", None, None), (r"c:\users\*\*", "o=c", None, None),
        (r"c:\users\bob\x.exe", "o=c", None, None),
    ]
    # The two patterns that match each other's text: the earlier one stays.
    assert conditions(rules.suppress_covered(table(spark, *rows))) == sorted(
        [rows[0], rows[3], rows[4], rows[5], rows[7], rows[8]], key=repr
    )


def test_three_profiles(spark):
    notes = [
        rf"Path: C:\Users\bob{i}\Vendor\App\2.{i}\tool.exe Process: C:\Vendor\run.exe Cert: O=Autodesk, Inc. Created By: ops"
        for i in range(4)
    ]
    parsed = apply_parsing(spark.createDataFrame([(i, n) for i, n in enumerate(notes)], "row_id int, Notes string"))

    def mined(profile):
        return candidate_pairs(parsed, profile_settings(profile), "row_id")

    assert mined("conservative").count() == 9
    balanced = mined("balanced")
    wildcards = {r["condition2_wc"] for r in balanced.filter("pair_type = 'ProcessPath'").collect()}
    assert wildcards == {r"c:\users\*\vendor\app\*\tool.exe"}
    assert {r["occurrences"] for r in balanced.collect()} == {4}
    types = {r["pair_type"] for r in mined("aggressive").collect()}
    assert types == {"ProcessPath", "ProcessCert", "PathCert", "PathCreatedBy", "ProcessCreatedBy"}


def test_sanitize_and_risk(spark):
    rows = table(
        spark,
        ("/users/a/library/python/3.9/lib/python/site-packages/numpy/core.so", "Autodesk, Inc.", "/applications/*", None),
        ("/applications/foo.app/contents/macos/foo", None, "/private/var/folders/a/b/t/apptranslocation/*/d/x.app/contents/macos/x", None),
    )
    clean = conditions(rules.sanitize(rows))
    assert clean == sorted(
        [
            ("/users/*/library/python/*/lib/python/site-packages/numpy/*", "o=autodesk", None, None),
            ("/applications/foo.app/*", None, "/applications/x.app/contents/macos/x", None),
        ],
        key=repr,
    )


# --- coverage ------------------------------------------------------------------------


def sequential(edges, order, least=2):
    """Plain model: rules one by one, each keeping what no earlier one took."""
    taken, result = {}, {}
    for rule in order:
        new = [o for o in edges.get(rule, {}) if o not in taken]
        if sum(edges[rule][o] for o in new) >= least:
            taken.update(dict.fromkeys(new, rule))
            result[rule] = new
    return taken


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_acceptance_equals_the_sequential_scan(spark, seed):
    rng, want, rows = random.Random(seed), {}, []
    for app in ("a", "b"):
        weights = {o: rng.choice([1, 1, 1, 2]) for o in range(30)}
        edges = {r: {o: weights[o] for o in rng.sample(range(30), rng.randint(1, 4))} for r in range(40)}
        rows += [(app, r, f"{o}", n) for r, os in edges.items() for o, n in os.items()]
        want[app] = sequential(edges, range(40))
    df = spark.createDataFrame(rows, "app string, rule_rank bigint, obs_id string, records bigint")
    accepted, _ = coverage.accept_rules(df, ["app"])
    got = coverage.first_accepted(df, accepted, ["app"]).collect()
    assert {(r["app"], int(r["obs_id"]), r["rule_rank"]) for r in got} == {
        (app, o, rule) for app, taken in want.items() for o, rule in taken.items()
    }


def test_coverage_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["a", "b", "a.b", "x1"]

    def any_path():
        return "c:\\" + "\\".join(rng.choice(words) for _ in range(rng.randint(1, 4)))

    def any_pattern():
        text = any_path()
        for _ in range(rng.randint(0, 2)):
            cut = rng.randrange(len(text))
            text = text[:cut] + "*" + text[cut + rng.randint(0, 3):]
        return text

    observations = [
        (rng.choice([any_path(), any_path(), None]), rng.choice(["CN=V", None]), rng.choice(["p", "P q", None]), rng.choice(["Bob", None]))
        for _ in range(120)
    ]
    candidates = [
        (rng.choice([any_pattern(), any_pattern(), None]), rng.choice(["cn=v", "c*", None, None]), rng.choice(["P", "p*", None, None]), rng.choice(["bob", None, None]), i)
        for i in range(60)
    ]
    obs = spark.createDataFrame(observations, RULE)
    values = coverage.distinct_condition_values(obs)
    ranked = spark.createDataFrame(candidates, RULE + ", rule_rank bigint")

    def hits(pattern, value, fold):
        if not pattern:
            return True
        regex = ".*".join(re.escape(p) for p in pattern.split("*"))
        return bool(value) and re.fullmatch(regex, value, re.I | re.S if fold else re.S) is not None

    for fold in (True, False):
        got = coverage.coverage_edges(values, ranked, ignore_case=fold).groupBy("rule_rank").agg(F.sum("records").alias("n"))
        want = {}
        for *rule, rank in candidates:
            n = sum(all(hits(p, v, fold) for p, v in zip(rule, o)) for o in observations)
            if n:
                want[rank] = n
        assert {r["rule_rank"]: r["n"] for r in got.collect()} == want


def test_lookups_are_never_broadcast(spark):
    # What an explode makes has no estimate: tables that look small must not reach the driver.
    numbers = spark.range(1, 4).withColumn("certificate", F.concat(F.lit("CN="), "id"))
    numbers = numbers.withColumns({"process_path": F.concat(F.lit("p"), "id"), "created_by": F.lit(None).cast("string")})
    exact = numbers.withColumn("path", F.concat(F.lit(PF), "id", F.lit("\\b.exe")))
    broad = numbers.withColumn("path", F.concat(F.lit(PF), "id", F.lit("\\*")))
    edges = coverage.coverage_edges(coverage.distinct_condition_values(exact), broad.withColumnRenamed("id", "rule_rank"))
    found_pairs = pattern_pairs(exact, broad.select(F.col("path").alias("pattern")), [])
    for df in (edges, found_pairs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert edges.count() == 3 and found_pairs.count() == 3


def test_static_reasons(spark):
    launcher = PF + r"v\run.exe"
    cases = {
        (PF + r"v\app\*", None, None, None): "Requires path plus another condition",
        (PF + r"v\app?\*", None, launcher, None): "Unsupported matching syntax",
        (PF + r"v\app\*", "o=*", launcher, None): "Identity anchors must be exact",
        (r"d:\v\app\*", None, launcher, None): "Live consolidation limited to Windows Program Files paths",
        (PF + "*", None, launcher, None): "Path is too broad",
        (PF + r"v\app\*", None, r"c:\windows\system32\cmd.exe", None): "High-risk process needs three conditions",
    }
    df = spark.createDataFrame(list(cases), RULE)
    reasons = coverage.static_reasons(F.lit(True))
    got = df.select(*rules.CONDITIONS, F.array_compact(F.array(*[F.when(b, F.lit(r)) for r, b in reasons.items()])).alias("r"))
    for row in got.collect():
        assert row["r"][0] == cases[tuple(row)[:4]]
    fine = spark.createDataFrame([(PF + r"v\app\*", None, launcher, None)], RULE)
    assert fine.filter(~F.greatest(*[b for b in reasons.values()])).count() == 1


def observed_paths(spark, paths, processes=(r"c:\x\launcher.exe",)):
    rows = [(f"{i:064X}", f"Path: {p}\nProcess: {processes[i % len(processes)]}") for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, "Hash string, Notes string").withColumn("row_id", F.monotonically_increasing_id())


def sibling_paths(spark, paths):
    settings = RuleSettings()
    found = candidate_pairs(apply_parsing(observed_paths(spark, paths)), settings, "row_id")
    base = rules.base_rules(found, settings).filter("rule_type = 'MergedPathGroup'")
    return found, [r["path"] for r in base.collect()]


def test_siblings_are_merged_over_all_their_paths(spark):
    """The sixth path decides: with five alike, a merged rule must not hide it."""
    alike = [PF + rf"vendor\tool\part{c}\run.exe" for c in "abcdefgh"]
    assert sibling_paths(spark, alike)[1] == [PF + r"vendor\*"]
    found, merged = sibling_paths(spark, [*alike, r"c:\windows\zz\run.exe"])
    assert merged == []
    assert {len(r["example_paths"].split("\n")) for r in found.collect()} <= {1, 2, 3, 4, 5}
    # In another order of rows, the same.
    assert sibling_paths(spark, [r"c:\windows\zz\run.exe", *alike[::-1]])[1] == []
    spans = found.selectExpr("sum(span.lines) AS n", "max(span.high_depth) AS depth").first()
    assert (spans["n"], spans["depth"]) == (9, 5)


@pytest.mark.parametrize("profile", ["conservative", "balanced"])
def test_applied_plans_leave_nothing_to_do(spark, fixture_rows, profile):
    view = dedup.record_view(frame(spark, fixture_rows))
    plan = cp.plan_consolidation(view, profile)
    assert {r["status"] for r in plan.reviews.collect()} <= {"Review required", "Preserved / review"}
    targets = sorted(int(r["fid"]) for r in plan.targets.collect())
    assert targets == list(range(1, 11))
    inserted = cp.replacement_records(plan.rules, "run 1", "org").collect()
    assert len(inserted) == plan.rules.count() > 0
    for r in inserted:
        assert (r["hash"], r["isHashOnly"], r["keyFile"], r["osType"]) == ("", False, False, 1)
        assert r["notes"].startswith("Consolidation run 1 rule ") and r["fullPath"] and r["processPath"]
    after = view.join(plan.targets, ["app", "fid"], "left_anti")
    assert cp.plan_consolidation(after, profile).targets.count() == 0


def test_outputs_hold_every_table_of_a_run(spark):
    paths = [PF + rf"v{k}\1.{i}\x.exe" for k in range(2) for i in range(3)]
    processes = [rf"c:\x\run{n}.exe" for n in range(6)]  # no two versions below one process
    out = cp.build_outputs(observed_paths(spark, paths, processes), profile_settings("conservative"), "row_id")
    assert out.parsed.count() == out.combined_review.count() == 6
    assert {"Path", "Process Path", "SHA256"} <= set(out.combined_review.columns)
    assert out.pair_export.count() == out.candidate_pairs.count() > 0
    names = {r["pair_name"] for r in out.pair_export.collect()}
    assert names == {f"Pair {n + 1:04d}" for n in range(len(names))}
    final, dropped = conditions(out.final_rules), out.dropped_rules.collect()
    assert conditions(out.risk_review) == final and len(final) == len(set(final))
    assert dropped and all(r["family"] and not r["family"] == r["path"] for r in dropped)
    assert not {tuple(r)[:4] for r in dropped} & set(final)


def test_copies_share_a_rule(spark):
    """A hot observation: many records with the same note."""
    note = source(1)["notes"]
    rows = [record(i, f"{i:064X}", notes=note) for i in range(1, 400)]
    observed = cp.observed_records(dedup.record_view(frame(spark, rows)))
    ranked = spark.createDataFrame(
        [(rows[0]["applicationId"], PF + r"codex fixture\app\*\agent.exe", None, PF + r"codex fixture\launcher.exe", None, 1)],
        f"app string, {RULE}, rule_rank bigint",
    )
    plan = cp.assign_rules(observed, ranked)
    assert plan.targets.count() == 399 and plan.reviews.first()["covered_observations"] == 399
