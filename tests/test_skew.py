"""Hot keys: results must not depend on salts, partitions or row order."""

import random

from pyspark.sql import functions as F

from fileledger.operators import skew


def hot_rows(spark, n=3000):
    """A third of all rows share one key."""
    rng = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(200)}" if i % 7 else None, i, rng.randrange(10**6)) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, id bigint, v bigint")


def test_group_totals_match_plain_groups(spark):
    rows, df = hot_rows(spark)
    got = skew.group_totals(
        df.repartition(7), ["k"], ["id"],
        {"n": F.count(F.lit(1)), "low": F.min("v")}, {"n": F.sum("n"), "low": F.min("low")},
    ).collect()
    want = {}
    for k, _, v in rows:
        n, low = want.get(k, (0, 10**9))
        want[k] = (n + 1, min(low, v))
    assert len(got) == len(rows)
    assert all((r["n"], r["low"]) == want[r["k"]] for r in got)


def test_attach_joins_like_a_plain_join(spark):
    rows, df = hot_rows(spark)
    payload = spark.createDataFrame([("hot", 1), ("hot", 2), ("k5", 3), (None, 4), ("none", 5)], "k string, p int")
    got = sorted((r["id"], r["p"]) for r in skew.attach(df, payload, ["k"], ["id"]).collect())
    by_key = {"hot": [1, 2], "k5": [3], None: [4]}
    assert got == sorted((i, p) for k, i, _ in rows for p in by_key.get(k, []))
    left = skew.attach(df, payload, ["k"], ["id"], "left")
    assert left.filter("p is null").count() == sum(k not in by_key for k, _, _ in rows)


def test_no_task_holds_a_hot_group(spark):
    _, df = hot_rows(spark)
    salted = skew.with_salt(df.filter("k = 'hot'"), ["id"], 16)
    sizes = [r["count"] for r in salted.groupBy(skew.SALT).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 1000 / 16


def test_positions_are_exact(spark):
    rows, df = hot_rows(spark)
    overall = skew.with_position(df.repartition(5), [F.asc("v"), F.asc("id")], "n")
    assert [r["id"] for r in overall.orderBy("n").collect()] == [i for _, i, _ in sorted(rows, key=lambda r: (r[2], r[1]))]
    assert overall.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first() == (1, len(rows), len(rows))
    inside = skew.with_position(df.repartition(5), [F.desc("v"), F.asc("id")], "n", keys=["k"]).collect()
    groups = {}
    for k, i, v in rows:
        groups.setdefault(k, []).append((-v, i))
    for members in groups.values():
        members.sort()
    assert all(groups[r["k"]].index((-r["v"], r["id"])) + 1 == r["n"] for r in inside)


def test_top_per_group_keeps_few(spark):
    rows, df = hot_rows(spark)
    got = skew.top_per_group(df.filter("k = 'hot'"), ["k"], [F.asc("v"), F.asc("id")], 5)
    want = sorted((v, i) for k, i, v in rows if k == "hot")[:5]
    assert sorted((r["v"], r["id"]) for r in got.collect()) == want
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_lookup_has_a_way_beyond_the_broadcast_bound(spark, monkeypatch):
    _, df = hot_rows(spark)
    dim = spark.createDataFrame([("hot", 1), ("k5", 2)], "k string, p int")
    small = sorted(map(tuple, skew.lookup(df, dim, ["k"], ["id"]).select("id", "p").collect()))
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 1)
    large = sorted(map(tuple, skew.lookup(df, dim, ["k"], ["id"]).select("id", "p").collect()))
    kept = skew.lookup(df, dim, ["k"], ["id"], "left_semi")
    assert small == large and kept.count() == len(large) and kept.columns == df.columns


def test_lookup_ways_agree_on_nulls_and_columns(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 6), (3, "z", 7)], "id int, k string, v int")
    dim = spark.createDataFrame([("a", 1), (None, 2)], "k string, p int")
    for how in ("inner", "left", "left_semi"):
        small = skew.lookup(df, dim, ["k"], ["id"], how)
        with monkeypatch.context() as m:
            m.setattr(skew, "BROADCAST_ROWS", 0)
            large = skew.lookup(df, dim, ["k"], ["id"], how)
        assert small.columns == large.columns == ["id", "k", "v", *["p"][: how != "left_semi"]]
        rows = [sorted(map(tuple, x.collect())) for x in (small, large)]
        assert rows[0] == rows[1] and len(rows[0]) == (3 if how == "left" else 1)
