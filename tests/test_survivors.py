"""One copy always stays, and what is not understood is never removed."""

import pytest
from pyspark.sql import functions as F

from fileledger.functions.hashes import valid_id
from fileledger.operators import dedup, reconcile, validate

SCHEMA = "applicationId string, organizationId string, applicationFileId string, hash string, isHashOnly boolean"
HASH = "A" * 64


def view(spark, ids, **columns):
    df = spark.createDataFrame([("app", "org", i, HASH, True) for i in ids], SCHEMA)
    for name, value in columns.items():
        df = df.withColumn(name, F.lit(value))
    return dedup.record_view(df)


@pytest.mark.parametrize(
    ("ids", "survivor"),
    [(["008", "007"], "007"), (["10", "9", "0011"], "9"), (["1" + "0" * 45, "9" * 44, "1" + "0" * 46], "9" * 44)],
)
def test_one_copy_stays(spark, ids, survivor):
    records = view(spark, ids)
    groups = dedup.hash_groups(records)
    assert groups.first()["survivor"] == survivor
    assert {r.fid for r in dedup.removal_targets(records, groups).collect()} == set(ids) - {survivor}


def test_padded_id_is_a_repeat(spark):
    repeated = validate.repeated_ids(view(spark, ["7", "007", "8"]), ["app", "applicationFileId"]).collect()
    assert [r.key for r in repeated] == ["app/7"]


def test_valid_ids(spark):
    ids = spark.createDataFrame([("0",), ("000",), ("5",), ("9" * 60,), ("-1",), ("x",), (None,)], "i string")
    assert [r[0] for r in ids.select(valid_id(F.col("i"))).collect()] == [False, False, True, True, False, False, False]


@pytest.mark.parametrize(("value", "kept"), [("rule", True), ("", False), (None, False), (False, True)])
def test_unknown_column_keeps_the_group(spark, value, kept):
    value = F.lit(value).cast("boolean" if isinstance(value, bool) else "string")
    group = dedup.hash_groups(view(spark, ["1", "2"], newMatchingField=value)).first()
    assert (group["survivor"] is None) == kept


def test_new_populated_column_changes_the_fingerprint(spark):
    def prints(**columns):
        return [r[0] for r in reconcile.with_fingerprint(view(spark, ["1"], **columns)).select("fingerprint").collect()]

    assert prints() == prints(newField=F.lit(None).cast("string")) != prints(newField="x")
