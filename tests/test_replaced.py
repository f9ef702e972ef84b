import pytest
from pyspark.sql import functions as F

from parcelforge.sources import replaced


def rows(spark, *values):
    return spark.createDataFrame(list(values), "case_id string, n int, text string")


def content(spark, at):
    return sorted(tuple(r) for r in replaced.read(spark, at).collect())


def test_replace_keeps_other_keys_and_repeats_give_the_same(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    first = rows(spark, *((f"c{i}", k, "old") for i in range(40) for k in range(2)), (None, 0, "none"))
    assert replaced.replace(first, first, at, "case_id", buckets=8) == 1
    new = rows(spark, ("c3", 7, "new"), ("c50", 1, "new"))
    gone = spark.createDataFrame([("c3",), ("c4",)], "case_id string")
    want = sorted([(f"c{i}", k, "old") for i in range(40) if i not in (3, 4) for k in range(2)] + [("c3", 7, "new"), ("c50", 1, "new"), (None, 0, "none")], key=lambda x: (x[0] is None, x))
    for number in (2, 3):  # a revalidation twice leaves the same rows
        assert replaced.replace(new, gone, at, "case_id") == number
        assert sorted(map(tuple, replaced.read(spark, at).collect()), key=lambda x: (x[0] is None, x)) == want
    assert replaced.replace(rows(spark), spark.createDataFrame([(None,)], "case_id string"), at, "case_id") == 4
    assert replaced.read(spark, at).filter("case_id is null").isEmpty()


def test_only_touched_buckets_are_written(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    first = rows(spark, *((f"c{i}", i, "x") for i in range(200)))
    replaced.replace(first, first, at, "case_id", buckets=16)
    before = replaced._manifest(spark, at)[1]["buckets"]
    replaced.replace(rows(spark, ("c7", 1, "y")), rows(spark).select("case_id"), at, "case_id")
    after = replaced._manifest(spark, at)[1]["buckets"]
    assert sum(before[k] != after[k] for k in before) == 1


def test_failed_write_leaves_the_old_rows(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    first = rows(spark, ("a", 1, "x"), ("b", 2, "x"))
    replaced.replace(first, first, at, "case_id")
    broken = first.withColumn("text", F.when(F.col("n") == 2, F.raise_error(F.lit("lost")).cast("string")).otherwise("y"))
    with pytest.raises(Exception, match="lost"):
        replaced.replace(broken, first, at, "case_id")
    assert content(spark, at) == [("a", 1, "x"), ("b", 2, "x")]
    assert replaced.replace(first.withColumn("text", F.lit("y")), first, at, "case_id") == 2
    assert content(spark, at) == [("a", 1, "y"), ("b", 2, "y")]


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/t"
    first = rows(spark, ("a", 1, "x"))
    replaced.replace(first, first, at, "case_id")
    seen = replaced._manifest(spark, at)
    replaced.replace(rows(spark, ("a", 2, "first")), first, at, "case_id")
    monkeypatch.setattr(replaced, "_manifest", lambda spark, at: seen)
    with pytest.raises(replaced.Conflict):
        replaced.replace(rows(spark, ("a", 3, "second")), first, at, "case_id")
    monkeypatch.undo()
    assert content(spark, at) == [("a", 2, "first")]
