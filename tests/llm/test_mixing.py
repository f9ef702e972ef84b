import re

import fixtures
import pytest
from pyspark.sql import functions as F

from parcelforge.llm import mixing


def targets(sizes, weights=(3, 1, 2)):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] >= 2 * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_targets_and_copies(spark):
    docs = fixtures.documents(spark)
    rows = mixing.mix_sources(docs).collect()
    size = {}
    for r in docs.select("source", "text").collect():
        size[r.source] = size.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = targets(size)
    assert len(rows) == docs.count()
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 2 and r.taken == r.copies * r.size
    assert sum(want.values()) == pytest.approx(1.5 * sum(size.values()))
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()), key=str)


def test_words_taken_come_near_the_targets(spark):
    n = 6000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).alias("source"), F.repeat(F.lit("w "), (F.col("id") * 37 % 400).cast("int")).alias("text"))
    per = mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.02 * r.target for r in per)


def test_null_and_repeated_ids_count_row_by_row(spark):
    rows = [(None, "w " * (i % 9 + 1), "a") for i in range(120)] + [(7, "w w w", "a")] * 30 + [(i, "w " * 5, "b") for i in range(300, 340)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"salt": F.lit(1), "class": F.lit("x"), "place": F.lit(0), "spread": F.lit(3)})
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(rows) and sorted(map(str, out)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))
    for s in "ab":
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 9


def test_empty_table_and_empty_texts(spark):
    assert mixing.mix_sources(fixtures.empty(spark)).count() == 0
    out = mixing.mix_sources(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert {(r.doc_id, r.size, r.target, r.taken) for r in out} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
