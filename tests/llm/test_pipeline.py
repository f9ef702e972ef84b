"""The stages against brute force on a small corpus."""

import re
import zlib
from collections import Counter

import fixtures
import numpy as np
import pyarrow as pa
import test_decontaminate
import test_jaccard
import test_mixing
import test_substrings
from pyspark.sql import functions as F

import corpus_pipeline as P
from parcelforge.llm import mixing, quality
from parcelforge.llm.storage import stored


def tables(spark, at):
    docs = spark.createDataFrame(fixtures.texts(), fixtures.SCHEMA)
    noise = spark.createDataFrame([(200 + i, "!! ## " * (10 + i), "en", "a", 60) for i in range(40)], fixtures.SCHEMA)
    docs = docs.unionByName(noise)
    docs.write.mode("overwrite").parquet(f"{at}/documents.parquet")
    labels = docs.filter("doc_id is not null").select("doc_id", F.when(F.col("doc_id") >= 200, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic")).distinct()
    labels.write.mode("overwrite").parquet(f"{at}/labels.parquet")
    test_decontaminate.items(spark, docs).filter("item_id in (1, 8)").write.mode("overwrite").parquet(f"{at}/benchmark.parquet")
    return spark.read.parquet(f"{at}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def full(df):
    return [tuple(r) for r in df.select(*P.COLUMNS).collect()]


def test_quality_stage(spark, tmp_path):
    docs, at = tables(spark, str(tmp_path)), str(tmp_path)
    good = P.keep_good(spark, docs, at)
    assert good.columns == P.COLUMNS
    rows, labels = full(docs), {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    x = quality.features_of(pa.array([r[1] for r in rows], pa.string()))
    one = {}
    for r, own in zip(rows, x.tolist(), strict=True):
        if r[0] in labels:
            one[r[0]] = min(own, one.get(r[0], own))
    model = quality.fit(np.array(list(one.values())), np.array([labels[i] == 1 for i in one]))
    assert sorted(full(good), key=repr) == sorted((r for r, s in zip(rows, x @ model.weights - model.threshold, strict=True) if s >= 0), key=repr)
    assert not any(r[0] and r[0] >= 200 for r in full(good)) and any(r[0] is None for r in full(good))


def one_each(rows, kept):
    """Whether ``kept`` holds one row of each group of near copies in ``rows``, that with the least id, and all rows without words."""
    left, seen = Counter(kept), set()
    for k, (size, group) in enumerate(test_jaccard.linked([r[:2] for r in rows], P.NEAR_WORDS, P.NEAR_PERCENT)):
        if not size:
            left[rows[k]] -= 1
        elif k not in seen:
            seen |= group
            least = min((rows[j][0] is None, rows[j][0] or 0) for j in group)
            own = {rows[j] for j in group if (rows[j][0] is None, rows[j][0] or 0) == least and left[rows[j]]}
            if len(own) != 1:
                return False
            left[own.pop()] -= 1
    return not +left and min(left.values(), default=0) == 0


def copies(rows):
    """Copies of each row by systematic sampling, summed over equal rows, from plain sums."""
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    size, docs = Counter(), Counter()
    for r, n in zip(rows, words, strict=True):
        size[r[3]] += n
        docs[r[3]] += 1
    target = test_mixing.targets(dict(size))
    return {s: (target[s], size[s], docs[s]) for s in size}, words


def test_stages(spark, tmp_path):
    docs, at = tables(spark, str(tmp_path)), str(tmp_path)
    assert [n for n, _ in P.STAGES] == ["quality", "jaccard", "substrings", "decontaminate", "mixing"]
    one = stored(P.one_of_group(spark, docs, at), "one")
    assert one.columns == P.COLUMNS and one_each(full(docs), full(one)) and one.count() < docs.count()
    cut = P.without_repeats(spark, one, at)
    before = pairs(one)
    kept = {(i, t if gone else whole) for (_, whole), (i, n, gone, t) in zip(before, test_substrings.by_row(before), strict=True) if not gone or gone < n}
    assert set(pairs(cut)) == kept and cut.columns == P.COLUMNS
    clean = P.without_benchmark(spark, cut, at)
    hit = {i for i, _, n, _ in test_decontaminate.brute_force(pairs(cut), [tuple(r) for r in spark.read.parquet(f"{at}/benchmark.parquet").select("item_id", "text").collect()]) if n}
    assert hit and {i for i, _ in pairs(clean)} == {i for i, _ in pairs(cut)} - hit
    last = P.mixed(spark, clean, at)
    assert set(pairs(last)) <= set(pairs(clean)) and last.agg(F.max("copy")).first()[0] <= 2


def test_survivors_are_rows(spark, tmp_path):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(5, a, "en", "s", 1), (81, a, "en", "s", 1), (81, b, "en", "s", 1), (None, a, "de", "s", 1), (None, b + " x", "en", None, 1), (9, "c d", "en", "s", 1), (9, "c d", "en", "s", 1), (9, "c d", "de", "s", 1), (None, "e f g", "en", "s", 1), (None, "e f g", "en", "t", 1), (3, None, "en", "s", 0), (3, None, "en", "s", 0)]
    kept = full(P.one_of_group(spark, spark.createDataFrame(rows, fixtures.SCHEMA).repartition(3), str(tmp_path)))
    assert one_each(rows, kept) and sorted(map(str, (r[:2] for r in kept))) == sorted(map(str, [(5, a), (81, b), (9, "c d"), (None, "e f g"), (3, None), (3, None)]))


def test_copies_of_equal_rows(spark, tmp_path):
    rows = [(None, "one two three four five six seven", "en", "a", 5)] * 60 + [(i, "w " * (i % 7 + 1), "en", ["b", None][i % 2], 2) for i in range(80)]
    docs = spark.createDataFrame(rows, fixtures.SCHEMA)
    out = P.mixed(spark, docs, str(tmp_path)).collect()
    want = mixing.mix_sources(docs.withColumn("k", F.xxhash64(*P.COLUMNS)), id_col="k")
    per = {r.source: r.taken for r in want.groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    got = Counter()
    for r in out:
        got[r.source] += r["size"]
    assert dict(got) == {s: n for s, n in per.items() if n}
    shares, _ = copies(rows)
    assert all(abs(got[s] - t) <= 8 for s, (t, _, _) in shares.items())
    assert len({(r.copy) for r in out}) <= 2 and sorted(map(str, out)) == sorted(map(str, P.mixed(spark, docs.repartition(5), str(tmp_path)).collect()))


def test_run(spark, small):
    out = P.run(spark, small)
    assert out.count() > 0 and set(P.COLUMNS) <= set(out.columns)


def test_run_on_an_empty_table(spark, tmp_path):
    docs = tables(spark, str(tmp_path)).limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0
