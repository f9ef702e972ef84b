import math
import random
import statistics

from parcelforge.operators import analytics


def invented():
    r = random.Random(7)
    rows = [("a", r.random()) for _ in range(501)] + [("b", r.choice([1.0, 2.0, 2.0])) for _ in range(200)] + [("c", 5.0), ("d", None), (None, 3.0), (None, 4.5)]
    rows += [("e", 10.0 ** r.randrange(-300, 300)) for _ in range(300)] + [("f", s * 1e308) for s in (-1.7, 1.7, -1.2, 1.1)] + [("g", 1.0), ("g", math.nextafter(1.0, 2.0))]
    rows += [("h", -x * 1e-320) for x in range(50)] + [("i", None), ("i", 7.0), ("i", 9.0)]
    r.shuffle(rows)
    return rows


def test_selection_equals_the_median(spark):
    rows = invented()
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    want = {}
    for k in {k for k, _ in rows}:
        own = [v for x, v in rows if x == k and v is not None]
        want[k] = statistics.median(own) if own else None
    for most in (1_000_000, 0):
        got = dict(analytics.medians(df, "k", "v", 15, most).collect())
        assert set(got) == set(want)
        for k in want:
            assert got[k] == want[k] or math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-15), (k, most)


def test_no_task_gets_a_whole_group(spark):
    df = spark.range(60_000).selectExpr("0 as k", "cast((id * 7919) % 60000 as double) as v")
    counts = df.groupBy("k", "v").count().withColumnRenamed("count", "__n")
    out = analytics._selected(counts, "k", "v").first()
    assert (out["__lo"], out["__hi"]) == (29_999.0, 30_000.0)
    assert analytics.medians(df, "k", "v", most=100).first()["median_v"] == 29_999.5 and analytics.medians(df.limit(0), "k", "v").count() == 0
