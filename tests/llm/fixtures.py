"""Small hard inputs: nulls, empties, long texts, ties, copies, clashing columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed: int = 3) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [r.choice(vocabulary) for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "two three"), (7, "x " * 3000), (8, "x " * 60)]
    for i in range(10, 40):  # near copies at all distances
        own = list(base)
        for _ in range(i - 10):
            own[r.randrange(len(own))] = r.choice(vocabulary)
        rows.append((i, " ".join(own)))
    rows += [(40 + i, " ".join(base)) for i in range(12)]  # a group of copies
    passage = " ".join(r.choice(vocabulary) for _ in range(55))
    rows += [(60 + i, " ".join(r.choice(vocabulary) for _ in range(40 + 5 * i)) + "  " + passage + "\n" + r.choice(vocabulary)) for i in range(12)]  # a shared passage
    rows += [(80, " ".join(r.choice(vocabulary) for _ in range(20_000))), (81, passage), (81, passage), (81, "another text of that id")]
    rows += [(None, passage + " and more"), (None, " ".join(base)), (None, None)]  # null ids
    return [(i, t, "en", ["a", "b", "c", None, "a"][(i or 0) % 5], len(t or "")) for i, t in rows]


def documents(spark, seed: int = 3):
    """With columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame(texts(seed), SCHEMA)
    return df.withColumns({"row": F.lit(1), "hash": F.lit("h"), "doc": F.lit(2), "n": F.lit(0), "score": F.lit(0.5), "size": F.lit(7), "bucket": F.lit(3)})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
