import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parcelforge.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"
FIGURES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    """The figures of every node, each by going through all rebuilt conversations again."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(b"" if c is None else str(c).encode()) % 6
        base = None if c is None else c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple((own.get(base, []) if c is not None else [])[:h] + own[c][h:])
    nodes = {x[:d] for x in built.values() for d in range(len(x) + 1)}
    members = {p: [c for c, x in built.items() if x[: len(p)] == p] for p in nodes}
    children = defaultdict(set)
    for p in nodes:
        if p:
            children[p[:-1]].add(p)
    least = lambda p: min((c for c in members[p] if c is not None), default=None)
    out = []
    for p in nodes:
        inside = [q for q in nodes if q[: len(p)] == p]
        ends = sorted((c for c in members[p] if len(built[c]) == len(p)), key=lambda c: (c is None, c or 0))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in inside if q)
        out.append((least(p), len(p), least(p[:-1]) if p else None, len(members[p]), len(children[p]), sum(not children[q] for q in inside), saved, hashlib.sha256(",".join("" if c is None else str(c) for c in ends).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, **kw):
    return sorted((tuple(r[x] for x in FIGURES) for r in tries.prefix_trie(df, **kw).collect()), key=repr)


def invented(seed=1, n=90):
    r = random.Random(seed)
    rows = []
    for c in [*range(0, n), *range(100, 100 + n, 3), *range(-150, -80, 7), None]:
        for turn in range(r.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            rows.append((c, r.choice([turn, turn, turn, None]), r.choice(["user", "assistant", None]), r.choice(["", "a", "bé", None, "longer text"])))
    return rows


@pytest.mark.parametrize("limit", [50_000, 40, 5, 1])
def test_against_brute_force(spark, limit):
    rows = invented()
    got = found(spark.createDataFrame(rows, SCHEMA), limit=limit)
    assert got == brute(rows) and len(got) > 100


def test_copies_and_a_long_shared_start(spark):
    shared = [("user", f"turn {k}") for k in range(40)]
    rows = [(100 * c, k, role, text) for c in range(30) for k, (role, text) in enumerate(shared)]  # copies
    rows += [(100 * c + 50_000, k, role, text) for c in range(30) for k, (role, text) in enumerate([*shared, ("user", f"own {c % 7}")])]
    for limit in (50_000, 100, 3):
        assert found(spark.createDataFrame(rows, SCHEMA), limit=limit) == brute(rows)


def test_hard_rows(spark):
    rows = [(7, None, None, None), (7, 1, "user", "x" * 200_000), (7, 1, "user", "x" * 200_000), (300, 0, "user", "hi"), (301, 0, "user", "hi"), (None, 2, "user", "hi"), (None, None, None, "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"c": F.lit(1), "node": F.lit("n"), "h": F.lit(2), "d": F.lit(3), "t": F.lit(0)})
    assert found(df) == found(df, limit=1) == brute(rows)
    assert found(df.limit(0)) == []
