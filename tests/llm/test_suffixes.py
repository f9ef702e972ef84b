import random

import numpy as np
import pytest
from fixtures import documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelforge.llm import suffixes


def brute(rows, length=100):
    """``id, n_bytes, n_removed, spans, kept`` of every row, from a dictionary of all strings of that length."""
    key = lambda i: (i is None, i or 0)
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            first[s] = min(first.get(s, ((True, 1), 0)), (key(i), k)) if s in first else (key(i), k)
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if (key(i), k) > first[t[k : k + length]]:
                gone[k : k + length] = [True] * length
        spans, k = [], 0
        while k < len(t):
            e = k
            while e < len(t) and gone[e]:
                e += 1
            if e > k:
                spans.append((k, e))
            k = max(e, k + 1)
        out.append((-1 if i is None else i, len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return sorted(out)


def found(df, **kw):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.removed], bytes(r.kept)) for r in suffixes.dedup(df, **kw).collect())


def invented(seed=1, n=60):
    r = random.Random(seed)
    words = [f"wörd{i}" for i in range(50)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    passages = [text(k) for k in (16, 25, 40)]
    rows = []
    for i in range(n):
        parts = [text(r.randrange(0, 25))]
        for _ in range(r.randrange(0, 4)):
            p = r.choice(passages)
            cut = r.randrange(0, len(p) // 2)
            parts += [p[cut:] if r.random() < 0.5 else p, text(r.randrange(0, 12))]
        rows.append((i, r.choice(["", " "]).join(parts)))
    rows += [(n + 1, "x" * 400), (n + 2, "ab" * 300), (n + 3, "b" + "ab" * 120), (n + 4, "a" * 99 + "b" + "a" * 250), (n + 5, rows[3][1]), (n + 6, rows[3][1]), (n + 7, "\x00" * 130 + "é" * 90), (n + 8, "\x00" * 230)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [1024, 3, 1])
def test_against_all_strings(spark, hot):
    rows = invented()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = found(df, hot=hot)
    assert got == brute(rows) and sum(x[2] > 0 for x in got) > 30


def test_short_strings_and_small_parts(spark, monkeypatch):
    rows = invented(2, 30)
    for length in (40, 7):
        assert found(spark.createDataFrame(rows, "doc_id long, text string"), length=length) == brute(rows, length)
    want = brute(rows)
    monkeypatch.setattr(suffixes, "PART", 150)
    monkeypatch.setattr(suffixes, "FLUSH", 2000)
    monkeypatch.setattr(suffixes, "BUCKET", 4000)
    monkeypatch.setattr(suffixes, "MOST_BITS", 1 << 8)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), hot=5) == want


def test_hard_rows(spark):
    df = documents(spark).withColumns({"key": F.lit("k"), "kind": F.lit(1), "lo": F.lit(2), "text_": F.lit("t"), "start": F.lit(0), "bytes": F.lit("b")})
    rows = [(r.doc_id, r.text) for r in df.collect()]
    for hot in (1024, 4):
        assert found(df, hot=hot) == brute(rows)
    assert found(empty(spark)) == []
    assert suffixes.dedup(df, keep=("lo", "doc_id", "bytes")).columns == ["lo", "doc_id", "bytes", "n_bytes", "n_removed", "removed", "kept"]


def test_equal_ids_and_rows(spark):
    long = "".join(random.Random(4).choice("abcdef ") for _ in range(300))
    rows = [(1, long), (1, long), (1, "q" + long), (None, long), (None, long[50:]), (0, long[100:230]), (None, None)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=120), st.integers(1, 12), st.randoms())
def test_two_stage_order(letters, depth, r):
    t = np.array([*letters, 0], np.uint8)
    wanted = np.array([r.random() < 0.7 and i + depth <= len(letters) for i in range(len(t))], bool)
    order = suffixes.suffix_order(t, wanted, depth)
    text = t.tobytes()
    assert sorted(order) == list(np.flatnonzero(wanted))
    heads = [text[i : i + depth] for i in order]
    assert heads == sorted(heads)
    prefix = suffixes.common_prefixes(t, order, depth)
    for k in range(1, len(order)):
        a, b = heads[k - 1], heads[k]
        assert prefix[k] == next((i for i in range(depth) if a[i] != b[i]), depth)
