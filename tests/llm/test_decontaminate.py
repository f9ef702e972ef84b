import re

import fixtures
import pytest

from parcelforge.llm import decontaminate

A_TO_Z = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))


def brute_force(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit[k : k + n] = [True] * n
        out.append((i, len(w), sum(hit), sorted(found, key=lambda x: (x is None, x))))
    return sorted(out, key=repr)


def items(spark, docs):
    base = docs.filter("doc_id = 10").first().text.split()
    rows = [(1, " ".join(base[5:30]).upper()), (2, "W1,w2"), (3, None), (4, " .. "), (5, " ".join(base[60:69])), (6, " ".join(base[61:70])), (7, "x " * 12), (7, "One"), (8, "nowhere to be found at all in any text of this table"), (None, " ".join(base[70:90])), (None, " ".join(base[62:75]))]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_against_brute_force(spark, limit):
    docs = fixtures.documents(spark)
    bench = items(spark, docs)
    out = decontaminate.mark(docs, bench, keep=["doc_id", "size", "row", "hash"], broadcast_limit=limit).collect()
    want = brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.collect()])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in out), key=repr) == want
    assert any(None in x[3] for x in want)
    assert any(x[2] for x in want) and all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in out)


@pytest.mark.parametrize("limit", [1_000_000, -1])
def test_empty_tables(spark, limit):
    docs, none = fixtures.documents(spark), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.mark(docs, none, broadcast_limit=limit).filter("n_hit > 0").count() == 0
    assert decontaminate.mark(fixtures.empty(spark), items(spark, docs), broadcast_limit=limit).count() == 0
