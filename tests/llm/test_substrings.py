import re

import fixtures
import pytest

from parcelforge.llm import substrings

LAST = 1 << 70


def by_row(rows):
    rows = [(LAST if i is None else i, t) for i, t in rows]  # null ids come last
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        out.append((None if i == LAST else i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def brute_force(rows):
    return sorted(by_row(rows), key=repr)


@pytest.mark.parametrize("hot", [256, 1, 5])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT_LEAST", hot)
    docs = fixtures.documents(spark)
    out = substrings.dedup(docs, keep=["doc_id"]).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out), key=repr)
    assert got == brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in out)


def test_other_columns_pass_and_empty_tables(spark):
    assert substrings.dedup(fixtures.empty(spark)).count() == 0
    docs = fixtures.documents(spark)
    out = substrings.dedup(docs, keep=["doc_id", "row", "hash", "doc", "bucket"])
    assert out.columns == ["doc_id", "row", "hash", "doc", "bucket", "n_words", "n_removed", "removed", "kept"] and out.count() == docs.count()


def test_small_blocks_of_a_task_lose_nothing(spark, monkeypatch):
    """Windows are sent in blocks of a few, texts cut three at a time."""
    monkeypatch.setattr(substrings, "SEND", 40)
    monkeypatch.setattr(substrings, "ROWS", 3)
    docs = fixtures.documents(spark).coalesce(1)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.dedup(docs).collect()), key=repr)
    assert got == brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
