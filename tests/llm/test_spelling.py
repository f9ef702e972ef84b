import random
import re
import zlib
from collections import Counter

from fixtures import documents, empty
from pyspark.sql import functions as F

from parcelforge.llm import spelling


def brute(rows, least=7, every=31, ratio=10):
    """``word, form, root, n, n_near, form_n`` by comparing all pairs of words letter by letter."""
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    close = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(close[w]), words.get(form[w], 0)) for w, n in words.items())


def found(df, **kw):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.variants(df, **kw).collect())


def invented(seed=5, n=400):
    r = random.Random(seed)
    base = ["".join(r.choice("abcé") for _ in range(r.randrange(6, 9))) for _ in range(12)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(40):
            w = base[min(int(r.expovariate(0.5)), 11)]
            for _ in range(r.choice([0, 0, 0, 0, 0, 0, 1, 2])):
                k, kind = r.randrange(len(w)), r.randrange(3)
                w = w[:k] + ("" if kind == 0 else r.choice("abcéÀ×") + (w[k] if kind == 1 else "")) + w[k + 1 :]
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice(["", "¿", "12 "]) + " -".join(words)))
    return rows


def test_against_all_pairs(spark):
    rows = invented()
    for least, every, ratio in ((7, 31, 10), (6, 3, 2), (5, 0, 4)):
        got = found(spark.createDataFrame(rows, "doc_id long, text string"), least=least, every=every, ratio=ratio)
        want = brute(rows, least, every, ratio)
        assert got == want and len(want) > 50
    assert any(f and r != f for _, f, r, *_ in want) and max(x[4] for x in want) > 20


def test_chain_of_forms_ties_and_doubled_letters(spark):
    words = ["aaaaaaa"] * 2000 + ["aaaaaaab"] * 200 + ["aaaaaaabb"] * 20 + ["aaaaaaabbb"] * 2 + ["zzzzzzzz"] * 2 + ["zzzzzzza"] * 30 + ["zzzzzzzÿ"] * 30 + ["short"] * 5 + ["onlyonce"]
    rows = [(k, w) for k, w in enumerate(words)] + [(None, None), (None, ""), (3, "9" * 100)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), every=0)
    assert got == brute(rows, every=0)
    assert [x[2] for x in got if x[0].startswith("a")] == ["aaaaaaa"] * 4 and next(x for x in got if x[0] == "zzzzzzzz")[1] == "zzzzzzza"


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = invented(6, 60)
    want = brute(rows)
    monkeypatch.setattr(spelling, "MOST_BITS", 1 << 8)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_hard_rows(spark):
    df = documents(spark).withColumns({"word": F.lit("w"), "near": F.lit("x"), "v": F.lit(1), "id": F.lit(2), "run": F.lit("y")})
    again = df.unionByName(df).unionByName(spark.createDataFrame([(90, "Vergleichung " * 30_000 + "vergleichung", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    assert found(again) == brute([(r.doc_id, r.text) for r in again.collect()]) != []
    assert found(empty(spark)) == []
