import random

from pyspark.sql import functions as F

from parcelforge.operators import docmap

LINE = "document string, page int, line int, text string, x0 double, y0 double, x1 double, y1 double"


def invented(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiou") + r.choice("bcdfghklmnprstvy") for _ in range(r.randrange(1, 5)))
    lines, told = [], []
    for k in range(6):
        doc, texts = f"d{k}", []
        for n in range(40):
            texts.append(r.choice([" ".join(word() for _ in range(r.randrange(1, 9))), r.choice(["", " ", "a", "ab c", "no 7"])]))
            lines.append((doc, n // 20, n % 20, texts[-1], 0.0, float(n), 1.0, n + 1.0))
        for n in range(25):
            base = list(r.choice(texts)[r.randrange(0, 6) :])
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                if base:
                    i = r.randrange(len(base))
                    base[i : i + 1] = r.choice([[], [r.choice("xyz")], [base[i], "q"]])
            told.append((doc, f"$.{n}", r.choice(["".join(base), "".join(base), "", None, "zz"])))
    return lines, told


def test_best_lines_against_all_pairs(spark):
    lines, told = invented()
    want = {}
    for d, path, raw in told:
        scores = [(-docmap.partial_ratio(raw, x[3]), x[1], x[2], x[5]) for x in lines if x[0] == d and x[3].strip()] if (raw or "").strip() else []
        best = min(scores, default=None)
        want[d, path] = (best[3], round(-best[0], 4)) if best and -best[0] >= docmap.LINE_MATCH else None
    df, ln = spark.createDataFrame(told, "document string, path string, raw_text string"), spark.createDataFrame(lines, LINE)
    got = {(r.document, r.path): (r.box.y0, r.score) if r.box else None for r in docmap.attach_boxes(df, ln).collect()}
    assert got == want and sum(v is not None for v in want.values()) >= 25


def test_the_bound_holds_for_every_pair(spark):
    lines, told = invented(2)
    pairs = {(a, b[3]) for d, _, a in told for b in lines if d == b[0] and (a or "").strip() and b[3].strip()}
    for a, b in pairs:
        n = min(len(a), len(b))
        grams = lambda t: [t[i : i + 2] for i in range(len(t) - 1)]
        s = sum(min(grams(a).count(g), grams(b).count(g)) for g in set(grams(a)))
        assert n in (1, 4) or docmap.partial_ratio(a, b) < docmap.LINE_MATCH or min(1.0, (s + 2 * n + 1) // 3 / n) * 100 >= docmap.partial_ratio(a, b) - 1e-4, (a, b)


def test_few_pairs_are_measured(spark, monkeypatch):
    """Texts that stand in a line of their document, as extraction gives them: below a twentieth of all pairs."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9)))
    lines = [("d", 0, n, " ".join(word() for _ in range(8)), 0.0, float(n), 1.0, n + 1.0) for n in range(300)]
    told = [("d", str(n), lines[7 * n % 300][3][3:28]) for n in range(100)]
    df, ln = spark.createDataFrame(told, "document string, path string, raw_text string"), spark.createDataFrame(lines, LINE)
    count = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(a, b):
        count.add(len(a))
        return docmap.partial_ratio_udf.func(a, b)

    monkeypatch.setattr(docmap, "partial_ratio_udf", counted)
    assert all(r.box for r in docmap.attach_boxes(df, ln).collect())
    assert 100 <= count.value < 0.05 * 100 * 300


def test_pairs_in_rounds_equal_the_sequential_loop(spark):
    r = random.Random(5)
    rows = []
    for page in range(30):
        for seq in range(r.choice([0, 1, 40, 60])):
            x, y, w, h = r.randrange(0, 20) / 50, r.randrange(0, 20) / 50, r.choice([0.04, 0.1, 0.16]), r.choice([0.04, 0.1])
            rows.append((f"p{page}", r.choice(["a", "A ", "b"]), x, y, x + w, y + h, r.randrange(1, 100) / 100, r.choice(["e1", "e1", "e2", "e3"]), seq))
    schema = docmap.TOKEN + ", seq int"

    def overlap(t, o):
        w, h = max(0.0, min(t[4], o[4]) - max(t[2], o[2])), max(0.0, min(t[5], o[5]) - max(t[3], o[3]))
        return w * h / ((t[4] - t[2]) * (t[5] - t[3]) + (o[4] - o[2]) * (o[5] - o[3]) - w * h)

    want = []
    for page in {x[0] for x in rows}:
        groups = {}
        for t in (x for x in rows if x[0] == page):
            groups.setdefault(t[7], []).append(t)
        base, *others = sorted(groups.values(), key=len, reverse=True)
        others, used = [t for g in others for t in g], set()
        for t in base:
            best, at = docmap.IOU, None
            for k, o in enumerate(others):
                if k not in used and overlap(t, o) > best:
                    best, at = overlap(t, o), k
            if at is None:
                want.append(t)
                continue
            used.add(at)
            o = others[at]
            lead = t if t[6] >= o[6] else o
            same = t[1].strip().lower() == o[1].strip().lower()
            want.append((page, lead[1], min(t[2], o[2]), min(t[3], o[3]), max(t[4], o[4]), max(t[5], o[5]), round(min(1.0, lead[6] * (1.1 if same else 0.85)), 4), "ensemble", lead[8]))
        want += [o for k, o in enumerate(others) if k not in used]
    got = docmap.reconcile(spark.createDataFrame(rows, schema).repartition(4)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(x[7] == "ensemble" for x in want) > 50
    assert docmap.reconcile(spark.createDataFrame([], schema)).count() == 0


def test_literal_reads_of_two_engines(spark):
    from parcelforge.plans.mapping import tokens

    rows = docmap.reconcile(docmap.kept_tokens(tokens(spark))).select("text", "engine", "confidence").collect()
    assert sorted(map(tuple, rows)) == sorted([("Survey", "ensemble", 0.99), ("No", "easy", 0.8), ("12S", "ensemble", 0.6375), ("Ramesh", "easy", 0.6), ("extra", "tess", 0.9)])
