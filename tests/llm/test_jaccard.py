import random
import re
from collections import Counter, defaultdict

import fixtures
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelforge.llm import graphs, jaccard

A_TO_Z = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_TO_Z))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def linked(rows, n=4, percent=85):
    """Set size and reachable rows of every row."""
    sets, near = [shingles(t, n) for _, t in rows], defaultdict(set)
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)
    for k, s in enumerate(sets):
        for j, m in Counter(j for g in s for j in where[g]).items():
            if 100 * m >= percent * (len(s) + len(sets[j]) - m):
                near[k].add(j)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((len(sets[k]), seen))
    return out


def brute_force(rows, n=4, percent=85):
    """(id, set size, least reachable id) of every row."""
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return sorted(((i, size, least(rows[j][0] for j in seen)) for (i, _), (size, seen) in zip(rows, linked(rows, n, percent), strict=True)), key=repr)


@pytest.mark.parametrize(("small", "leaf", "chunk"), [(32, 32, 4096), (2, 2, 4096), (3, 2, 5)])
def test_against_brute_force(spark, monkeypatch, small, leaf, chunk):
    for name, value in (("SMALL", small), ("LARGE", small), ("LEAF", leaf), ("CHUNK", chunk)):
        monkeypatch.setattr(jaccard, name, value)
    docs = fixtures.documents(spark)
    got = sorted(map(tuple, jaccard.groups(docs).collect()), key=repr)
    assert got == brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_empty_and_null_ids(spark):
    assert jaccard.groups(fixtures.empty(spark)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (None, "z")], "doc_id long, text string")
    assert sorted(map(str, jaccard.groups(docs).collect())) == sorted(map(str, [r for r in spark.createDataFrame([(None, 2, 3), (3, 2, 3), (None, 1, None)], "doc_id long, n_shingles long, component_id long").collect()]))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(1, 60)]
    star = [(100, i) for i in range(101, 140)]
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(chain + star + [(200, 200)], "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 140)}


def test_few_links_take_few_jobs(spark):
    """A long chain once took a round of stars for each doubling, about ten shuffles a round."""
    links = spark.createDataFrame([(i, i + 1) for i in range(3000)], "a long, b long").repartition(5)
    spark.sparkContext.setJobGroup("components", "")
    got = graphs.components(links)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(3001)}
    assert jobs <= 8


def test_many_links_go_by_stars(spark, monkeypatch):
    monkeypatch.setattr(graphs, "EDGES", 4)
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(a := rng.randrange(200, 300), a + 100 * rng.randrange(1, 4)) for _ in range(60)]
    top = {x: x for e in links for x in e}
    for _ in top:
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    got = graphs.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()
    assert len(got) == len(top) and {r.node: r.root for r in got} == top


def test_link_across_parts_only(spark, monkeypatch):
    """The only link lies across the parts of its token groups in rounds 0 and 1, and nothing else is proposed."""
    monkeypatch.setattr(jaccard, "CHUNK", 1)
    texts = [f"{' '.join(f't{s}x{i}' for i in range(16))} {end}{s}" for s in range(32) for end in "ab"]
    node = [int(x) for p in jaccard.pieces(pa.array(texts), jaccard.BLANKS, jaccard.LOWER) for x in jaccard._nodes(*jaccard.piece_sets(p, 4))]
    parts = spark.createDataFrame(list(enumerate(node)), "i int, node long").select("i", *(F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)).alias(f"r{r}") for r in (0, 1)))
    part = {r.i: (r.r0, r.r1) for r in parts.collect()}
    k = next(k for k in range(0, len(texts), 2) if all(x != y for x, y in zip(part[k], part[k + 1], strict=True)))
    rows = [(1, texts[k]), (2, texts[k + 1]), (3, "quite another text of eight words or so")]
    got = sorted(map(tuple, jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_force(rows) == [(1, 14, 1), (2, 14, 1), (3, 5, 3)]


def test_no_link_is_lost_in_salted_groups(spark, monkeypatch):
    """Forty pairs that differ in the last of 200 words, every token group dealt out node by node."""
    monkeypatch.setattr(jaccard, "CHUNK", 1)
    rows = [(2 * s + k, " ".join(f"t{s}x{i}" for i in range(199)) + f" {end}{s}") for s in range(40) for k, end in enumerate("ab")]
    got = sorted(map(tuple, jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute_force(rows) == sorted(((i, 197, i - i % 2) for i, _ in rows), key=repr)


def test_family_just_below_the_limit(spark, monkeypatch):
    """Ninety texts of one template, most pairs a little too different, some linked: groups over LARGE are verified where they meet."""
    monkeypatch.setattr(jaccard, "SMALL", 8)
    monkeypatch.setattr(jaccard, "LARGE", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        own = list(base)
        for k in rng.sample(range(120), 1 + i % 3):
            own[k] = f"v{rng.randrange(20)}"
        rows.append((i, " ".join(own)))
    got = sorted(map(tuple, jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    want = brute_force(rows)
    assert got == want and 1 < len({c for _, _, c in want}) < 90


def test_sets_of_all_tiers(spark, monkeypatch):
    """Near copies whose sets lie on both sides of each border between bitmap lengths."""
    monkeypatch.setattr(jaccard, "TIERS", ((8, 20), (16, 60), (32, 1 << 62)))
    rows = []
    for n in (10, 18, 21, 23, 40, 58, 61, 66, 200):
        for k in range(4):
            rows.append((len(rows), " ".join(f"n{n}x{i}" for i in range(n - k)) + (f" end{k}" if k % 2 else "")))
    got = sorted(map(tuple, jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute_force(rows)


def test_cells_stay_small_where_the_sketch_says_nothing(spark, monkeypatch):
    """With a limit above all counters, as on very large inputs, groups are split by their exact counts."""
    monkeypatch.setattr(jaccard, "CHUNK", 3)
    monkeypatch.setattr(jaccard, "_limit", lambda counters: 1 << 30)
    seen = []
    plain = jaccard._token_groups

    def watched(*args):
        seen.append(plain(*args))
        return seen[-1]

    monkeypatch.setattr(jaccard, "_token_groups", watched)
    rng = random.Random(7)
    rows = []
    for i in range(60):
        own = [f"w{k}" for k in range(60)]
        own[rng.randrange(60)] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(own) + (" tail" * (i % 4))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.groups(docs).collect()), key=repr) == brute_force(rows)
    sizes = seen[0].groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("parts").alias("least"), F.max("parts").alias("most")).collect()
    assert max(r.n for r in sizes) > 9 and all(r.least == r.most == -(-r.n // 3) for r in sizes)
