import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import components as components_module
from gridloom.llm import neardup
from gridloom.llm.components import components
from gridloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"


def brute(rows, percent=85):
    """n_shingles, component_id, kept by id, from all pairs of distinct sets."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    by_set = {}
    for i, s in sets.items():
        by_set.setdefault(s, []).append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def link(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    distinct = [(s, min(v)) for s, v in by_set.items() if s]
    for s, v in by_set.items():
        for x in v if s else ():
            link(v[0], x)
    distinct.sort(key=lambda x: len(x[0]))
    for k, (s, a) in enumerate(distinct):
        for t, b in distinct[k + 1 :]:
            if 100 * len(s) < percent * len(t):
                break
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                link(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def edited(words, n, rnd):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"new{rnd.randrange(10**9)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def hard_rows():
    """Groups around bases that are in or not in the table, with few to many edits, so that many pairs lie near the threshold;
    an inserted common passage; copies."""
    rnd = random.Random(5)
    rows = []
    passage = " ".join(f"p{k}" for k in range(14))
    for g in range(6):
        base = [f"w{rnd.randrange(400)}" for _ in range(150)]
        for k in range(60):
            text = edited(base, rnd.randrange(0 if g % 2 else 2, 12), rnd)
            if rnd.random() < 0.3:
                text = passage + " " + text
            rows += [text] * rnd.choice([1, 1, 1, 3])
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("percent", [80, 85])
def test_against_all_pairs(spark, hard_rows, percent):
    want = brute(hard_rows, percent)
    assert result(neardup.near_duplicates(spark.createDataFrame(hard_rows, SCHEMA), percent=percent)) == want
    assert 20 < sum(v[2] for v in want.values()) < len(hard_rows) - 100


def test_query_on_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert result(QUERIES["op1_neardup"](spark, sf_dir)) == brute(rows)


def test_open_pairs_are_found(spark):
    """Two members that are no links of the hub but of each other are joined through what they differ in from the hub."""
    rnd = random.Random(1)
    base = [f"w{k}" for k in range(200)]
    far = edited(base, 14, rnd).split()
    rows = [(0, " ".join(base)), (1, edited(base, 1, rnd)), (2, " ".join(far)), (3, edited(far, 1, rnd))]
    texts = spark.createDataFrame(rows, "node long, text string")
    members = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 2, 0), (3, 0, 3, 0)], "node long, hub long, class long, home long")
    assert [tuple(r) for r in neardup._pairs(neardup._open_groups(members, texts, 85, 5, 16)[0], 85).collect()] == [(2, 3)]


def templated(n, own, rnd, twins=False, light=0):
    """n pages of one template of 415 words with words of their own; twins: two of each; light: so many with only 5 own words."""
    shared = [f"t{k}" for k in range(415)]
    pages = []
    for k in range(n):
        mine = [f"o{rnd.randrange(10**9)}" for _ in range(5 if k < light else own)]
        at = rnd.randrange(100, 300)
        pages += [" ".join(shared[:at] + mine + shared[at:])]
        if twins:
            pages.append(pages[-1] + " end")
    return list(enumerate(pages))


def formed(spark, monkeypatch, rows, percent=85):
    """Classes, and how many rows the groups had and pairs were compared in all rounds."""
    counts = {"groups": 0, "pairs": 0}
    groups, likely = neardup._open_groups, neardup._unlikely_dropped

    def counted_groups(*a):
        out = groups(*a)
        counts["groups"] += sum(x.count() for x in out)
        return out

    def counted_pairs(pairs, *a):
        counts["pairs"] += pairs.count()
        return likely(pairs, *a)

    monkeypatch.setattr(neardup, "_open_groups", counted_groups)
    monkeypatch.setattr(neardup, "_unlikely_dropped", counted_pairs)
    return result(neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), percent=percent)), counts


@pytest.mark.parametrize("n", [200, 800, 3200])
def test_templated_pages_grow_linearly(spark, monkeypatch, n):
    """Pages just below the threshold: no pair is linked, and no step makes more rows than a multiple of the pages."""
    rows = templated(n, 46, random.Random(n))
    got, counts = formed(spark, monkeypatch, rows)
    assert all(v[1] == i and v[2] for i, v in got.items())
    assert counts["groups"] <= 2 * n and counts["pairs"] <= 4 * n


@pytest.mark.parametrize("kind", [{"twins": True}, {"light": 40}, {"twins": True, "light": 60}])
def test_templated_pages_with_links(spark, monkeypatch, kind):
    rows = templated(300, 46, random.Random(3), **kind)
    got, counts = formed(spark, monkeypatch, rows)
    assert got == brute(rows)
    assert counts["pairs"] <= 2 * neardup.PAIRS * len(rows)


def test_large_groups_get_hubs_of_their_own(spark, monkeypatch, hard_rows):
    """The same classes if groups form next to no pairs at first."""
    monkeypatch.setattr(neardup, "PAIRS", 0.05)
    assert result(neardup.near_duplicates(spark.createDataFrame(hard_rows, SCHEMA), percent=85)) == brute(hard_rows, 85)


def test_few_tables_for_a_group_below_the_threshold(spark, monkeypatch):
    """Near copies of one text, many just below the threshold: a hub that one task can hold takes no further rounds of joins, so the
    number of tables written stays small (15; 30 in rounds before)."""
    rnd, written, cut = random.Random(4), [], neardup.cut
    base = [f"w{k}" for k in range(150)]
    rows = list(enumerate(edited(base, rnd.randrange(3, 12), rnd) for _ in range(700)))
    for module in (neardup, components_module):
        monkeypatch.setattr(module, "cut", lambda df: written.append(df) or cut(df))
    assert result(neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), percent=85)) == brute(rows)
    assert len(written) <= 20


@pytest.mark.parametrize(("members", "hashes", "pairs"), [(0, 10**9, 16), (0, 10**9, 0.05), (40, 10**9, 0.05), (10**9, 2000, 0.05)])
def test_hubs_too_large_for_one_task(spark, monkeypatch, hard_rows, members, hashes, pairs):
    """The same classes if all hubs or some of them are settled by joins."""
    for name, value in (("LOCAL_MEMBERS", members), ("LOCAL_HASHES", hashes), ("PAIRS", pairs)):
        monkeypatch.setattr(neardup, name, value)
    assert result(neardup.near_duplicates(spark.createDataFrame(hard_rows, SCHEMA), percent=85)) == brute(hard_rows, 85)


@pytest.mark.parametrize("n", [800, 3200])
def test_templated_pages_by_joins(spark, monkeypatch, n):
    monkeypatch.setattr(neardup, "LOCAL_MEMBERS", 0)
    test_templated_pages_grow_linearly(spark, monkeypatch, n)


def test_templated_pages_with_links_by_joins(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LOCAL_MEMBERS", 0)
    test_templated_pages_with_links(spark, monkeypatch, {"twins": True, "light": 60})


@pytest.mark.parametrize("listed", [0, 2, 32])
def test_links_within_one_task(monkeypatch, listed):
    """Links join the classes that all pairs would, and no more of them than it takes."""
    monkeypatch.setattr(neardup, "LISTED", listed)
    rnd = random.Random(listed)
    for percent in (80, 85) * 20:
        sets, base = [], frozenset(range(100))
        for _ in range(rnd.randrange(1, 50)):
            s = set(rnd.choice(sets) if sets and rnd.random() < 0.6 else base)
            for _ in range(rnd.randrange(14)):
                s.discard(rnd.randrange(100))
                s.add(rnd.randrange(1000, 1000 + rnd.choice([30, 10**5])))
            sets.append(s)
        classes = [rnd.randrange(len(sets)) for _ in sets]

        def joined(pairs, classes=classes):
            at = {c: c for c in classes}
            for a, b in pairs:
                old, new = at[classes[a]], at[classes[b]]
                at = {c: new if x == old else x for c, x in at.items()}
            return {frozenset(c for c in at if at[c] == x) for x in at.values()}

        every = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        differ = [np.array(sorted(s ^ base), dtype=np.int64) for s in sets]
        links = neardup.local_links(np.arange(len(sets)), np.array(classes), np.array([len(s) for s in sets]), differ, percent)
        assert joined(links) == joined(every) and len(joined(links)) == len(set(classes)) - len(links)


def test_edge_cases(spark):
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", None), (4, "One two", "x"), (5, "one  TWO", "x"), (6, long, "x"), (7, long + " end", "x"), (8, "one two", None), (None, "one two", "x"), (9, "é É", "x"), (10, "É é", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").withColumn("key", F.lit(1)).withColumn("hub", F.lit("a"))
    got = result(neardup.near_duplicates(df))
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[4] == (1, 4, True) and got[5] == (1, 4, False) and got[8] == (1, 4, False)
    assert got[7][1] == 6 and not got[7][2]
    assert got[None] == (1, None, True)
    assert got[9][1] == 9 and got[10][1] == 10  # only A to Z are lower-cased
    repeated = neardup.near_duplicates(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "x y z")], SCHEMA))
    assert sorted((r.doc_id, r.component_id, r.kept) for r in repeated.collect()) == [(1, 1, True), (1, 1, True), (2, 2, True)]
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    tied = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (1, "c d", "z")], "doc_id long, text string, c0 string").withColumn("id", F.lit(1)).withColumn("row", F.create_map(F.lit(1), F.lit(2)))
    one = [neardup.keep_representatives(x).collect() for x in (tied, tied.orderBy(F.desc("c0")).coalesce(1))]
    assert one[0] == one[1] and len(one[0]) == 1
    kept = neardup.keep_representatives(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 9, 10]


def test_bands():
    assert neardup.n_bands(80) == 35 and neardup.n_bands(85) == 24


def test_least_matches():
    least = neardup.least_matches(85)
    assert least == sorted(least) and least[0] < 0.85 * neardup.BATCH and least[-1] < 0.85 * neardup.CHECKS
    # a looser miss probability prunes sooner
    assert all(a >= b for a, b in zip(neardup.least_matches(85, miss=0.01), least, strict=True))


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)] + [(5, 5), (None, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
