import random

import numpy as np
import pytest

from lumenframe.llm import jaccard_join as J
from lumenframe.llm.components import components
from util import LOWER, SF, WORD, empty_documents, odd_documents


def sets_of(rows, n):
    out = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute(rows, n, percent):
    sets, parent = sets_of(rows, n), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    rank = lambda d: (d is not None, d or 0)
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d, key=rank)
    return sorted(((d, len(sets[i]), least[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(seed=1, families=12, most=40):
    rng = random.Random(seed)
    rows, d = [], 0
    for f in range(families):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([2, 12, 80, 200]))]
        for _ in range(rng.randint(1, most)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 9)}"
            rows.append((d, " ".join(words)))
            d += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_components_match_brute_force(spark, n, percent):
    docs = spark.createDataFrame(near_copies(), "doc_id long, text string").repartition(3)
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(map(tuple, J.link_documents(docs, n, percent).collect()), key=str) == brute(rows, n, percent)


def test_test_table_and_odd_rows(spark):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_documents(spark), empty_documents(spark)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(map(tuple, J.link_documents(docs, 3, 90).collect()), key=str) == brute(rows, 3, 90)


def test_region_join_matches_brute_force_on_large_regions():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = []
    for k in range(900):
        s = base[: 200 + 100 * (k % 2)].copy()
        change = rng.integers(0, 60)
        s[rng.integers(0, len(s), change)] = rng.integers(0, 2**63, change).astype(np.uint64)
        sets.append(np.unique(s))
    r = J.Region(sets, 90)
    r.join(np.arange(len(sets)))
    t = J.Region(sets, 90)
    for i in range(len(sets)):
        shared = t.overlaps(np.arange(i + 1), i)
        for j in np.flatnonzero(t.linked(shared, t.size[: i + 1], t.size[i])):
            t.link(i, int(j))
    assert [r.root(i) for i in range(len(sets))] == [t.root(i) for i in range(len(sets))]


@pytest.mark.parametrize("large", [12])
def test_regions_cut_over_tasks_match_brute_force(spark, large):
    docs = spark.createDataFrame(near_copies(5, 6, 120), "doc_id long, text string").repartition(3)
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(map(tuple, J.link_documents(docs, 3, 90, large=large).collect()), key=str) == brute(rows, 3, 90)


@pytest.mark.parametrize("change", [2, 30])
def test_levels_of_one_large_region(spark, change, monkeypatch):
    """One region of several families: near ones (settled by a pivot), spread ones (blocks), all of them cut by pivots first."""
    rng = np.random.default_rng(change)
    sets = []
    for family in range(6):
        base = rng.integers(0, 2**63, 150).astype(np.uint64)
        for _ in range(20 + 20 * family):
            s = base.copy()
            s[rng.integers(0, len(s), rng.integers(0, change))] = rng.integers(0, 2**63, 1).astype(np.uint64)
            at = rng.integers(0, len(s), change // 2)
            s[at] = rng.integers(0, 2**63, len(at)).astype(np.uint64)
            sets.append(np.unique(s))
    sets = [np.frombuffer(x, np.uint64) for x in sorted({s.tobytes() for s in sets})]
    rows = [(b"p", i.to_bytes(16, "big"), s.tobytes(), len(sets)) for i, s in enumerate(sets)]
    sent = spark.createDataFrame(rows + rows[:50], "pivot binary, sig binary, shingles binary, n long").repartition(4)
    levels, fits = [], []
    cut = J._cut

    def spy(big, level, *more):
        out = cut(big, level, *more)
        levels.append(level)
        fits.append(out[1].groupBy("pivot").count().agg({"count": "max"}).first()[0] or 0)
        return out

    monkeypatch.setattr(J, "_cut", spy)
    edges = J._join_regions(sent, 90, 40).collect()
    assert levels and max(fits) <= 80
    want, got = J.Region(sets, 90), J.Region(sets, 90)
    for i in range(len(sets)):
        shared = want.overlaps(np.arange(i + 1), i)
        for j in np.flatnonzero(want.linked(shared, want.size[: i + 1], want.size[i])):
            want.link(i, int(j))
    for u, v in edges:
        got.link(int.from_bytes(u, "big"), int.from_bytes(v, "big"))
    assert [got.root(i) for i in range(len(sets))] == [want.root(i) for i in range(len(sets))]


def test_one_document_of_each_group_stays(spark):
    docs = spark.createDataFrame(near_copies(4), "doc_id long, text string")
    linked = J.link_documents(docs).collect()
    kept = {r.doc_id for r in J.one_per_group(docs).collect()}
    assert kept == {r.component_id for r in linked}


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (300, 299), (299, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(51)}, 100: 100, **{200 + i: 100 for i in range(30)}, 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
