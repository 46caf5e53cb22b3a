"""The vector join, density clusters and the stored index against brute force."""

import numpy as np
import pytest

from lumenframe.operators import cluster as CL
from lumenframe.operators import metric as MT
from lumenframe.operators import vector_index as VI

NAN = float("nan")


def crowds(rng, n, dim=8, centres=12, noise=0.05):
    """Rows around a few directions, with copies, a large group of copies, vectors without length, and rows that take no part."""
    c = rng.normal(size=(centres, dim))
    x = [(i, (c[i % centres] + noise * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]
    x += [(11000 + i, x[3][1]) for i in range(30)] + [(12000 + i, [0.0] * dim) for i in range(3)] + [(13000, x[5][1]), (13001, x[5][1])]
    return x, [(14000, None), (14001, [NAN] * dim), (14002, [None] * dim), (14003, [1.0] * (dim - 1)), (None, x[0][1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "id long, embedding array<float>, region string")


def close_pairs(rows, most):
    ids, v = [i for i, _ in rows], np.array([x for _, x in rows], np.float32).astype(float)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    u = v / np.where(norm == 0, 1, norm)
    d = 1 - u @ u.T
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])): d[i, j] for i, j in zip(*np.nonzero(d <= most + 1e-12), strict=True) if i < j}


@pytest.mark.parametrize(("most", "block_bytes"), [(0.02, 1000), (0.3, 4 << 20), (1.0, 1000)])
def test_join_equals_brute_force(spark, monkeypatch, most, block_bytes):
    monkeypatch.setattr(MT, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(MT, "TILE", 16)
    rows, out = crowds(np.random.default_rng(0), 150)
    report = {}
    got = {(r.a, r.b): r.distance for r in MT.neighbours(frame(spark, rows + out), "id", "embedding", most, report).collect()}
    want = close_pairs(rows, most)
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert report["rows"] == 150 + (most >= 1)  # each different vector once; one without length only where it can be near


def test_windows_rule_out_most_pairs(spark, monkeypatch):
    """A narrow threshold over rows around forty directions: few blocks meet and few pairs are compared."""
    monkeypatch.setattr(MT, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(MT, "TILE", 32)
    rng = np.random.default_rng(3)
    rows, _ = crowds(rng, 4000, dim=16, centres=40)
    report = {}
    links = MT.class_links(MT.vector_classes(frame(spark, rows), "id", "embedding")[1], 0.02, report).count()
    different = list({tuple(v): (i, v) for i, v in reversed(rows) if any(v)}.values())
    assert links == report["found"] == len(close_pairs(different, 0.02))
    assert report["compared"] < 0.35 * report["all_pairs"] and report["block_pairs"] < report["blocks"] ** 2 / 3


def test_counts_do_not_pair_copies(spark):
    rows, out = crowds(np.random.default_rng(1), 90)
    got = {r.k: (r["class"], r.links) for r in MT.neighbour_counts(frame(spark, rows + out[:1] + out[4:]), "id", "embedding", 0.1).collect()}
    near = close_pairs(rows, 0.1)
    links = {i: 0 for i, _ in rows}
    for a, b in near:
        links[a] += 1
        links[b] += 1
    first = {}
    for i, v in sorted(rows):
        first.setdefault(tuple(v), i)
    assert got == {i: (first[tuple(v)], links[i]) for i, v in rows}


def test_clusters_with_copies_and_zeros(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [0.9, 0.1])]
    got = {r.id: (r.cluster, r.core) for r in CL.dbscan(frame(spark, rows), "id", eps=0.05, min_samples=3).collect()}
    assert got == {1: (0, True), 2: (0, True), 7: (0, True), 3: (-1, False), 4: (-1, False), 5: (-1, False), 6: (-1, False)}
    one = {r.id: r.cluster for r in CL.dbscan(frame(spark, rows), "id", eps=0.05, min_samples=1).collect()}
    assert one == {1: 0, 2: 0, 7: 0, 3: 1, 4: 2, 5: 3, 6: -1}
    assert CL.dbscan(frame(spark, []), "id").isEmpty()


def test_clusters_across_blocks_equal_brute_force(spark, monkeypatch):
    """Many small blocks, chains between crowds, border rows that touch several clusters, copies."""
    monkeypatch.setattr(MT, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(MT, "TILE", 8)
    rng = np.random.default_rng(7)
    rows, _ = crowds(rng, 240, dim=3, centres=9, noise=0.12)
    eps, least = 0.01, 5
    near = {i: {i} for i, _ in rows}
    for a, b in close_pairs(rows, eps):
        near[a].add(b)
        near[b].add(a)
    core = {i for i in near if len(near[i]) >= least}
    component = {}
    for i in sorted(core):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in component:
                component[j] = i
                todo += [k for k in near[j] if k in core]
    for i in sorted(set(near) - core):
        touched = [component[j] for j in near[i] if j in core]
        if touched:
            component[i] = min(touched)
    size = {c: sum(x == c for x in component.values()) for c in set(component.values())}
    order = sorted(size, key=lambda c: (-size[c], min(i for i, x in component.items() if x == c)))
    want = {i: (order.index(component[i]) if i in component else -1, i in core) for i in near}
    report = {}
    got = {r.id: (r.cluster, r.core) for r in CL.dbscan(frame(spark, rows), "id", eps=eps, min_samples=least, report=report).collect()}
    assert got == want and report["blocks"] > 5 and len(size) > 3
    assert any(not c and k >= 0 for k, c in want.values())


def nearest(rows, queries, k):
    ids, v = [i for i, _ in rows], np.array([x for _, x in rows], np.float32).astype(float)
    want = set()
    for q in queries:
        d = np.sqrt(((v - v[ids.index(q)]) ** 2).sum(1))
        best = sorted((d[j], i) for j, i in enumerate(ids) if i != q)[:k]
        want |= {(q, i, round(x, 5), r) for r, (x, i) in enumerate(best, 1)}
    return want


def test_index_is_exact_and_visits_few_cells(spark, monkeypatch):
    rows, out = crowds(np.random.default_rng(4), 1500, dim=6, centres=30)
    df = frame(spark, rows + out)
    index = VI.build(df, "id", "embedding", cells=40)
    assert index.rows == len(rows)
    report = {}
    got = {(r.query, r.id, round(r.distance, 5), r.rank) for r in index.search(df.where("id % 50 = 0"), "id", "embedding", 10, skip_own_key=True, report=report).collect()}
    assert got == nearest(rows, [i for i, _ in rows if i % 50 == 0], 10)
    assert report["share_of_cells"] < 0.35 and report["share_of_rows"] < 0.35
    # A stored index is found again; one probe already gives most of the answer.
    again = VI.VectorIndex(spark, index.path)
    some = {(r.query, r.id) for r in again.search(df.where("id % 50 = 0"), "id", "embedding", 10, probes=3, skip_own_key=True).collect()}
    full = {(q, i) for q, i, _, _ in got}
    assert len(some & full) >= 0.9 * len(full)


def test_index_of_shuffled_packs_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(VI, "BROADCAST", 0)
    rows = [(i, [float(i % 3), 1.0]) for i in range(9)]
    index = VI.build(frame(spark, rows), "id", "embedding")
    got = sorted((r.query, r.id, r.rank) for r in index.search(frame(spark, [(100, [0.0, 1.0]), (101, None), (102, [1.0])]), "id", "embedding", 4).collect())
    assert got == [(100, 0, 1), (100, 1, 4), (100, 3, 2), (100, 6, 3)]
    assert VI.build(frame(spark, []), "id", "embedding").search(frame(spark, rows), "id", "embedding", 3).isEmpty()
    assert index.search(frame(spark, []), "id", "embedding", 3).isEmpty()
