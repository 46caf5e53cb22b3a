import hashlib
import math

import numpy as np
import pytest

from lumenframe.llm import vector_codes as C

NAN, INF = float("nan"), float("inf")


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows (id, label, ints) in order of id -> {id: (code, error)}, final entries; plain Lloyd in Python integers."""
    d = len(rows[0][2]) // parts
    cut = [[r[2][p * d : (p + 1) * d] for r in rows] for p in range(parts)]
    books = [[list(x) for x in cut[p][:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(p, x)[1] for x in cut[p]]
            for e in range(len(books[p])):
                mine = [x for x, k in zip(cut[p], own, strict=True) if k == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [[nearest(p, cut[p][i]) for p in range(parts)] for i in range(len(rows))]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return ["".join(f"{k:02x}" for _, k in f) for f in found], [sum(x for x, _ in f) for f in found], sha


def frame(spark, rows):
    return spark.createDataFrame([(i, x, label, "e", 3) for i, x, label in rows], "vec_id long, embedding array<float>, label int, code string, id int")


def answer(spark, df, **how):
    rows = C.kept_rows(df, "vec_id", "embedding", "label")
    found = C.train(rows, **how)
    return found, C.with_label_total(found.rows_of("bigint", "int"), "id").collect()


@pytest.mark.parametrize("block", [7, 8192])
def test_codes_equal_plain_rounds(spark, monkeypatch, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(scale=0.3, size=16)).astype(np.float32).tolist(), [None, 1, 2][i % 3]) for i in range(300)]
    rows += [(400 + i, rows[5][1], 1) for i in range(60)]  # a group of copies
    rows += [(500, None, 1), (501, [], None), (502, [0.5] * 15 + [NAN], 2), (503, [INF] * 16, 2), (504, [0.1, None] * 8, 2), (505, [1.0] * 9, 2), (-7, rows[9][1], 2)]
    monkeypatch.setattr(C, "BLOCK", block)
    found, out = answer(spark, frame(spark, rows).repartition(5))
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: r[0])
    ints = [(i, label, [math.floor(4096 * float(np.float32(x))) for x in v] + [0] * (16 - len(v))) for i, v, label in kept]
    codes, errors, sha = brute(ints)
    total = {}
    for (_, label, _), e in zip(ints, errors, strict=True):
        total[label] = total.get(label, 0) + e
    assert sorted((r["id"], r["code"], r["error"], r["label_error"]) for r in out) == [(i, c, e, total[label]) for (i, label, _), c, e in zip(ints, codes, errors, strict=True)]
    assert found.sha256() == sha
    assert max(found.blocks.read().selectExpr("size(ids)").first()) <= block
    # Later rounds compare only what the heaps gave up.
    assert found.compared[0] == 8 * len(ints) and found.compared[-1] < found.compared[1] < found.compared[0]
    assert found.codebooks(spark).count() == 8 * 16


def test_few_equal_large_and_no_rows(spark):
    few = [(2, [0.25] * 8, 1), (1, [0.25] * 8, 1), (3, [-1.5] * 8, None)]
    found, out = answer(spark, frame(spark, few))
    assert {r["id"]: r["code"] for r in out} == {1: "00" * 8, 2: "00" * 8, 3: "02" * 8} and {r["error"] for r in out} == {0}
    assert found.entries.shape == (8, 3, 1)
    one, out = answer(spark, frame(spark, few[:1]))
    assert [r["code"] for r in out] == ["00" * 8] and one.compared == [8] + [0] * 6
    same, out = answer(spark, frame(spark, [(None, [0.5] * 16, None)] * 3 + [(1, [0.25] * 16, None)]))
    assert sorted((r["id"] or 0, r["code"]) for r in out) == [(0, "01" * 8)] * 3 + [(1, "00" * 8)]
    empty = C.train(C.kept_rows(frame(spark, few[:0]), "vec_id", "embedding", "label"))
    assert empty.rows == 0 and empty.entries.shape[1] == 0
    with pytest.raises(Exception, match="exceed a long"):
        answer(spark, frame(spark, [(1, [1e30] * 8, 1)]))


def test_empty_table_has_the_query_columns(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = C.op11_vector_codes(spark, str(tmp_path))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.isEmpty()


def test_heaps_give_up_exactly_what_drift_reached():
    heaps = C.Heaps.empty(2)
    heaps.push(np.array([4, 1, 3]), np.array([0, 1, 0]), np.array([2.0, 5.0, 1.0], np.float32))
    heaps.push(np.array([0, 2]), np.array([0, 0]), np.array([1.5, 9.0], np.float32))
    assert [m.tolist() for m in heaps.members] == [[3, 0, 4, 2], [1]]
    who, left = heaps.pop(np.array([1.5, 4.9]))
    assert who.tolist() == [3, 0] and left.tolist() == [0, 0] and [m.tolist() for m in heaps.members] == [[4, 2], [1]]


def test_large_components_are_compared_in_integers():
    x, e = np.array([[1 << 27, 0], [3, 1 << 26]]), np.array([[1, 1], [1 << 27, 2]])
    assert C.squared(x, e).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in e] for r in x]
