import math
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from lumenframe.llm import language_model as L
from util import LOWER, SF, WORD, empty_documents, odd_documents

SMALL = L.Settings(words=300, known=600, tails=4, trainer_tokens=9_000, ramp=2_000, score_window=8, score_lanes=7)


def brute_base(rows):
    tokens = [[*WORD.findall((t or "").translate(LOWER)), "\n"] for _, t in rows]
    held = [zlib.crc32(str(d if d is not None else "").encode()) % 5 == 1 for d, _ in rows]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return sorted(((d, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 4)) for (d, _), t, h in zip(rows, tokens, held, strict=True)), key=str)


def test_base_scores_match_brute_force(spark):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_documents(spark), empty_documents(spark)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = L.score_documents(docs, SMALL).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=str) == brute_base(rows)
        assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_model_beats_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    held = [r for r in L.score_documents(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_every_training_document_reaches_backpropagation(spark):
    s = L.Settings(trainer_tokens=25)
    for n in (1, 2, 60):
        counts = spark.createDataFrame([*((f"only{i}".encode(), 1) for i in range(n)), (L.END, n)], "word binary, c long")
        v = L.build_vocabulary(counts, s)
        ids = [v.lookup([f"only{i}".encode(), L.END])[0].astype(np.uint16) for i in range(n)]
        docs = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(ids)], "doc_id long, ids binary")
        changed = (L.train(docs, v, s).p["input"] != L.Model(v, s).p["input"]).any(axis=1)
        assert changed[np.concatenate(ids)[::2]].all()


def brute_score(tokens, counts, v, m):
    """log10 probability of a document by the model's equations, one token after the other, in plain float64."""
    p, n, total, before = {k: a.astype(float) for k, a in m.p.items()}, m.hidden, 0.0, v.begin
    h = np.zeros(n)
    squash = lambda x: 1 / (1 + np.exp(-x))
    for w in tokens:
        x, u = p["input"][before], h @ p["state"]
        z, r = squash(x[:n] + u[:n]), squash(x[n : 2 * n] + u[n : 2 * n])
        h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * u[2 * n :])
        y = int(v.lookup([w])[0][0])
        cls = np.exp(p["class"] @ np.r_[h, 1])
        if y < v.first_tail:
            k = int(np.searchsorted(v.class_start, y, "right")) - 1
            own = np.exp(p["word"][v.class_start[k] : v.class_start[k + 1]] @ np.r_[h, 1])
            total += math.log10(cls[k] / cls.sum() * own[y - v.class_start[k]] / own.sum())
        else:
            k = y - v.first_tail
            total += math.log10(cls[m.n_word_classes + k] / cls.sum() * (counts.get(w, 0) + 0.5) / v.tail_mass[k])
        before = y
    return total


def test_scores_match_brute_force_in_any_layout(spark, monkeypatch):
    got, train = [], L.train

    def keep(encoded, v, s):
        got.append((v, train(encoded, v, s)))
        return got[-1][1]

    monkeypatch.setattr(L, "train", keep)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, L.words_of((r.text or "").encode())) for r in docs.collect()]
    tables = [{r.doc_id: r.score for r in L.score_documents(docs.repartition(n), SMALL).collect()} for n in (1, 7)]
    v, m = got[0]
    counts = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 1 for w in t)
    assert all(np.array_equal(a, got[1][1].p[k]) for k, a in m.p.items())
    for d, t in rows[:60]:
        want = brute_score(t, counts, v, m)
        assert all(abs(x[d] - want) < 1e-3 + 1e-5 * abs(want) for x in tables), d


def model_of(seed=3, hidden=5):
    rng = np.random.default_rng(seed)
    v = L.Vocabulary({}, np.zeros(0), np.zeros(0, np.int64), None, 0, 0, np.array([0, 1, 5, 9]), rng.random(9) * 9, rng.random(3) * 9 + 1)
    s = L.Settings(hidden=hidden, window=4, lanes=2, score_window=3, score_lanes=2)
    return v, s, L.Model(v, s, seed)


def test_probabilities_sum_to_one():
    v, _, m = model_of()
    h = np.random.default_rng(1).standard_normal((1, 5)).astype(np.float32)
    p = [math.exp(m.outputs(h, np.array([y]))[0]) for y in range(12)]
    assert abs(sum(p) - 1) < 1e-5


def test_windows_and_lanes_do_not_change_scores():
    v, s, m = model_of()
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 12, n) for n in (1, 17, 4, 30, 2)]
    want = []
    for d in docs:
        h, total, before = np.zeros((1, 5), np.float32), 0.0, v.begin
        for y in d:
            out, h, _ = m.steps(np.array([[before]]), np.ones((1, 1, 1), np.float32), h)
            total += m.outputs(out[0], np.array([y]))[0]
            before = y
        want.append(total / math.log(10))
    assert np.allclose(L.log_probs(m, docs, s, v.begin), want, atol=1e-4)


def test_windows_lengthen_where_few_lanes_are_left(monkeypatch):
    """A long document outlasts the others: its windows then hold as many tokens as those of all lanes, and its score is the same."""
    v, s, m = model_of()
    s.score_lanes = 32
    rng, calls, outputs = np.random.default_rng(2), [], m.outputs
    docs = [rng.integers(0, 12, n) for n in (960, *[6] * 40)]
    alone = [L.log_probs(m, [d], s, v.begin)[0] for d in docs]
    monkeypatch.setattr(m, "outputs", lambda h, y: calls.append(len(y)) or outputs(h, y))
    assert np.allclose(L.log_probs(m, docs, s, v.begin), alone, atol=1e-3)
    assert sum(calls) == 1200 and len(calls) <= 20 and max(calls) <= s.score_lanes * s.score_window


def test_gradients_match_differences():
    v, s, m = model_of()
    m.p = {k: a.astype(np.float64) for k, a in m.p.items()}
    rng = np.random.default_rng(4)
    x, y, keep = rng.integers(0, 13, (4, 2)), rng.integers(0, 12, (4, 2)), np.ones((4, 2, 1))
    y[3, 1], keep[2, 0] = -1, 0
    h = rng.standard_normal((2, 5)) / 2
    n, grads, _ = m.gradients(x, y, keep, h)
    assert n == 7
    ids, rows = grads["input"]
    grads["input"] = np.zeros_like(m.p["input"])
    grads["input"][ids] = rows

    def total(name, at, change):
        m.p[name][at] += change
        out = m.steps(x, keep, h)[0]
        out = -m.outputs(out[y >= 0], y[y >= 0]).sum()
        m.p[name][at] -= change
        return out

    for name, g in grads.items():
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in g.shape)
            assert abs((total(name, at, 1e-5) - total(name, at, -1e-5)) / 2e-5 - g[at]) < 1e-4, name


def test_learning_lowers_the_loss():
    v, s, m = model_of()
    m.p = {k: a.copy() for k, a in m.p.items()}
    docs = [np.tile([1, 5, 9, 2], 20) for _ in range(6)]
    before = L.log_probs(m, docs, s, v.begin).sum()
    squares = {k: np.zeros_like(a) for k, a in m.p.items()}
    for _ in range(5):
        L.train_on(m, docs, s, v.begin, squares)
    assert L.log_probs(m, docs, s, v.begin).sum() > 0.5 * before


def batch_of(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])


def test_words_are_split_as_the_contract_says():
    every = "".join(f"{chr(i)}Ab" for i in range(1, 256)) + "\u2003x\u3000\u1680y\u0000z"
    rows = ["", None, " \t\n\x0b\x0c\r", every, f" {every}\n", "É İ ẞ ABC", "one", "\n\n", "a\x1cB\x85c\xa0d", None]
    for batch in (batch_of(rows), batch_of(["skipped", *rows]).slice(1)):
        words, size = L._split(batch)
        want = [[w.encode() for w in WORD.findall((x or "").translate(LOWER))] for x in rows]
        assert words.to_pylist() == [w for x in want for w in x] and size.tolist() == [len(x) for x in want]
        assert [[*x, L.END] for x in want] == [L.words_of((x or "").encode()) for x in rows]
        for most in (1, 300, 1 << 24):
            pieces = list(L._pieces(batch, most))
            assert [x for p in pieces for x in p.column(0).to_pylist()] == rows and all(p.num_rows for p in pieces)
            counts = Counter()
            for found in L._counter(most)([batch, batch]):
                counts.update(dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True)))
            assert counts == Counter(2 * [w for x in want for w in [*x, L.END]])


def test_counting_costs_less_than_a_dictionary_of_words():
    """The check's budget is CPU seconds: words are counted without an object for each (before: as long as the plain loop)."""
    texts = pq.read_table(f"{SF.replace('0.001', '0.01')}/documents.parquet", columns=["text"]).column(0).to_pylist()
    batch = batch_of(texts)

    def plain():
        c = Counter()
        for x in batch.column(0).cast(pa.large_binary()):
            c.update(L.words_of(x.as_py() or b""))

    def cpu(f):
        t = time.process_time()
        f()
        return time.process_time() - t

    assert min(cpu(lambda: list(L._counter(1 << 24)([batch]))) for _ in range(5)) < 0.8 * min(cpu(plain) for _ in range(5))


def test_grouped_sums_match_reduceat():
    rng = np.random.default_rng(5)
    for columns, kind in ((16, np.float32), (5, np.float32), (6, np.float64)):
        rows, start = rng.standard_normal((50, columns)).astype(kind), np.array([0, 1, 7, 8, 49])
        got = L._sums(rows, start)
        assert got.dtype == kind and np.allclose(got, np.add.reduceat(rows, start, axis=0), atol=1e-5)
