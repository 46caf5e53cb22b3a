import random

import numpy as np

from lumenframe.llm import decontamination as D
from util import SF, empty_documents, odd_documents


def slow_align(item, passage):
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a == b else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_matches_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(1, 15))] for _ in range(2))
        assert D.align(np.array(a), np.array(b))[0] == slow_align(a, b)


def edited(words, rate, rng):
    out = []
    for w in words:
        x = rng.random()
        if x < rate / 2:
            out.append("other" + str(rng.randint(0, 99)))
        elif x > rate / 2 + rate / 4:
            out.append(w)
    return out


def test_planted_copies_are_found_and_others_left_alone(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    prose = lambda n: [vocabulary[int(rng.paretovariate(0.6)) % 3000] for _ in range(n)]
    items = [(i, " ".join(prose(30 + i))) for i in range(20)]
    rows, want = [], set()
    for d in range(200):
        words = prose(300)
        if d % 4 == 0:
            i = d % 20
            at = rng.randint(0, 300)
            words[at:at] = edited(items[i][1].split(), 0.15, rng)
            want.add((d, i))
        rows.append((d, " ".join(words).upper() if d % 8 == 0 else ", ".join(words), 1))
    # One item stands in very many documents and is still found in each.
    rows += [(1000 + k, " ".join(prose(5)) + " " + items[0][1], 1) for k in range(300)]
    want |= {(1000 + k, 0) for k in range(300)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (79, "w1")], "item_id long, text string")
    for words in (1_000_000, 100):
        found = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench.where("item_id < 79"), block_words=words).collect()}
        assert found == want
    left = {r.doc_id for r in D.decontaminate(docs, bench.where("item_id < 79")).collect()}
    assert left == {r[0] for r in rows} - {d for d, _ in want}


def test_verbatim_items_in_the_test_tables(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows, items = docs.collect(), bench.collect()
    exact = {(r.doc_id, b.item_id) for r in rows for b in items if b.text in r.text}
    found = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()}
    assert exact and exact <= found


def exhaustive(docs, items, least=0.5):
    """(doc_id, item_id) of all pairs whose best local alignment, over the whole text and without seeds, reaches the score."""
    block = D.Block(items, 4)
    found = set()
    for d, text in docs:
        ids = block.ids_of((text or "").encode())
        for item_id, item in block.items:
            need = least * len(item) if len(item) >= 4 else len(item)
            if len(item) and block.shared(item, ids) >= need and D.align(item, ids)[0] >= need:
                found.add((d, item_id))
    return found


def test_query_equals_exhaustive_alignment(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = exhaustive([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in bench])
    out = D.op9_decontamination(spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in out} == want and len(out) == len(want) > 20


def test_repeated_documents_are_each_reported(spark):
    rows = [(1, "so it says the quick brown fox jumps over the lazy dog again"), (1, "so it says the quick brown fox jumps over the lazy dog again"), (2, None)]
    bench = spark.createDataFrame([(7, "The quick brown fox jumps over the lazy dog!"), (7, "The quick brown fox jumps over the lazy dog!")], "item_id long, text string")
    out = D.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert [(r.doc_id, r.item_id, r.score, r.first_word, r.last_word) for r in out] == [(1, 7, 1.0, 3, 11)] * 4


def test_frequent_edited_copies_and_excerpts_are_found(spark):
    words = [f"v{i}" for i in range(40)]
    edit = " ".join("other" if i % 6 == 5 else w for i, w in enumerate(words))
    excerpt = " ".join(words[:21])
    # Edited copies keep 13 of 37 n-grams, excerpts 18; one whole copy of the second item makes its other n-grams rare, not absent.
    second = [f"u{i}" for i in range(40)]
    rows = [(d, f"before {d} {edit} after") for d in range(60)]
    rows += [(100 + d, f"before {d} {' '.join(second[:21])} after") for d in range(60)] + [(200, " ".join(second))]
    rows += [(300 + d, f"before {d} {excerpt.replace('v', 't')} after") for d in range(60)]
    items = [(1, " ".join(words)), (2, " ".join(second)), (3, " ".join(words).replace("v", "t"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {(r.doc_id, r.item_id) for r in D.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(d, 1 if d < 100 else 3 if d >= 300 else 2) for d, _ in rows}


def test_odd_inputs(spark):
    bench = spark.createDataFrame([(1, "zürich naïve ωmega İstanbul σας"), (2, "word"), (3, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in D.contaminated(odd_documents(spark), bench, least_score=0.3).collect()}
    assert (10, 2) in found
    assert D.contaminated(empty_documents(spark), bench).count() == 0
    assert D.contaminated(odd_documents(spark), bench.limit(0)).count() == 0
    assert D.decontaminate(odd_documents(spark), bench.limit(0)).count() == odd_documents(spark).count()
