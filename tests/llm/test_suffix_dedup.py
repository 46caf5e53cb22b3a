import hashlib
import random

import numpy as np

from lumenframe.llm import suffix_dedup as S
from util import SF, empty_documents, odd_documents


def brute(rows, length=100):
    rank = lambda r: (r[0] is not None, r[0] or 0)
    seen, out = set(), {}
    import xxhash

    tag = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + 2**63) % 2**64  # noqa: E731  as Spark orders it
    for d, text in sorted(set(rows), key=lambda r: (rank(r), tag(r[1]))):
        x = (text or "").encode()
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            w = x[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(x, gone, strict=False) if not g)
        runs = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(int)) == 1))
        out[d, text] = (d, len(x), len(x) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return sorted((out[r] for r in rows), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()), key=str)


def test_test_table_and_odd_rows_match_brute_force(spark):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_documents(spark), empty_documents(spark)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert got(S.dedup_substrings(docs)) == brute(rows)


def planted(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefghij é"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [text(rng.choice([99, 100, 101, 160, 400])) for _ in range(6)]
    rows = [(d, "".join(x for _ in range(rng.randint(0, 5)) for x in (text(rng.randint(0, 150)), rng.choice(shared)))) for d in range(60)]
    rows += [(100, "ab" * 400), (101, "x" * 99), (102, "x" * 100), (103, "x" * 400), (104, "ab" * 400), (None, shared[3]), (105, text(50) + "ab" * 90)]
    rows += rows[:20] + [(d, x) for d, x in rows[:20]] + [(102, shared[4])]  # repeated rows, and one id with two texts
    rng.shuffle(rows)
    return rows


def test_planted_repeats_match_brute_force(spark):
    for seed in range(2):
        rows = planted(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert got(S.dedup_substrings(docs)) == brute(rows)
    assert got(S.dedup_substrings(docs, most_bits=1 << 10)) == brute(rows)  # all suspected
    assert got(S.dedup_substrings(docs, length=64)) == brute(rows, 64)
    assert got(S.dedup_substrings(docs, most_open=1)) == got(S.dedup_substrings(docs, most_open=3)) == brute(rows)  # frequent keys by digests


def test_texts_longer_than_a_chunk(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(400_000))
    rows = [(2, text), (1, text[262_000:262_300]), (3, text[100:250] + "zz" + text[:99])]
    assert got(S.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_interval_expansion_finds_common_prefixes():
    rng = np.random.default_rng(0)
    for length in (1, 2, 5):
        body = rng.integers(0, 3, 120)
        text = np.r_[body[:60] + 2, 0, body[60:] + 2, 1]
        sa, rank = S.suffix_order(text)
        suffixes = [text[i:].tolist() for i in sa]
        assert suffixes == sorted(suffixes)
        group = S.equal_prefixes(text, sa, rank, length)
        for i in range(1, len(sa)):
            common = next(k for k, (a, b) in enumerate(zip(suffixes[i - 1], suffixes[i], strict=False)) if a != b)
            assert (group[i] == group[i - 1]) == (common >= length)
