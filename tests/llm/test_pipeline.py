"""The pipeline against a plain version of its stages, each on its own predecessor's result."""

import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_decontamination import exhaustive
from test_jaccard import brute
from test_lines_and_archives import WS
from util import LOWER, SF, plain_clean


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
    text = lambda df: {r.doc_id: r.text for r in df.collect()}

    first = stage["quality rules"](spark, docs, SF)
    assert first.columns == docs.columns and first.dtypes == docs.dtypes
    a = text(first)
    cleaned = {r.doc_id: plain_clean(r.text) for r in docs.collect()}
    assert a == {i: t for i, t in cleaned.items() if t is not None}

    second = stage["line dedup"](spark, spark.createDataFrame(first.collect(), docs.schema), SF)
    b = text(second)
    holders: dict = {}
    for d, t in a.items():
        for k in {x.strip(WS).translate(LOWER) for x in t.split("\n")}:
            holders.setdefault(k, set()).add(d)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    assert b == {d: "\n".join(x for x in t.split("\n") if gone.get(x.strip(WS).translate(LOWER), d) == d) for d, t in a.items()}
    assert all(r.n_chars == len(r.text) for r in second.collect())

    third = stage["n-gram Jaccard join"](spark, spark.createDataFrame(second.collect(), docs.schema), SF)
    c = text(third)
    assert c == {d: b[d] for d, _, root in brute(list(b.items()), 5, 80) if d == root}

    fourth = stage["benchmark decontamination"](spark, spark.createDataFrame(third.collect(), docs.schema), SF)
    d = text(fourth)
    leaked = {i for i, _ in exhaustive(c.items(), [(r.item_id, r.text) for r in bench])}
    assert d == {i: t for i, t in c.items() if i not in leaked}

    true = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    want = {}
    for i, t in d.items():
        ids = true.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert got == want


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
    assert docs.count() == 0


def test_odd_rows_and_clashing_columns_pass_through_every_stage(spark):
    prose = " ".join(f"Fact{i} shows what{i} thing{i} works{i} here{i}." for i in range(12))
    rows = [(1, prose, "a", 5), (1, prose, "a", 5), (2, None, None, 0), (3, "", "b", 0), (4, prose + "\nHome\n", "c", None), (None, prose.replace("works", "fails"), "d", 1), (6, "word " * 30_000, "e", 2)]
    names = {"words": "string", "lines": "string", "kept": "int", "row": "string", "good": "string", "n_words": "long", "h": "string"}
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{n} {t}" for n, t in names.items())
    other = ("w", None, 9, "r", "g", -1, "z")
    docs = spark.createDataFrame([(*r, *other) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        assert all(tuple(r[n] for n in names) == other for r in out.collect()), name
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert sorted(((r.doc_id, r.text) for r in first.collect()), key=str) == sorted([(1, prose), (1, prose), (4, prose + "\n"), (None, prose.replace("works", "fails"))], key=str)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)
