import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenframe.llm import bpe
from util import SF, empty_documents, odd_documents

TRUE = Tokenizer.from_file(str(public_tokenizers.path(bpe.VOCABULARY)))
TRUE.no_truncation()
TRUE.no_padding()


def want(text):
    ids = TRUE.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(TRUE.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_documents_match_the_library(spark):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_documents(spark), empty_documents(spark)):
        rows = docs.select("doc_id", "text").collect()
        got = sorted((tuple(r) for r in bpe.digests(bpe.encode_documents(docs)).collect()), key=str)
        assert got == sorted(((r.doc_id, *want(r.text)) for r in rows), key=str)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40) | st.text("abcdefghi'st 12<|>endoftext\n\t\x1c\x85 éÉΣσİ", max_size=60))
def test_any_text_matches_the_library(text):
    c = bpe.codec()
    (ids,) = c.encode_batch([text])
    true = TRUE.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == true
    assert c.decode(ids) == TRUE.decode(true, skip_special_tokens=False)


def test_full_caches_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 100)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 50)
    c = bpe.Codec(str(public_tokenizers.path(bpe.VOCABULARY)))
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(1500).collect()]
    got = [x for first in range(0, len(texts), 5) for x in c.encode_batch(texts[first : first + 5])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in TRUE.encode_batch(texts, add_special_tokens=False)]
    assert c.older
